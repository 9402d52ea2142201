"""Search in directed graphs of terms (child, parent): levels below the roots, and the best ancestor of a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.kept import keep


def level(edges: DataFrame, depth: int) -> DataFrame:
    """(node) that some path of exactly `depth` steps from a root reaches. Roots are parents that are no one's child."""
    e = edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    now = e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")
    for _ in range(depth):
        now = now.join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
    return now


def best_ancestor(words: DataFrame, edges: DataFrame, depth: int, stop: DataFrame | None = None, most: int = 64) -> DataFrame:
    """(word, ancestor, steps): for each word (word, node, rank: its meanings in order) the ancestor, the node itself too, at
    `depth` steps below a root, that is not among the stop nodes (node): by the first meaning that has one, then the
    fewest steps up, then the smaller name. Words without one have no row. The search goes up a step at a time, each node
    of a word once, so cycles end; it stops after `most` steps, which raises if nodes are left."""
    e = edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    good = level(edges, depth)
    if stop is not None:
        good = good.join(stop.select("node").distinct(), "node", "left_anti")
    good = keep(good, "taxonomy-level")
    seen = frontier = keep(words.where("word IS NOT NULL AND node IS NOT NULL").groupBy("word", "node").agg(F.min("rank").alias("rank")).withColumn("steps", F.lit(0)), "taxonomy")
    for _ in range(most):
        up = frontier.join(e, F.col("node") == F.col("child")).groupBy("word", F.col("parent").alias("node"), "steps").agg(F.min("rank").alias("rank"))
        known = seen.groupBy("word", "node").agg(F.min("rank").alias("old"))
        # a node met again counts only for an earlier meaning
        step = up.join(known, ["word", "node"], "left").where("old IS NULL OR rank < old").select("word", "node", "rank", (F.col("steps") + 1).alias("steps"))
        frontier = keep(step, "taxonomy")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"there are nodes more than {most} steps up")
    hits = seen.join(good, "node")
    return hits.groupBy("word").agg(F.min(F.struct("rank", "steps", F.col("node").alias("ancestor"))).alias("b")).select("word", "b.ancestor", "b.steps")


def vocabulary(words: DataFrame, frequency: str, least: float, stop: DataFrame, endings: list[str], most: int) -> DataFrame:
    """(rank, word, frequency): single plain words (letters alone, at least three) of a frequency of at least `least`, none of
    the stop words, none with one of the endings, the most frequent first, ties by word. A top-k report."""
    w = words.where(F.col("word").rlike("^[a-z]{3,}$") & (F.col(frequency) >= least))
    for x in endings:
        w = w.where(~F.endswith("word", F.lit(x)))
    w = w.join(stop.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.max(frequency).alias(frequency))
    top = w.orderBy(F.desc(frequency), "word").limit(most)
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col(frequency)).alias("f"), "word"))).alias("x")).select(F.posexplode("x").alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.word", (-F.col("x.f")).alias(frequency))
