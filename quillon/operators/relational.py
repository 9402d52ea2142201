"""Multi-valued attributes, lookups, samples, cleaning and graph patterns."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.ordered import running
from quillon.functions.text import split_list, tokens


def explode_list(df: DataFrame, column: str, sep: str, out: str) -> DataFrame:
    """One row a value; a null list stays one null row, an empty text one empty row."""
    return df.withColumn(out, F.explode_outer(F.split(column, sep)))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def values_at_ranks(df: DataFrame, column: str, ranks: list[int]) -> DataFrame:
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    r = running(c, [F.desc("n"), column], {"rank": F.lit(1)}).withColumn("rank", (F.col("rank") - 1).cast("int"))
    return r.where(F.col("rank").isin(ranks)).select(column, "n", "rank")


def drop_single_values(df: DataFrame, id_col: str, column: str, sep: str) -> DataFrame:
    """Lists without the values that occur once in the whole table; order and repeats stay, '' if none is left."""
    long = df.select(id_col, F.posexplode(split_list(F.col(column), sep)).alias("pos", "v"))
    often = long.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    kept = long.join(often, "v", "left_semi").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a"))
    return df.select(id_col, F.col(column).alias("__raw")).join(kept, id_col, "left").select(id_col, F.when(F.coalesce(F.trim("__raw"), F.lit("")) == "", F.col("__raw")).otherwise(F.coalesce(F.array_join(F.transform("a", lambda x: x["v"]), sep + " " if sep == "," else sep), F.lit(""))).alias(column))


def map_lists(df: DataFrame, id_col: str, values: str, lookup: DataFrame, key: str, value: str, sep: str = "|") -> DataFrame:
    """Array values mapped by a lookup table, unmapped ones dropped, sorted and distinct; null where none maps."""
    long = df.select(id_col, F.explode(values).alias(key)).join(lookup, key)
    mapped = long.groupBy(id_col).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias("mapped"))
    return df.select(id_col).join(mapped, id_col, "left")


def zip_lists(df: DataFrame, names: str, ids: str, sep: str = ",") -> DataFrame:
    """Parallel lists: each name with its sorted distinct ids."""
    pairs = df.select(F.explode(F.arrays_zip(split_list(F.col(names), sep).alias("name"), split_list(F.col(ids), sep).alias("id"))).alias("p")).select("p.name", "p.id").where("name IS NOT NULL AND id IS NOT NULL")
    return pairs.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))


def draw_key(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def sample_per_group(df: DataFrame, key: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows a group in a repeatable random order; n <= 0 keeps all."""
    if n <= 0:
        return df
    r = df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(draw_key(id_col, seed), id_col)))
    return r.where(F.col("__rn") <= n).drop("__rn")


def downsample_to_smallest(df: DataFrame, key: str, id_col: str, seed: int = 42) -> DataFrame:
    least = df.groupBy(key).agg(F.count("*").alias("c")).agg(F.min("c").alias("__least"))
    r = df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(draw_key(id_col, seed), id_col)))
    return r.crossJoin(F.broadcast(least)).where("__rn <= __least").drop("__rn", "__least")


def poisson_bootstrap(df: DataFrame, key: str, id_col: str, value: str, reps: int = 100, seed: int = 42) -> DataFrame:
    """(key, mean, low, high): percentile interval of the mean over Poisson(1)-weighted replicates, in one pass."""
    b = df.select(key, id_col, value, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    u = (F.conv(F.substring(F.md5(F.concat_ws("-", F.col(id_col).cast("string"), "rep", F.lit(seed))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    weight = reduce(lambda a, s: a + (u > s).cast("int"), steps, F.lit(0))
    means = b.groupBy(key, "rep").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p")).select(key, F.col("p")[1].alias("median"), F.col("p")[0].alias("low"), F.col("p")[2].alias("high"))


def token_features(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Tokens, distinct tokens and Shannon entropy (bits) of each text; 0 for a text without tokens. Texts are counted in
    Arrow batches where they lie, so nothing is shuffled; lower case and white space are as in functions.text.tokens."""
    kind = df.schema[id_col].dataType.simpleString()
    space = re.compile("[ \\t\\n\\x0b\\f\\r]+")

    def run(batches):
        for b in batches:
            n, distinct, entropy = [], [], []
            for t in b.column(1).to_pylist():
                counts = Counter(space.split(t))
                counts.pop("", None)
                c = np.fromiter(counts.values(), float, len(counts))
                total = c.sum()
                n.append(int(total))
                distinct.append(len(c))
                entropy.append(float(np.log2(total) - (c * np.log2(c)).sum() / total) if total else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), pa.array(entropy, pa.float64())], names=[id_col, "n_tokens", "n_distinct", "entropy"])

    lowered = F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text")
    return df.select(id_col, lowered).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_distinct long, entropy double")


def clean_funnel(df: DataFrame, id_col: str, text: str, steps: list[tuple[str, object]]) -> DataFrame:
    """Rows left after each cumulative filter, in one scan: (step, name, n)."""
    flags, so_far = [], F.lit(True)
    for _, cond in steps:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        flags.append(so_far)
    one = df.agg(*[F.count_if(f).alias(f"n{i}") for i, f in enumerate(flags)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(steps)])).alias("x")).select("x.*")


def closure(edges: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """Nodes reached from the roots (root, node), roots included; the frontier shrinks to nothing, so cycles end.

    Each level is one job. Levels are written into the shared folder (spark.checkpoint.dir) where one is set, so
    lineage stays short however deep the graph; else, as in tests, they are cached."""
    spark = edges.sparkSession
    edges = edges.select("parent", "child").distinct().persist()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    keep = (lambda d: d.checkpoint(eager=True)) if folder else (lambda d: d.persist())
    seen = roots.select(F.col("node").alias("root"), "node").distinct()
    frontier = seen = keep(seen)
    for _ in range(most):
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = keep(step.join(seen, ["root", "node"], "left_anti"))
        if not frontier.count():
            edges.unpersist()
            return seen
        seen = keep(seen.unionByName(frontier)) if folder else seen.unionByName(frontier)
    raise RuntimeError("closure did not settle")


def length_buckets(df: DataFrame, id_col: str, length: str, buckets: int) -> DataFrame:
    """Equal-count buckets in order of length: the bucket of rank r is the largest i with int(i n / B) <= r."""
    r = running(df.select(id_col, length), [length, id_col], {"r": F.lit(1)}).withColumn("r", F.col("r") - 1).withColumnRenamed("r_total", "n")
    guess = F.floor((F.col("r") + 1) * buckets / F.col("n")).cast("int")
    b = F.when(F.floor(guess * F.col("n") / buckets) <= F.col("r"), guess).otherwise(guess - 1)
    return r.withColumn("bucket", F.least(b, F.lit(buckets - 1)))


def chunk_windows(df: DataFrame, id_col: str, toks: str, size: int, stride: int) -> DataFrame:
    """Sliding windows (id, start, chunk) that stop once a window reaches the end; a stride <= 0 is the size."""
    stride = stride if stride > 0 else size
    last = F.greatest(F.ceil((F.size(toks) - size) / F.lit(stride)), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    return df.where(F.size(toks) > 0).select(id_col, toks, F.explode(starts).alias("start")).select(id_col, "start", F.slice(toks, F.col("start") + 1, size).alias("chunk"))


def overlap_weights(pieces: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Weights of pieces (key, s, e, w) summed on the spans (key, s, e, term) they overlap, renormalised by key."""
    p, q = pieces.alias("p"), spans.alias("q")
    met = p.join(q, (F.col(f"p.{key}") == F.col(f"q.{key}")) & (F.col("p.s") < F.col("q.e")) & (F.col("p.e") > F.col("q.s")))
    s = met.groupBy(F.col(f"p.{key}").alias(key), F.col("q.term").alias("term")).agg(F.sum("p.w").alias("w"))
    return s.select(key, "term", (F.col("w") / F.sum("w").over(W.partitionBy(key))).alias("weight"))


def nested_rows(df: DataFrame, items: str, keep: list[str], category: str, wanted, added: list[tuple] = ()) -> DataFrame:
    """The structs of the list column `items` as rows beside the columns kept, of one category, and the rows `added`.
    A null or empty list gives no row."""
    flat = df.select(*keep, F.explode(items).alias("__item")).select(*keep, "__item.*").where(F.col(category) == F.lit(wanted))
    return flat.unionByName(df.sparkSession.createDataFrame(list(added), flat.schema)) if added else flat
