"""Similarity operators over (id, vector) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine_distance, dot, doubles, gram, long_form, norm, unit, unit_sums
from quillon.operators.blocks import Earlier, build, points, scan


def anchor(df: DataFrame, ids: list, id_col: str, vector: str = "embedding", method: str = "mean") -> DataFrame:
    """One row (anchor): component-wise mean or median of the listed ids, or their medoid. Missing ids raise."""
    some = df.where(F.col(id_col).isin(ids))
    if some.select(id_col).distinct().count() != len(set(ids)):
        raise ValueError("an anchor id is not in the table")
    if method == "medoid":
        return medoids(some.withColumn("__g", F.lit(1)), "__g", id_col, vector).select(F.col("embedding").alias("anchor"))
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method}")
    agg = F.avg("x") if method == "mean" else F.percentile("x", 0.5)
    cells = long_form(some, [], vector).groupBy("pos").agg(agg.alias("m")).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    return cells.select(F.transform("c", lambda c: c["m"]).alias("anchor"))


def distances(df: DataFrame, to: DataFrame, id_col: str, vector: str = "embedding", exclude: list = ()) -> DataFrame:
    """(id, distance) of every row to one anchor row; the anchor alone is broadcast."""
    rows = df.where(~F.col(id_col).isin(list(exclude))) if exclude else df
    return rows.crossJoin(F.broadcast(to)).select(id_col, cosine_distance(doubles(vector), F.col("anchor")).alias("distance"))


def nearest(df, to, id_col, n=10, exclude=(), farthest=False, vector="embedding") -> DataFrame:
    """The n nearest (or farthest) rows, ties by id; rank from 1. A top-k report."""
    d = distances(df, to, id_col, vector, exclude).orderBy(F.desc("distance") if farthest else F.asc("distance"), id_col).limit(n)
    order = W.orderBy(F.desc("distance") if farthest else F.asc("distance"), id_col)
    return d.withColumn("rank", F.row_number().over(order))


def epsilon_ball(df, to, id_col, eps: float, exclude=(), vector="embedding") -> DataFrame:
    if not 0 <= eps <= 2:
        raise ValueError("epsilon must be between 0 and 2")
    return distances(df, to, id_col, vector, exclude).where(F.col("distance") <= eps)


def counts_by_epsilon(dist: DataFrame, grid: list[float]) -> DataFrame:
    """Rows within each epsilon, by one pass: rows are counted by their first grid step, then summed up."""
    steps = F.array(*[F.lit(float(e)) for e in grid])
    first = dist.select(F.element_at(F.concat(F.filter(steps, lambda e: e >= F.col("distance")), F.array(F.lit(None).cast("double"))), 1).alias("eps"))
    counted = first.where("eps IS NOT NULL").groupBy("eps").agg(F.count("*").alias("c"))
    every = dist.sparkSession.createDataFrame([(float(e),) for e in grid], "eps double")
    return every.join(counted, "eps", "left").select("eps", F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("eps")).alias("neighbours"))


def medoids(df: DataFrame, key: str, id_col: str, vector: str = "embedding", furthest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) summed cosine distance to its group, by dot(u, sum of u): no pairs."""
    sums = unit_sums(df, [key], vector)
    rows = df.select(key, id_col, F.col(vector).alias("embedding")).join(sums, key)
    scored = rows.select(key, id_col, "embedding", F.round(F.col("n") - dot(unit(doubles("embedding")), F.col("total")), 9).alias("sum_distance"))
    best = F.min(F.struct((-F.col("sum_distance") if furthest else F.col("sum_distance")).alias("d"), F.col(id_col).alias("id"), "embedding", "sum_distance"))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.id").alias(id_col), F.col("b.sum_distance").alias("sum_distance"), F.col("b.embedding").alias("embedding"))


def mean_pair_cosine(total, own, n):
    """Mean cosine over all pairs of different rows, from a group's sum of unit vectors."""
    return (dot(total, total) - own) / (n * (n - 1))


def within_distance(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance of each group: 1 - (|sum u|^2 - own) / (n (n - 1)); 0 below two rows. A zero vector
    has distance 1 to all others."""
    s = unit_sums(df, [key], vector)
    mean = 1 - mean_pair_cosine(F.col("total"), F.col("own"), F.col("n").cast("double"))
    return s.select(key, F.col("n").cast("long").alias("n"), F.when(F.col("n") < 2, 0.0).otherwise(mean).alias("mean_distance"))


def between_distance(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine distance between each two groups: 1 - dot of their mean unit vectors."""
    s = unit_sums(df, [key], vector)
    a, b = (s.select(F.col(key).alias(f"{key}_{i}"), F.col("n").alias(f"n_{i}"), F.col("total").alias(f"t_{i}")) for i in (1, 2))
    return a.join(b, F.col(f"{key}_1") < F.col(f"{key}_2")).select(f"{key}_1", f"{key}_2", (1 - dot(F.col("t_1"), F.col("t_2")) / (F.col("n_1") * F.col("n_2"))).alias("mean_distance"))


def cosine_stats(df: DataFrame, key: str | None, vector: str = "embedding") -> DataFrame:
    """n_pairs, mean, population variance and std of pairwise cosines by group, from sums and Gram matrices:
    the sum of squared cosines of all ordered pairs is the squared Frobenius norm of the Gram matrix."""
    g = gram(df, key, vector, normalise=True).where("n > 1")
    own = F.aggregate(F.sequence(F.lit(0), F.size("s") - 1), F.lit(0.0), lambda t, i: t + F.get("g", i * (F.size("s") + 1)))  # rows that are not zero
    g = g.withColumn("own", F.round(own))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = (dot(F.col("s"), F.col("s")) - F.col("own")) / 2 / pairs
    square = (dot(F.col("g"), F.col("g")) - F.col("own")) / 2 / pairs
    out = g.select(F.col("key"), pairs.cast("long").alias("n_pairs"), mean.alias("mean_cosine"), F.greatest(square - mean * mean, F.lit(0.0)).alias("var_cosine"))
    return out.withColumn("std_cosine", F.sqrt("var_cosine"))


def resultant_length(df: DataFrame, vector: str = "embedding") -> DataFrame:
    s = unit_sums(df, [], vector)
    r = norm(F.col("total")) / F.col("n")
    return s.select(F.col("n").cast("long").alias("n"), r.alias("resultant"), (F.col("n") * F.size("total") * r * r).alias("rayleigh"))


def novelty(df: DataFrame, id_col: str, time_col: str, vector: str = "embedding", stretches: int = 8) -> DataFrame:
    """Distance to the nearest strictly earlier row; rows of the first time are absent, rows without a time or a vector
    are left out, a repeated id has its least distance.

    Rows are packed into blocks of at most blocks.ROWS whatever their times, by stretches of time and then by angle.
    Pairs of blocks of which the second has nothing earlier are never made; of the others those are passed over that by
    their centres and radii can't hold anything nearer than what each row has found."""
    kind = df.schema[time_col].dataType.simpleString()
    t = F.unix_micros(F.col(time_col).cast("timestamp")) if kind in ("date", "timestamp") else F.col(time_col).cast("double" if kind in ("float", "double") or kind.startswith("decimal") else "long")
    index = build(df.where(F.col(time_col).isNotNull()), id_col, vector, {"t": t}, by="t", stretches=stretches)
    best = scan(index, index, Earlier(), Earlier.SCHEMA, meet=F.col("right_low") < F.col("left_high"))
    found = points(index).join(best.withColumnRenamed("p", "q"), F.col("p") == F.col("q"))
    return found.groupBy("id").agg((1 - F.max("cosine")).alias("novelty")).withColumnRenamed("id", id_col)
