"""Time series of group representatives: drift, convergence, smoothing, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.vectors import cosine_distance, long_form, mean_vectors


def period(c, years: int = 1):
    return (F.floor(c / years) * years).cast("int")


def _next(g: str, t: str):
    return W.partitionBy(g).orderBy(t)


def drift_velocity(df: DataFrame, g="genre", t="year", vector="embedding") -> DataFrame:
    """Cosine distance between a group's centroid and its next present period's (g, t, n, next_n, velocity)."""
    c = mean_vectors(df, [g, t], vector)
    w = _next(g, t)
    c = c.withColumn("following", F.lead("centroid").over(w)).withColumn("next_n", F.lead("n").over(w))
    return c.where("following IS NOT NULL").select(g, t, F.col("n").cast("long").alias("n"), F.col("next_n").cast("long").alias("next_n"), cosine_distance(F.col("centroid"), F.col("following")).alias("velocity"))


def drift_components(df: DataFrame, g="genre", t="year", vector="embedding") -> DataFrame:
    """Next minus current centroid, long form (g, t, pos, diff)."""
    c = long_form(df, [g, t], vector).groupBy(g, t, "pos").agg(F.avg("x").alias("m"))
    diff = F.lead("m").over(W.partitionBy(g, "pos").orderBy(t)) - F.col("m")
    return c.select(g, t, F.col("pos").cast("int").alias("pos"), diff.alias("diff")).where("diff IS NOT NULL")


def acceleration(velocity: DataFrame, g="genre", t="year") -> DataFrame:
    return velocity.select(g, t, (F.lead("velocity").over(_next(g, t)) - F.col("velocity")).alias("acceleration")).where("acceleration IS NOT NULL")


def cumulative(velocity: DataFrame, g="genre", t="year") -> DataFrame:
    return velocity.select(g, t, F.sum("velocity").over(_next(g, t).rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"))


def convergence_pairs(df: DataFrame, g="genre", t="year", vector="embedding") -> DataFrame:
    c = mean_vectors(df, [g, t], vector)
    a, b = (c.select(t, F.col(g).alias(f"{g}_{i}"), F.col("centroid").alias(f"c_{i}")) for i in (1, 2))
    return a.join(b, t).where(F.col(f"{g}_1") < F.col(f"{g}_2")).select(t, f"{g}_1", f"{g}_2", cosine_distance(F.col("c_1"), F.col("c_2")).alias("distance"))


def convergence_mean(pairs: DataFrame, g="genre", t="year") -> DataFrame:
    both = pairs.select(t, F.col(f"{g}_1").alias(g), "distance").unionByName(pairs.select(t, F.col(f"{g}_2").alias(g), "distance"))
    return both.groupBy(t, g).agg(F.avg("distance").alias("mean_distance"))


def centred_mean(value: str, order: str, width: int, by=()):
    """Rolling mean with min_periods 1; an even width looks one row further back than ahead."""
    back, ahead = width // 2, width // 2 - (1 if width % 2 == 0 else 0)
    w = (W.partitionBy(*by) if by else W).orderBy(order)
    return F.avg(value).over(w.rowsBetween(-back, ahead))


def trailing_mean(value: str, order: str, width: int, by=()):
    w = (W.partitionBy(*by) if by else W).orderBy(order)
    return F.avg(value).over(w.rowsBetween(-(width - 1), 0))


def pooled_moments(df: DataFrame, keys, vector="embedding") -> DataFrame:
    """(pos, pooled_sigma, weighted_mean): groups below two rows have no variance; sigma 0 becomes 1."""
    s = long_form(df, keys, vector).groupBy(*keys, "pos").agg(F.var_samp("x").alias("v"), F.count("*").alias("n"), F.avg("x").alias("m"))
    free = F.when(F.col("n") > 1, F.col("n") - 1)
    out = s.groupBy("pos").agg(F.sqrt(F.sum(free * F.col("v")) / F.sum(free)).alias("sigma"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted_mean"))
    return out.select(F.col("pos").cast("int").alias("pos"), F.when(F.coalesce("sigma", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sigma")).alias("pooled_sigma"), "weighted_mean")


def zscore_dimension(df: DataFrame, dim: int, g="genre", t="year", vector="embedding") -> DataFrame:
    """By period: mean over groups of one dimension of their centroids, its z-score and z over standard error."""
    x = df.select(g, t, F.element_at(F.col(vector).cast("array<double>"), dim + 1).alias("x"))
    s = x.groupBy(g, t).agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.var_samp("x").alias("v"))
    free = F.when(F.col("n") > 1, F.col("n") - 1)
    pool = s.agg(F.sqrt(F.sum(free * F.col("v")) / F.sum(free)).alias("sigma"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    by = s.groupBy(t).agg(F.avg("m").alias("mean"), F.sum("n").alias("n"))
    return by.crossJoin(F.broadcast(pool)).select(t, F.col("mean").alias("mean_value"), F.col("n").cast("long").alias("n"), ((F.col("mean") - F.col("mu")) / F.col("sigma")).alias("z"), ((F.col("mean") - F.col("mu")) / (F.col("sigma") / F.sqrt("n"))).alias("z_se"))
