"""Pooling of ordered token vectors (key, pos from 0, vector) into one vector a key."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import mean_vectors, unit, vector_sums


def mean_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, n, raw, embedding): the mean of a key's vectors and its unit vector; a zero mean stays zero."""
    return mean_vectors(df, [key], vector, "raw").select(key, "n", "raw", unit(F.col("raw")).alias("embedding"))


def late_windows(df: DataFrame, key: str, pos: str, size: int, stride: int, vector: str = "embedding") -> DataFrame:
    """(key, window, n, embedding): the unit mean of each window of `size` positions, one every `stride` (the size, where
    that is 0 or less), up to the first window that reaches the end; the last one may be short. Windows without a vector
    are left out, as are rows without a position or vector.

    Positions are added up in blocks that divide both numbers, then blocks to windows: a sequence may be longer than any
    task, and a vector is copied to no window."""
    if size < 1:
        raise ValueError("a window has at least one position")
    stride = stride if stride > 0 else size
    g = gcd(size, stride)
    rows = df.where(F.col(pos).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(vector).alias("v"))
    blocks = vector_sums(rows.withColumn("block", F.floor(F.col("pos") / g)), ["key", "block"], "v")
    length = rows.groupBy("key").agg((F.max("pos") + 1).alias("length")).withColumnRenamed("key", "__k")
    b = blocks.join(length, F.col("key").eqNullSafe(F.col("__k"))).drop("__k")
    at, n = F.col("block") * g, F.col("length")
    last = F.least(F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)), F.ceil(n / F.lit(stride)) - 1)
    first, upto = F.greatest(F.floor((at - size) / F.lit(stride)) + 1, F.lit(0)), F.least(F.floor(at / F.lit(stride)), last)
    spread = b.where(first <= upto).select("key", "n", "total", F.explode(F.sequence(first, upto)).alias("window"))
    sums = vector_sums(spread, ["key", "window"], "total").select("key", "window", "total")
    sizes = spread.groupBy(F.col("key").alias("__k"), F.col("window").alias("__w")).agg(F.sum("n").alias("n"))
    both = sums.join(sizes, F.col("key").eqNullSafe(F.col("__k")) & (F.col("window") == F.col("__w")))
    return both.select(F.col("key").alias(key), "window", "n", unit(F.col("total")).alias("embedding"))


def late_chunks(df: DataFrame, key: str, pos: str, size: int = 512, stride: int = 256, vector: str = "embedding") -> DataFrame:
    """(key, windows, raw, embedding): the mean of a key's window vectors and its unit vector. A sequence that fits one
    window is that window."""
    w = late_windows(df, key, pos, size, stride, vector)
    return mean_vectors(w, [key], "embedding", "raw").select(key, F.col("n").alias("windows"), "raw", unit(F.col("raw")).alias("embedding"))
