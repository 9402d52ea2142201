"""Running totals over a whole table in order, without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.kept import keep


def running(df: DataFrame, order: list, sums: Mapping[str, Column]) -> DataFrame:
    """The rows with the running total of each of `sums` in the given order (its own row included), and the total of
    all rows as <name>_total.

    Rows are dealt to ranges of the order; each range adds up by itself and gets the ranges' totals before it, one row
    a range. Rows that are equal in the order follow by their place as read, so that many equal ones need not stand in one
    range. The ranges are written into the shared folder, as both passes must see the same ones."""
    order = [F.col(o) if isinstance(o, str) else o for o in order] + [F.col("__read")]
    rows = df.withColumns(dict(sums)).withColumn("__read", F.monotonically_increasing_id())
    rows = keep(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("__range").agg(*[F.sum(n).alias(f"__{n}") for n in sums])
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}_off") for n in sums], *[F.sum(f"__{n}").over(W.partitionBy()).alias(f"{n}_total") for n in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(n).over(inside) for n in sums}).join(F.broadcast(offsets), "__range")  # one row a range
    return out.withColumns({n: F.col(n) + F.col(f"__{n}_off") for n in sums}).drop("__range", "__read", *[f"__{n}_off" for n in sums])
