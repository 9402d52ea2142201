"""Incremental runs: only new rows are processed, by a stream that stops when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_only(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values where present, else the old ones; rows of both sides stay."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols])


def process_new_files(spark: SparkSession, source: str, schema, transform, target: str, state: str) -> None:
    """Every Parquet file under `source` that no earlier run has seen goes through `transform` into `target`."""
    stream = spark.readStream.schema(schema).parquet(source)
    transform(stream).writeStream.format("parquet").option("checkpointLocation", state).option("path", target).trigger(availableNow=True).start().awaitTermination()
