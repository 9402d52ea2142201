"""Tables written into the shared folder, so that lineage is cut and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it again. drop() deletes it."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.kept_at = at
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Between rounds: Spark deletes the files of shuffles that no plan refers to any more when the driver collects garbage."""
    spark._jvm.System.gc()
