"""Resumable chains of steps over files that keep coming.

A stream takes every new file of a folder once. Each batch runs through the steps in order; a step reads what the step
before wrote for that batch and writes its own folder, <target>/<step>/batch=<n>. A batch that is run again, after a
failure or a lost driver, skips the steps whose folder is complete and overwrites the others, so nothing is done twice
and nothing is added twice. results() gives one row an id: that of its latest batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = tuple[str, Callable[[DataFrame], DataFrame]]


class Chain:
    """steps: (name, function of a DataFrame that keeps the id). files: how many new files make a batch."""

    def __init__(self, spark: SparkSession, source: str, schema: StructType | str, id_col: str, steps: Sequence[Step], target: str, state: str, files: int = 100):
        if len({n for n, _ in steps}) < len(steps) or not steps:
            raise ValueError("steps need names of their own")
        self.spark, self.source, self.schema, self.id_col, self.steps = spark, source, schema, id_col, list(steps)
        self.target, self.state, self.files = target.rstrip("/"), state, files

    def _complete(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batch(self, rows: DataFrame, n: int) -> None:
        """Rows without an id are left out; of rows with one id in a batch one stays, that of the largest values."""
        fields = [c for c in rows.columns if c != self.id_col]
        rows = rows.where(F.col(self.id_col).isNotNull()).groupBy(self.id_col).agg(F.max(F.struct(*fields)).alias("x")).select(self.id_col, "x.*")
        for name, step in self.steps:
            folder = f"{self.target}/{name}/batch={n}"
            if not self._complete(folder):
                step(rows).write.mode("overwrite").parquet(folder)
            rows = self.spark.read.parquet(folder)

    def run(self) -> None:
        """Works off all files that no finished batch has seen, then stops. A step's error is raised; the next run goes on
        with the same batch."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.source)
        stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.state).trigger(availableNow=True).start().awaitTermination()

    def results(self, name: str | None = None) -> DataFrame:
        """The rows of a step (the last one): of each id those of its latest batch."""
        rows = self.spark.read.parquet(f"{self.target}/{name or self.steps[-1][0]}")
        fields = [c for c in rows.columns if c not in (self.id_col, "batch")]
        return rows.groupBy(self.id_col).agg(F.max_by(F.struct(*fields), "batch").alias("x")).select(self.id_col, "x.*")

    def progress(self) -> DataFrame:
        """(step, batch, n): rows that each step has written."""
        out = None
        for name, _ in self.steps:
            if not self._any(f"{self.target}/{name}"):
                continue
            one = self.spark.read.parquet(f"{self.target}/{name}").groupBy(F.lit(name).alias("step"), "batch").agg(F.count("*").alias("n"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "step string, batch int, n long")

    def _any(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
        return len(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0
