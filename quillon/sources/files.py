"""Readers and writers of the formats in use: CSV, TSV, JSON, Parquet and .npy matrices."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Quoted, multi-line cells; all columns by an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def read_years(spark: SparkSession, path_glob: str, schema, pattern: str = r"_(\d{4})[^/]*\.csv$") -> DataFrame:
    """Files by year: the first year in a file's name becomes the column `year`."""
    return read_csv(spark, path_glob, schema).withColumn("year", F.regexp_extract(F.input_file_name(), pattern, 1).cast("int"))


def read_tsv(spark, path, schema):
    return read_csv(spark, path, schema, "\t")


def read_json(spark, path, schema):
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_npy_pairs(spark: SparkSession, vectors: str, ids: str) -> DataFrame:
    """(movie_id, year, embedding) from aligned .npy files (same stem order); a file pair with unequal counts raises. The
    year is the first one in the file's name. Files are read by Spark on the executors, one pair a row."""
    key = F.regexp_extract("path", r"_(\d{4}[^/]*)\.npy$", 1)
    v = spark.read.format("binaryFile").load(vectors).select(key.alias("key"), F.col("content").alias("v"))
    i = spark.read.format("binaryFile").load(ids).select(key.alias("key"), F.col("content").alias("i"))

    def run(frames):
        for f in frames:
            for key, v, i in zip(f["key"], f["v"], f["i"]):
                x, names = np.load(io.BytesIO(v)), np.load(io.BytesIO(i), allow_pickle=False)
                if len(x) != len(names):
                    raise ValueError(f"{len(x)} vectors for {len(names)} ids")
                yield pd.DataFrame({"movie_id": names.astype(str), "year": int(key[:4]), "embedding": list(x.astype(np.float32))})

    return v.join(i, "key").select("key", "v", "i").mapInPandas(run, "movie_id string, year int, embedding array<float>")


def read_vectors(spark: SparkSession, folder: str, method: str, first: int, last: int) -> DataFrame:
    """The vectors of a range of years made by one method; years without files are skipped, and no file at all raises."""
    years = "{" + ",".join(map(str, range(first, last + 1))) + "}"
    return read_npy_pairs(spark, f"{folder}/movie_embeddings_{years}{method}.npy", f"{folder}/movie_ids_{years}{method}.npy")


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """One row an id: (movie_id, embedding) of its last year."""
    return vectors.groupBy("movie_id").agg(F.max_by("embedding", "year").alias("embedding"))


def read_sparse_npz(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """(movie_id, weights map<int, float>) from .npz files with token_indices, weights and movie_ids. Ragged arrays are
    pickled in such files, and pickles can run code: they are read only where the files are said to be trusted."""

    def run(frames):
        for f in frames:
            for content in f["content"]:
                x = np.load(io.BytesIO(content), allow_pickle=trusted)
                lists = [dict(zip(map(int, t), map(float, w))) for t, w in zip(x["token_indices"], x["weights"])]
                if len(lists) != len(x["movie_ids"]):
                    raise ValueError(f"{len(lists)} weight lists for {len(x['movie_ids'])} ids")
                yield pd.DataFrame({"movie_id": x["movie_ids"].astype(str), "weights": lists})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "movie_id string, weights map<int, float>")


def read_csv_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file, or an empty table of the schema where there is none."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", dim: int | None = None) -> None:
    """Parquet, after a check of the vectors: a null, empty, wrongly sized or non-finite one raises and nothing is written."""
    faults = {k: n for k, n in embedding_faults(df, vector, dim).first().asDict().items() if k != "n" and n}
    if faults:
        raise ValueError(f"vectors not written: {faults}")
    df.write.mode("overwrite").parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's columns, row count and rows in any order."""
    rows = df.select(F.xxhash64(*sorted(df.columns)).alias("h"))
    f = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)} {f.n} {f.x} {int(f.s)}".encode()).hexdigest()


def cached_result(df: DataFrame, params: dict, folder: str, build) -> DataFrame:
    """`build(df)` from the table kept in the folder for this input and these parameters, written there the first time.
    Changed rows or parameters give another key; an unfinished table cannot be read and is written again."""
    key = hashlib.sha256((fingerprint(df) + json.dumps(params, sort_keys=True, default=str)).encode()).hexdigest()
    at, spark = f"{folder}/{key}", df.sparkSession
    try:
        return spark.read.parquet(at)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_years(df: DataFrame, path: str, text: str | None = None) -> None:
    """Parquet by year; only the years present are overwritten."""
    from quillon.functions.text import clean_text

    out = df.withColumn(text, clean_text(F.col(text))) if text else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A fixed field list; missing fields are empty, extra ones ignored."""
    df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("header", True).csv(path)


def embedding_faults(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """Counts of null, empty, wrongly sized and non-finite vectors."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("null_vectors"), F.count_if(F.size(v) == 0).alias("empty"), F.count_if(F.size(v) != dim if dim else F.lit(False)).alias("wrong_size"), F.count_if(bad).alias("non_finite"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids found on one side alone: both counts are 0 where the tables are aligned."""
    j = a.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1)).join(b.select(F.col(key).alias("k")).distinct().withColumn("b", F.lit(1)), "k", "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))
