"""Exact deduplication by a 128-bit content hash with byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bloom import possible_rows
from quillon.llm.common import stash, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the row that stays of its group of equal texts.

    Texts are equal when identical after each run of white space became one space; null counts as empty.
    1. The texts' 128-bit hashes are counted; only 16 bytes and an id a row are shuffled.
    2. Only texts whose hash occurs twice can have equals: a Bloom filter and an exact semi join pick
       them, and grouping by hash and bytes compares them, so texts that merely share a hash part. Map
       side combination leaves one row for each text and task, however large a group of copies is.
    3. Rows get their group by hash, and by SHA-256 where a hash stands for several texts; the join's
       rows are narrow and AQE splits a hot group.

    Result, one row per input row: id, keep_id (smallest id of the group, null ids aside), group_size,
    kept (id is keep_id; several rows with that same id are all kept), text_sha256. A null id is returned
    as null and is kept only where the whole group has none. An empty table gives no rows. Other columns
    of the input are not read.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", "norm", F.unhex(F.md5("norm")).alias("h"))
    rows = stash(base.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"))
    repeated = stash(counts.where("n > 1").select("h"), "exact-repeated")
    texts = possible_rows(base, "h", repeated).join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.min("id").alias("keep_id"))
    groups = texts.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", "keep_id")
    out = rows.join(groups, ["h", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)"""
}
