"""Line deduplication with two Bloom filters (once seen, twice seen) and exact confirmation of suspects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bloom import Blocked, OnceTwice, might_hold
from quillon.llm.common import LOWER, SPACE, UPPER, ascii_lower, lean, stash, table

MIN_POINTS, MIN_DOCS = 40, 5
SALTS = 8
LOWERED = str.maketrans(UPPER, LOWER)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def repeated_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_points=MIN_POINTS, min_docs=MIN_DOCS, log2_bits=26, k=3) -> tuple[DataFrame, DataFrame]:
    """(suspects: id, key; confirmed: key, last_id). Each task builds its two filters from the hashes of its
    documents' distinct keys; merged, the second marks keys that at least two documents may hold. Only those
    keys are shuffled, counted exactly (with map-side combination) and given the largest id that holds them.
    The filters have 2**log2_bits bits at any input size."""
    spark = docs.sparkSession
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(text_col)), _key), lambda x: F.length(x) >= min_points))
    held = docs.select(F.col(id_col).alias("id"), F.explode(keys).alias("key"))
    filters = OnceTwice(log2_bits, k)

    def partial(batches):
        state = filters.start()
        for b in batches:
            filters.add(state, b.column(0).to_numpy(zero_copy_only=False))
        yield from filters.rows(state)

    twice = spark.sparkContext.broadcast(filters.merge(held.select(F.xxhash64("key").alias("h")).mapInArrow(lean(partial), OnceTwice.SCHEMA)))

    @F.pandas_udf("boolean")
    def seen_twice(h: pd.Series) -> pd.Series:
        return pd.Series(filters.hits(twice.value, h.to_numpy(np.int64)))

    suspects = stash(held.where(seen_twice(F.xxhash64("key"))), "line-suspects")
    twice.unpersist()
    counted = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
    return suspects, stash(counted.where(F.col("n") >= min_docs).select("key", "last_id"), "line-confirmed")


def line_dedup(docs: DataFrame, id_col="doc_id", text_col="text", min_points=MIN_POINTS, min_docs=MIN_DOCS, log2_bits=26, keep=()) -> DataFrame:
    """Each document with its repeated lines dropped: id, text, the columns in `keep`, n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    `min_points` code points found in at least `min_docs` documents lose all their lines except in the
    largest id that holds them; other lines stay, joined by line feeds. Only documents that hold such a
    line are shuffled with their texts.

    A null or empty text is one empty line and comes back empty. Rows are documents: rows with the same
    id count apart, and a line stays in all rows of the largest id. A null id is below all others. An
    empty table gives no rows. Other columns of the input are not read.
    """
    suspects, confirmed = repeated_lines(docs, id_col, text_col, min_points, min_docs, log2_bits)
    # a line that a third of all documents hold is dealt to SALTS tasks
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = salted.join(copies, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("last_id"))).groupBy("id").agg(F.collect_set("key").alias("drop"))
    drops = stash(drops, "line-drops")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    more = [f"kept_{i}" for i in range(len(keep))]
    probe = might_hold(docs.sparkSession, Blocked.build(drops.select(F.xxhash64("id").alias("h")), "h"))
    marked = rows.withColumn("maybe", probe(F.xxhash64("id")))
    touched = marked.where("maybe").join(drops.withColumnRenamed("id", "drop_id"), F.col("id").eqNullSafe(F.col("drop_id")), "left")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def without(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, drop):
            lines, gone = text.split("\n"), set(() if gone is None else gone)
            kept = [x for x in lines if x.strip(SPACE).translate(LOWERED) not in gone] if gone else lines
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    touched = touched.select("id", *more, without("text", "drop").alias("x")).select("id", "x.text", *more, "x.n_lines", "x.n_dropped")
    rest = marked.where("NOT maybe").select("id", "text", *more, F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return touched.unionByName(rest).select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
