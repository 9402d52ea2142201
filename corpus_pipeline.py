"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, langid, linededup, ngramjoin
from quillon.llm.bloom import drop_rows
from quillon.llm.common import stash, table, unstash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (`und`: null, empty or without words) go. A missing lang becomes the predicted one;
    all else stays as it is. Repeated ids are judged row by row; an empty table stays empty."""
    found = langid.identify(docs, langid.train_on(docs), keep=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars is counted again. No document goes; a null text becomes empty."""
    out = linededup.line_dedup(docs, keep=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays, in all rows of that id. Rows
    without an id stay, as do empty and null texts."""
    found = ngramjoin.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return drop_rows(docs.select(*COLUMNS), "doc_id", stash(found, "near-copies"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. DataFrame operations only. Rows without an id stay."""
    found = decontam.contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.select(*COLUMNS).join(decontam.small(stash(found, "contaminated")), "doc_id", "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; a null text is an empty one."""
    return bpe.bpe_digests(docs, bpe.tokenizer_path(bpe.TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe", bpe_encoding),
]

#: Naive Bayes and BPE have no SQL form; tests/llm/test_pipeline.py holds the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            unstash(last)
        last = docs
    return docs
