"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingles.

DataFrame operations only. A test item is in a document if at least 0.8 of its distinct five-word shingles
are; an item of fewer words is one shingle, found as consecutive words. Items are partitioned by their number of
shingles (powers of two). In a partition of at most m shingles each item is indexed by its floor(m / 5) + 1 smallest
shingle hashes (its bottom-k MinHash): an item that a document contains misses at most a fifth of its shingles, so the
document has one of them at least, and of an item of n shingles all of them but floor(n / 5). Each partition has a
bound, the largest hash it indexes, and a blocked bit filter of its hashes: a document's shingle is looked up only if
some partition's bound is not below it and its filter holds it. The document's length plays no part, so short items are
found inside long documents without loss. Candidates are verified on the shingles' words.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stash, table

WIDTH = 5
MAX_FILTER = 1 << 14  # numbers of 64 bits in a partition's filter
MAX_BROADCAST_ROWS = 1_000_000  # of two numbers: beyond it the index or id list is shuffled


def _words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _hashes(words: str, width: int = WIDTH):
    """Distinct 64-bit hashes of an array column's shingles; empty with fewer words."""
    w = F.col(words)
    one = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width)))
    return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), one))


def _strings(words: str, width: str):
    """Distinct shingles of an array column, as many words each as another column says."""
    w, n = F.col(words), F.col(width)
    return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, n))))


def _may_hold(index: DataFrame):
    """A condition on a hash: is it within the bound of a partition whose filter holds it? A filter has one bit for a hash,
    in at most MAX_FILTER numbers of 64 bits; it stands in the plan. A fuller one lets more hashes through to the join."""
    sizes = {r["top"]: (r["n"], r["bound"]) for r in index.groupBy("top").agg(F.count("*").alias("n"), F.max("h").alias("bound")).collect()}  # 40 partitions at most
    tests = []
    for top, (n, bound) in sorted(sizes.items()):
        words = min(MAX_FILTER, 1 << max(6, (n // 4).bit_length()))
        slot = lambda h, words=words: (F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(words - 1))).cast("int")
        rows = index.where(F.col("top") == top).groupBy(slot(F.col("h")).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).collect()
        bits = [0] * words
        for r in rows:
            bits[r["slot"]] = r["bits"]
        table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")
        tests.append((bound, table, slot))

    def test(h):
        out = F.lit(False)
        for bound, table, slot in tests:
            word = F.get(table, slot(h))
            out = out | ((h <= F.lit(bound)) & (F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1))
        return out

    return test


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """Pairs of documents and test items inside them: id, item id, n_shingles (the item's), n_shared, containment.

    Words are runs of letters and digits, lower-cased, so punctuation, case and line breaks do not hide a
    passage. An item of fewer than five words is found where its words stand one after another (containment 1); items
    without a word, and null or empty texts, match nothing. Rows with the same id count as one document or item, with
    their best containment; null ids are reported as null. Empty tables give no rows; other columns are not read; equal
    names for both id columns are an error.
    """
    if id_col == item_col:
        raise ValueError("documents and items need id columns of different names")
    q = items.select(F.col(item_col).alias("item"), _words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    q = stash(q.select("item", "w", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh")), "items")
    widths = sorted(r[0] for r in q.select("width").distinct().collect())  # 1 to WIDTH
    sets = [q.where(F.col("width") == n).select("item", F.array_sort(_hashes("wh", n)).alias("h")) for n in widths] or [q.select("item", F.array().cast("array<bigint>").alias("h"))]
    all_sets = sets[0]
    for x in sets[1:]:
        all_sets = all_sets.unionByName(x)
    all_sets = all_sets.withColumn("n", F.size("h")).where("n > 0")
    top = F.expr("shiftleft(1L, CAST(floor(log2(n)) + 1 AS INT)) - 1")  # most shingles in the item's partition
    all_sets = all_sets.withColumn("top", top).withColumn("k", F.least(F.floor(F.col("top") / 5) + 1, F.col("n")).cast("int"))
    index = stash(all_sets.select("item", "top", "n", "k", F.explode(F.slice("h", 1, F.col("k"))).alias("h")), "item-index")
    wordy = docs.select(F.col(id_col).alias("id"), F.transform(_words(F.col(text_col)), lambda x: F.xxhash64(x)).alias("w"))
    test = _may_hold(index)
    wanted = F.flatten(F.array(*[F.filter(_hashes("w", n), test) for n in widths])) if widths else F.array().cast("array<bigint>")
    found = wordy.select("id", F.explode(wanted).alias("h")).join(small(index), "h")
    pairs = found.groupBy("id", "item").agg(F.count("*").alias("hits"), F.max("k").alias("k"), F.max("n").alias("n"))
    pairs = stash(pairs.where("hits >= k - floor(n / 5)").select("id", "item"), "contained")

    ids = stash(pairs.select(F.col("id").alias("want")).distinct(), "contained-ids")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(ids), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    some = some.select("id", _words(F.col("text")).alias("dw"))
    known = q.select(F.col("item").alias("known"), "w", "width")
    both = some.join(pairs.select(F.col("id").alias("want"), "item"), F.col("id").eqNullSafe(F.col("want"))).join(known, F.col("item").eqNullSafe(F.col("known")))
    both = both.select("id", "item", _strings("dw", "width").alias("s"), _strings("w", "width").alias("t"))
    shared = both.select("id", "item", F.size("t").alias("n"), F.size(F.array_intersect("s", "t")).alias("m")).where("5 * m >= 4 * n")
    best = shared.groupBy("id", "item").agg(F.max(F.struct(F.col("m") / F.col("n"), "m", "n")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("x.n").cast("long").alias("n_shingles"), F.col("x.m").cast("long").alias("n_shared"), (F.col("x.m") / F.col("x.n")).alias("containment"))


def op5_decontaminate(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op5_decontaminate": r"""
WITH t AS (SELECT doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
a AS (SELECT id, doc, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t), v AS (SELECT DISTINCT least(len(w), 5) AS width FROM a WHERE NOT doc AND len(w) > 0),
w AS (SELECT id, doc, w, width FROM a, v WHERE doc UNION ALL SELECT id, doc, w, least(len(w), 5) FROM a WHERE NOT doc AND len(w) > 0),
s AS (SELECT DISTINCT id, doc, width, array_to_string(w[i:i + width - 1], ' ') AS s FROM (SELECT id, doc, w, width, unnest(range(1, greatest(len(w) - width + 2, 1))) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s WHERE NOT doc GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_shingles, count(*) AS n_shared, count(*) / n.n AS containment
FROM s d JOIN s i ON d.s = i.s AND d.width = i.width AND d.doc AND NOT i.doc JOIN n ON n.id = i.id GROUP BY d.id, i.id, n.n HAVING 5 * count(*) >= 4 * n.n"""
}
