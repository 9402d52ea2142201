import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import decontam


def shingles(text, width):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            w = [x for x in re.split(r"[^\w]+|_", (item or "").lower()) if x]
            if not w:
                continue
            have = shingles(item, min(len(w), 5))
            got = len(have & shingles(text, min(len(w), 5)))
            if 5 * got >= 4 * len(have):
                key = (d, i)
                out[key] = max(out.get(key, (0, 0, 0)), (got / len(have), got, len(have)))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randrange(120))) for i in range(60)] + [(None, None), (3, ""), (3, text(40))]
    items = [(i, text(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9, 17, 40]))) for i in range(70)] + [(None, "w1, W2!"), (None, "w3 w4"), (5, None)]
    for k in range(40):  # passages, some with a word changed
        i, t = rnd.choice(items[:70])
        at = rnd.randrange(len(docs) - 3)
        w = (t or "").split()
        if w and rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = "other"
        docs[at] = (docs[at][0], (docs[at][1] or "") + " \n" + " ".join(w).upper() + "! " + text(5))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("w", "h", "item", "width", "n", "want", "id")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("w", "h", "k", "top", "known")})
    got = {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_shingles) for r in decontam.contained_items(d, q).collect()}
    assert got == brute(docs, items) and len(got) > 60


def test_short_item_in_a_very_long_document_and_edges(spark):
    words = [f"v{i}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "日本語"), (3, "v8 v7")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "v7 V8."), (2, "日本語"), (3, "..."), (4, " ".join(words[150_000:150_003]))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_shingles) for r in decontam.contained_items(docs, items).collect()) == [(1, 1, 1), (1, 4, 1), (2, 2, 1)]
    with pytest.raises(ValueError):
        decontam.contained_items(docs, docs, item_col="doc_id")
    assert decontam.contained_items(docs, items.where("item_id = 3")).count() == 0 and decontam.contained_items(docs.where("false"), items).count() == 0


def test_filter_passes_every_indexed_hash(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 3, 7, 63]), rnd.getrandbits(64) - (1 << 63)) for _ in range(3000)]
    index = spark.createDataFrame(rows, "top long, h long")
    test = decontam._may_hold(index)
    assert index.where(test(F.col("h"))).count() == 3000
    others = spark.createDataFrame([(rnd.getrandbits(64) - (1 << 63),) for _ in range(3000)], "h long")
    assert others.where(test(F.col("h"))).count() < 1200
    assert others.where(decontam._may_hold(index.where("false"))(F.col("h"))).count() == 0
