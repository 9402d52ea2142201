"""Language ID and toxicity against plain Python versions; what is held out teaches nothing; edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import exactdedup, langid, linededup, toxicity

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def kept_out(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def grams(text):
    """Features of a text, one n-gram at a time."""
    c = [ord(x) if x.isalpha() else 32 for x in text.lower()]
    odd = [int(x) for x in langid._ODD]
    for n in langid.ORDERS:
        for i in range(len(c) - n + 1):
            if any(chr(x).isalpha() for x in c[i : i + n]):
                h = n
                for k in range(n):
                    h = ((h ^ c[i + k]) * odd[k]) & M
                    h ^= h >> 29
                yield ((h * odd[0]) & M) >> (64 - langid.BITS)


def brute_languages(rows):
    counts, docs = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None and not kept_out(i, 4, 2):
            counts[lang].update(grams(t))
            docs[lang] += 1
    size = {x: sum(c.values()) + langid.SMOOTHING * (1 << langid.BITS) for x, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        sums = {x: math.log(docs[x] / sum(docs.values())) for x in counts}
        for g, n in Counter(grams(t)).items():
            for x in sums:
                sums[x] += n * math.log((counts[x][g] + langid.SMOOTHING) / size[x])
        best = max(sums, key=sums.get)
        out[i] = (best, 1 / sum(math.exp(max(-700, s - sums[best])) for s in sums.values()))
    return out


def test_language_id_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 34", "en"), (-4, "é", None)], docs.schema))
    want = brute_languages([tuple(r) for r in docs.collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train_on(docs)).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], abs_tol=1e-6) for i in want)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumns({"text": F.when(langid.held_out(), F.lit("zzz qqq")).otherwise(F.col("text")), "lang": F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))})
    a, b = langid.train_on(docs), langid.train_on(other)
    assert a.langs == b.langs and np.array_equal(a.logp, b.logp) and np.array_equal(a.prior, b.prior)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x.where(~toxicity.held_out())) for x in (labels, turned))
    assert a.terms == b.terms and np.allclose(a.coef, b.coef)


def brute_measure(text, terms):
    folded, hits, free = toxicity.fold(text or ""), {}, []
    for t, w in terms.items():
        at = folded.find(t)
        while at >= 0:
            hits[at] = max(w, hits.get(at, 0.0))
            at = folded.find(t, at + 1)
    for t in toxicity.EXCEPTIONS:
        key = f" {toxicity.fold(t).strip()} "
        at = folded.find(key)
        while at >= 0:
            free.append((at, at + len(key) - 1))
            at = folded.find(key, at + 1)
    total = sum(w for s, w in hits.items() if not any(a <= s < b for a, b in free))
    return total, total / math.log2(16 + folded.count(" "))


def test_toxicity_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, ""), (-3, "the trash can and TR4SH, y0u ѕcum"), (-4, "pond scum scum"), (-4, "idiot " * 3000), (-5, "not an idiot; an idiot")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"score": F.lit(1), "weight": F.lit(2)})
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    model.terms |= {f" {t} ": toxicity.SEED_WEIGHT for t in toxicity.SEED if f" {t} " not in model.terms}
    got = sorted((r.doc_id, r.weight, r.score) for r in toxicity.score_toxicity(docs, model).collect())
    want = []
    for r in docs.collect():
        total, dense = brute_measure(r.text, model.terms)
        x = model.coef @ [1, math.log1p(total), math.log1p(dense)]
        want.append((r.doc_id, total, 1 / (1 + math.exp(-max(-35, min(35, x))))))
    assert len(got) == len(want) and all(a[0] == b[0] and np.allclose(a[1:], b[1:]) for a, b in zip(got, sorted(want)))
    assert any(w > 0 for _, w, _ in got)


@pytest.mark.parametrize("run", [lambda d: langid.identify(d, None), lambda d: toxicity.score_toxicity(d, toxicity.Model({" idiot ": 3.0})), exactdedup.exact_dedup, linededup.line_dedup])
def test_repeats_clashing_columns_and_very_long_texts(spark, run):
    long = "some words of a long text " * 60_000
    rows = [(1, "a", 1, "x"), (1, "a", 2, "y"), (None, None, 3, "z"), (2, long, 4, "w"), (2, long, 5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, h string").withColumns({c: F.lit(0) for c in ("id", "norm", "kept", "key", "maybe", "lang_pred", "weight", "n_lines", "sha", "drop")})
    got = run(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 2), (True, 0)]
    assert run(docs.where("false")).count() == 0
