import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, decontam, exactdedup, langid, licenses, linededup, ngramjoin, tokenstore, toxicity, urlfilter
from quillon.llm.queries import QUERIES, SQL
from tests.oracle import compare

LINE = "this line is long enough to be counted as repeated"
DOCS = [(1, None), (2, ""), (3, "A b  c"), (4, "a b c"), (5, "a b c"), (6, "été 日本 <|endoftext|> 'll\t\n x"), (7, "w " * 3000), (None, "null id"), (8, LINE + "\nx"), (9, " " + LINE), (10, LINE.upper()), (11, LINE), (12, LINE), (12, LINE), (13, "mit license")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in DOCS], "doc_id long, text string, lang string, n int, h int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ok, why = compare(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name])
    assert ok, why


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect():
        want = [x for i, x in DOCS if i == r.doc_id]
        assert r.text == (want[0] or "")
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids
    assert bpe.bpe_encode(empty, path).count() == 0


def test_token_store(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder = tokenstore.write_store(docs, path)
    got, at = sorted(tokenstore.read_digests(spark, folder).collect(), key=lambda r: r.start), 0
    assert len(got) == len(DOCS) and [r.id for r in got][:2] == [None, 1]
    whole = {r.id: r.ids for r in tokenstore.reconstruct(spark, folder).collect()}
    for r in got:
        ids = t.encode([x for i, x in DOCS if i == r.id][0] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[r.id] == ids
        at += len(ids)
    assert tokenstore.read_digests(spark, tokenstore.write_store(empty, path)).count() == 0


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exactdedup.exact_dedup(docs).collect()}
    assert (got[5].keep_id, got[5].group_size, got[5].kept) == (4, 2, False) and got[2].keep_id == 1 and got[3].kept
    assert got[1].text_sha256 == hashlib.sha256(b"").hexdigest() and got[None].keep_id is None
    assert exactdedup.exact_dedup(empty).count() == 0


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    assert (got[8].text, got[8].n_lines, got[8].n_dropped) == ("x", 2, 1)
    assert got[11].text == "" and got[12].text == LINE and got[12].n_dropped == 0 and got[1].n_lines == 1
    assert linededup.line_dedup(empty).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.EXAMPLE.com/en/x?q"), (2, "https://www.example.com/en/"), (3, None), (4, "no scheme"), (5, "http://b.net/fr/"), (6, "http://bad.org/p/"), (7, "http://org")], "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    listed = spark.createDataFrame([("bad.org/p",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules, listed).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][3] == "block" and got[6][3] == "block" and got[7][3] == "allow"
    assert urlfilter.filter_urls(pages.where("false"), rules, listed.where("false")).count() == 0


def test_language_id(spark, docs, empty):
    model = langid.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 20)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0 and 0 < got[8].score <= 1
    near = spark.createDataFrame([(1, "the dog"), (2, "la souris")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(near, model).collect()} == {1: "en", 2: "fr"}
    assert langid.train(empty) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_decontamination(spark, docs, empty):
    words = [f"w{i}" for i in range(5000)]
    some = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:8])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[4000:4040]).upper() + "!"), (8, "w1 w2"), (9, None), (10, " ".join(words[100:110] + ["z"] * 9))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in decontam.contained_items(some, items).collect()) == [(1, 7, 1.0), (1, 8, 1.0), (2, 8, 1.0)]
    assert decontam.contained_items(empty, items).count() == 0 and decontam.contained_items(docs, items.where("false")).count() == 0


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[13].n_base, got[13].first_word, got[13].base_labels) == (1, 0, "mit") and got[1].labels == "" and got[1].score == 0
    assert len(licenses.rules()) > 300


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, empty):
    rng = np.random.default_rng(3)
    base, rows = [f"t{i}" for i in rng.integers(0, 10**6, 80)], [(0, None), (1, ""), (2, "one two"), (3, "ONE  two")]
    for i in range(4, 90):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 5)):
            w[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_toxicity(spark, docs, empty):
    model = toxicity.train(docs, docs.select("doc_id").limit(0).selectExpr("doc_id", "1 AS toxic"))
    d = spark.createDataFrame([(1, "you 1d10t"), (2, "ok"), (3, None), (4, "the trash can"), (5, "уоu аre sсum")], "doc_id long, text string")
    got = {r.doc_id: r.weight for r in toxicity.score_toxicity(d, model).collect()}
    assert got[1] > 0 and got[5] > 0 and got[2] == got[3] == got[4] == 0
    assert toxicity.score_toxicity(empty, model).count() == 0
