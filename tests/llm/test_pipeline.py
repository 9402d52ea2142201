"""The pipeline, the n-gram join and the token store's segments against brute-force versions."""

import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import bpe, ngramjoin, tokenstore
from tests.llm.test_llm import brute_components

SF, SPACE = "/root/testdata/sf0.001", " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(docs):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    held = defaultdict(set)
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in docs.items()}


def shingles(text):
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_pipeline(docs, items):
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    docs = brute_lines(docs)
    docs = {i: docs[i] for i, (_, first) in brute_components(docs.items()).items() if i == first}
    sets = [s for s in map(shingles, items) if s]
    docs = {i: t for i, t in docs.items() if not any(5 * len(s & mine) >= 4 * len(s) for mine in [shingles(t)] for s in sets)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for i, x in docs.items():
        ids = t.encode(x, add_special_tokens=False).ids
        sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    want = brute_pipeline(docs, items)
    assert got == want and 0 < len(want) < len(docs)


@pytest.mark.parametrize("name", ["documents.parquet", "empty"])
def test_stages_return_the_columns_of_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.where("false") if name == "empty" else docs.limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("limits", [{}, {"TILE": 3, "PARTNERS": 1, "FIRST_SHARE": 64, "FIRST_SHORT": 0}])
def test_ngram_join_across_components(spark, monkeypatch, limits):
    """Chains of near copies that share a passage with other chains: the later rounds must find every link, in small
    tiles and with few partners a round too."""
    for name, value in limits.items():
        monkeypatch.setattr(ngramjoin, name, value)
    rng, rows, i = np.random.default_rng(11), [], 0
    passage = [f"p{k}" for k in range(30)]
    for _ in range(12):
        w = [f"t{k}" for k in rng.integers(0, 10**6, 60)] + passage
        for _ in range(25):
            rows.append((i, " ".join(w)))
            w[int(rng.integers(0, 60))], i = f"x{rng.integers(0, 10**6)}", i + 1
    rng.shuffle(rows := [tuple(r) for r in rows])
    rows = [(int(a), str(b)) for a, b in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_word_segments_encode_as_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokenstore.library_coder(open(path, encoding="utf-8").read())
    coder.limit = 500
    assert coder.cut is tokenstore.word_segments
    t, rng = Tokenizer.from_file(path), random.Random(1)
    bits = ["A", "h", "H", "T", "̱", "̌", "̇", "I", " ", "  ", "\n", "\t", "'s", "'ll", "'", "’", ".", "!", "<", ">", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "日", "1", "22", "　", "̸", "İ", "don't", "ﬁ", "Σ", "the", "</w>", "\x00", "\x85"]
    for r in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(60)]
        texts = [x.replace("<|", "") for x in texts] if r % 2 else texts
        raw = [x.encode() for x in texts]
        ids, n = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        for x, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_other_tokenizers_get_whole_texts():
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert not tokenstore.splits_words(spec)
    word = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert tokenstore.splits_words(word)
    assert not tokenstore.splits_words(word | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "StripAccents"}]}})
    t, text = Tokenizer.from_str(json.dumps(spec)), "Two  words\n"
    assert tokenstore.library_coder(json.dumps(spec)).encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist() == t.encode(text).ids


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_and_alike_words_encode_as_the_library(name, monkeypatch):
    """Words that a hash of positional sums cannot tell apart, words without a break, and a hash that long segments share."""
    path = public_tokenizers.path(name)
    spec, t = open(path, encoding="utf-8").read(), Tokenizer.from_file(path)
    other = str.maketrans("ab", "ba")
    words = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n).translate(other))] + ["-" * 5000, "xyzw" * 50_000, "a" * 10_000]

    def ids(coder, texts):
        raw = [x.encode() for x in texts]
        flat, n = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]

    make = (lambda: bpe.SegmentTable(bpe.Coder(bpe.Automaton(spec)).pieces)) if name.startswith("byte") else lambda: tokenstore.library_coder(spec)
    coder = make()
    for w in words:
        assert ids(coder, [w]) == [t.encode(w, add_special_tokens=False).ids]
    real = bpe.piece_hashes
    monkeypatch.setattr(bpe, "piece_hashes", lambda data, starts, ends: np.where(ends - starts > 8, np.uint64(7), real(data, starts, ends)))
    some = ["one two-three four", "five hundredandmore words", "one hundredandless", "", "words hundredandless hundredandmost"]
    assert ids(make(), some) == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_the_automaton_has_the_transitions_of_the_merges():
    m = bpe.Merges(json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()))
    a, rng, labels = bpe.Automaton(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()), random.Random(2), sorted(m.alive.values())
    for x, y in [*m.pair][:20_000] + [(rng.choice(labels), rng.choice(labels)) for _ in range(50_000)]:
        s, c = a.state[x], a.column[y]
        lost = any(a.low[k] <= c < a.high[k] for k in range(a.begin[s], a.begin[s + 1]))
        assert lost != m.follows(x, y, 1 << 30)
