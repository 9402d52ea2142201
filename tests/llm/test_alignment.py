import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import alignment as A
from quillon.llm.bpe import byte_letters

TEXTS = [
    "The quick brown fox doesn't jump; it's 12345 tokens.", "The quick brown fox", "", None, " ", "  ", "a ", " a", "\n", "a\n\n b\r\n\tc\r", "x\r \r y", "été naïve ﬁ Å Å", "日本語 テスト　です。", "emoji 👩‍👩‍👧 🇩🇪!",
    "a▁b plain", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00nul\x00", "tab\tand\x0bvt\x0cff\x85nel\xa0nbsp em", "    def f(x):\n        return x  \n", "w " * 5000, "unbroken" * 3000, " " * 3000, "1 22 333 4444 " * 50, "The quick brown fox", "ünïcödé́ combining",
]


def brute(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    a_bytes = {i: bytes(letters[c] for c in w) for w, i in t.get_vocab(with_added_tokens=False).items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
    docs, holds = [], Counter()
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x)) if x else ([], [])
        raw = (" " + (x or "")).encode()
        if not x or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            docs.append(([], Counter()))
            continue
        ea, eb, at = [], [], 0
        for i in a:
            at += len(a_bytes[i])
            ea.append(at)
        at = 0
        for i in b:
            at += len(b_bytes[i])
            eb.append(at)
        both, groups = sorted(set(ea) & set(eb)), []
        low = 0
        for e in both:
            groups.append(([i for i, z in zip(a, ea) if low < z <= e], [i for i, z in zip(b, eb) if low < z <= e]))
            low = e
        links = Counter((p, q) for u, v in groups for p in u for q in v)
        holds.update(links.keys())
        docs.append((groups, links))
    top = Counter()
    for (p, _), n in holds.items():
        top[p] = max(top[p], n)
    out = []
    for groups, links in docs:
        said = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in groups)
        out.append((sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), sum(links.values()), sum(k for (p, q), k in links.items() if holds[p, q] == top[p]), sum(k * holds[x] for x, k in links.items()), said))
    return out


def run(df, **more):
    return A.align_tokenizers(df, public_tokenizers.path(A.BYTE_LEVEL), public_tokenizers.path(A.PIECES), **more)


def test_against_whole_texts(spark):
    short = [t if t is None or len(t) < 8000 else t[:8000] for t in TEXTS]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(short)], "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("seg", F.lit("clash"))
    got = {r.doc_id or 0: tuple(r)[1:] for r in run(df.repartition(3)).collect()}
    joined = {r.doc_id or 0: tuple(r)[1:] for r in run(df.repartition(3), most_pairs=10).collect()}  # counts joined, not broadcast
    for i, want in enumerate(brute(short)):
        assert got[i] == joined[i] == want, short[i]


def test_packed_numbers_and_dictionary():
    for x in ([], [0], [255, 256, 1], [70_000, 3, 1 << 24]):
        assert A._unpacked(A._packed(np.array(x, np.int64))).tolist() == x
    known, text = A.Dictionary(), np.frombuffer(b" ab cd ab x cd", np.uint8)
    cuts = np.array([0, 3, 6, 9, 11, 14])
    assert known.look_up(text, cuts[:-1], cuts[1:]).tolist()[0] == known.look_up(text, cuts[2:3], cuts[3:4]).tolist()[0]
    assert len(known.length) == 3


def test_codes():
    groups = [[([1, 2], [3])], None, [([70_000], [5, 6]), ([1], [2])], [([9] * 90, [8] * 80), ([4], [4])]]
    seg = A.Aligned([A._code(g) for g in groups])
    assert seg.ok.tolist() == [True, False, True, True]
    assert seg.texts() == [";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in g or []) for g in groups]
    for i, g in enumerate(groups):
        want = Counter(p << 32 | q for u, v in g or [] for p in u for q in v)
        got = Counter()
        for p, t in zip(seg.pair[seg.seg == i].tolist(), seg.times[seg.seg == i].tolist()):
            got[p] += t
        assert got == want and seg.sizes["n_links"][i] == want.total()


def test_repeated_ids_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "word, " * 900_000)], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in run(df).collect())
    assert got[0] == got[1] and got[2][1] >= 1_800_000
    assert run(df.where("false")).count() == 0


def test_query_digest_over_whole_table(spark):
    """The query against whole-text encoding of the small table, all documents counted."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]))}
    got = A.op11_alignment(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        *numbers, said = want[r.doc_id]
        assert tuple(r)[1:] == (*numbers, hashlib.sha256(said.encode()).hexdigest() if said else "")


def test_tokenizers_that_may_merge_across_are_refused(monkeypatch):
    with open(public_tokenizers.path(A.BYTE_LEVEL), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path(A.PIECES), "rb") as f:
        model = f.read()
    with pytest.raises(ValueError):
        A.Pair(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), model)
    monkeypatch.setattr(A.re, "search", lambda *a: True)
    with pytest.raises(ValueError):
        A.Pair(spec, model)
