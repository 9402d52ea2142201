import hashlib
import math
import zlib

import pytest

from quillon.llm import sharding as S


def draw(key, label, w):
    return -math.log((int(hashlib.md5(f"{key}/{label}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w


def shard(key, tree):
    """Descent by brute force over the tree's nodes."""
    tree = [x for x in tree if x[3] > 0]
    for level in range(3):
        names = {}
        for x in tree:
            names.setdefault("/".join(map(str, x[: level + 1])), []).append(x)
        best = min(names, key=lambda n: draw(key, n, sum(x[3] for x in names[n])))
        tree = names[best]
    return tree[0][2]


def test_against_brute_force_and_slots(spark):
    rows = [(i, f"text é {i}", i) for i in range(3000)] + [(5, None, 1), (5, None, 1), (None, "", 2), (7, "x" * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").withColumnRenamed("slot", "shard")
    got = S.shard_documents(docs, S.even_tree(16), S.even_tree(17)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (shard(key, S.even_tree(16)), shard(key, S.even_tree(17)))
        assert r.grown_shard in (r.shard, 16)
    texts = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == texts
    for s in range(16):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in mine]
        assert ids == sorted(ids)
    share = sum(r.grown_shard == 16 for r in got) / len(got)
    assert abs(share - 1 / 17) < 0.02


def test_weights_and_confined_movement(spark):
    tree = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 2.0), ("b", "z", 3, 2.0), ("b", "z", 4, 0.0)]
    more = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 4.0), ("b", "z", 3, 2.0), ("b", "z", 4, 0.0)]
    ids = spark.range(8000)
    got = ids.select("id", S.shard_of(ids.id, tree).alias("s"), S.shard_of(ids.id, more).alias("t")).collect()
    counts = [sum(r.s == k for r in got) / len(got) for k in range(5)]
    assert all(abs(c - w / 8) < 0.02 for c, w in zip(counts, (1, 3, 2, 2, 0)))
    moved = {(r.s, r.t) for r in got if r.s != r.t}
    assert all((s, t) in moved for s, t in ((0, 2), (1, 2))) and not any(t == 3 for _, t in moved)  # none enters the region whose weight stays
    assert all(r.t == shard(str(r.id), more) for r in got[:500])


def test_bad_trees():
    with pytest.raises(ValueError):
        S._children([("a", "b", 0, 0.0)])
    with pytest.raises(ValueError):
        S._children([("a", "b", 0, 1.0), ("c", "d", 0, 1.0)])


def test_written_shards_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    S.write_shards(docs, S.even_tree(16), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.doc_id, r.text, r.shard) for r in back} == {(i, f"t{i}", shard(str(i), S.even_tree(16))) for i in range(200)}
    assert all(r.rack == f"k{r.shard // 4}" for r in back)
    assert S.shard_documents(docs.where("false"), S.even_tree(16)).count() == 0
    with pytest.raises(ValueError):
        S.write_shards(docs.withColumnRenamed("text", "rack"), S.even_tree(16), f"{tmp_path}/no")
