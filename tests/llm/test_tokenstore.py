"""The token store: where recipes go, and what is held against what was written."""

import hashlib
import shutil

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import tokenstore

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} " + "w " * (i * 40)) for i in range(60)] + [(None, "x"), (None, "x"), (3, None), (3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_recipes_have_the_same_keys_in_each_run(spark, docs):
    """In another order of a partition's rows too."""
    keys = []
    for rows in (docs.coalesce(1), docs.coalesce(1), docs.coalesce(1).sortWithinPartitions("text")):
        folder = tokenstore.write_store(rows, PATH)
        keys.append(sorted(bytes(r.key) for r in spark.read.parquet(f"{folder}/chunks").where("kind = 'recipe'").select("key").collect()))
    assert len(keys[0]) == 64 and keys[0] == keys[1] == keys[2]


def test_a_lost_recipe_is_noticed(docs, monkeypatch):
    n = docs.count()
    monkeypatch.setattr(type(docs), "count", lambda self: n + 1)
    with pytest.raises(ValueError, match="recipes"):
        tokenstore.write_store(docs, PATH)


def test_fold_is_merkle():
    hashes, tree = [], tokenstore.Fold()
    for i in range(70):
        assert tree.root() == tokenstore.merkle(hashes)
        hashes.append(hashlib.blake2b(bytes([i]), digest_size=16).digest())
        tree.add(hashes[-1])


@pytest.fixture(scope="module")
def store(docs):
    return tokenstore.write_store(docs, PATH)


def changed(spark, store, tmp_path, name, change):
    """A copy of the store with one of its tables changed."""
    at = str(tmp_path / "store")
    shutil.copytree(store.removeprefix("file://"), at)
    shutil.rmtree(f"{at}/{name}")
    change(spark.read.parquet(f"{store}/{name}")).write.parquet(f"{at}/{name}")
    return at


REPLACED = ["hashes", "sizes", "root", "n_tokens"]
RECIPES = {
    "missing": lambda d: d.where("id IS NULL OR id <> 7"),
    "doubled": lambda d: d.union(d.where("id = 7")),
    "replaced": lambda d: d.where("id IS NULL OR id <> 7").unionByName(d.where("id = 7").select("id", "row", "start", "shard").crossJoin(d.where("id = 9").select(*REPLACED))),
    "all missing": lambda d: d.where("false"),
    "renamed": lambda d: d.withColumn("id", F.when(F.col("id") == 7, 99).otherwise(F.col("id"))),
}


@pytest.mark.parametrize("what", RECIPES)
@pytest.mark.parametrize("read", [tokenstore.read_digests, tokenstore.reconstruct])
def test_changed_recipes_are_noticed(spark, store, tmp_path, what, read):
    at = changed(spark, store, tmp_path, "recipes", RECIPES[what])
    with pytest.raises(ValueError, match="manifest"):
        read(spark, at)


def test_reconstruct_notices_missing_and_damaged_chunks(spark, store, tmp_path):
    assert tokenstore.reconstruct(spark, store, spark.createDataFrame([(7,), (3,)], "id long")).count() == 4
    for i, change in enumerate([lambda d: d.where("kind = 'recipe'").withColumn("payload", F.col("payload")), lambda d: d.withColumn("payload", F.max("payload").over(tokenstore.W.partitionBy("kind")))]):
        at = changed(spark, store, tmp_path / str(i), "chunks", change)
        with pytest.raises(Exception, match="missing|damaged"):
            tokenstore.reconstruct(spark, at).collect()
