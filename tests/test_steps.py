import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import taxonomy
from quillon.sources.npy import Matrix, NpySource
from quillon.streaming import incremental
from quillon.streaming.steps import Chain


def put(spark, folder, rows):
    spark.createDataFrame(rows, "id long, title string").coalesce(1).write.mode("append").parquet(folder)


def test_chain_goes_on_after_a_failure(spark, tmp_path):
    source, calls, broken = f"{tmp_path}/in", [], [True]

    def first(df):
        calls.append("first")
        return df.withColumn("upper", F.upper("title"))

    def second(df):
        calls.append("second")
        if broken[0]:
            return df.withColumn("size", F.raise_error(F.lit("service is away")).cast("int"))
        return df.withColumn("size", F.length("upper"))

    def chain():
        return Chain(spark, source, "id long, title string", "id", [("first", first), ("second", second)], f"{tmp_path}/out", f"{tmp_path}/state")

    put(spark, source, [(1, "a"), (2, "bb"), (2, "b"), (None, "x")])
    with pytest.raises(Exception):
        chain().run()
    assert calls == ["first", "second"] and [tuple(r) for r in chain().progress().collect()] == [("first", 0, 2)]
    broken[0] = False
    chain().run()  # a new object, as after a restart: the first step is not done again
    assert calls == ["first", "second", "second"]
    assert {r.id: (r.title, r.size) for r in chain().results().collect()} == {1: ("a", 1), 2: ("bb", 2)}
    chain().run()
    assert len(calls) == 3  # nothing new
    put(spark, source, [(2, "newer"), (3, "c")])
    chain().run()
    assert {r.id: r.upper for r in chain().results().collect()} == {1: "A", 2: "NEWER", 3: "C"}
    assert {(r.step, r.batch, r.n) for r in chain().progress().collect()} == {("first", 0, 2), ("first", 1, 2), ("second", 0, 2), ("second", 1, 2)}
    with pytest.raises(ValueError):
        Chain(spark, source, "id long", "id", [("a", first), ("a", first)], "x", "y")


def test_incremental_files_and_upsert(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, "a")])
    run = lambda: incremental.process_new_files(spark, f"{tmp_path}/in", "id long, title string", lambda d: d.withColumn("n", F.length("title")), f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    run()
    put(spark, f"{tmp_path}/in", [(2, "bb")])
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a", 1), (2, "bb", 2)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "B"), (3, None)], "id long, v string")
    assert {r.id: r.v for r in incremental.upsert(old, new, "id").collect()} == {1: "a", 2: "B", 3: None}
    assert [r.id for r in incremental.missing_only(new, old, "id").collect()] == [3]


def test_npy_source(spark, tmp_path):
    spark.dataSource.register(NpySource)
    x, ids = np.random.default_rng(1).normal(size=(1003, 7)).astype(np.float32), np.array([f"Q{i}é" for i in range(1003)])
    np.save(tmp_path / "v.npy", x)
    np.save(tmp_path / "i.npy", ids)
    df = spark.read.format("npy").option("path", f"file://{tmp_path}/v.npy").option("ids", str(tmp_path / "i.npy")).option("rows", 100).load()
    assert df.rdd.getNumPartitions() == 11
    got = {r.id: r.embedding for r in df.collect()}
    assert len(got) == 1003 and all(np.array_equal(np.float32(got[i]), v) for i, v in zip(ids, x))
    np.save(tmp_path / "d.npy", x[:5].astype(float))
    plain = spark.read.format("npy").option("path", str(tmp_path / "d.npy")).load()
    assert [r.id for r in plain.orderBy("id").collect()] == list("01234") and plain.schema["embedding"].dataType.elementType.simpleString() == "double"
    np.save(tmp_path / "none.npy", x[:0])
    assert spark.read.format("npy").option("path", str(tmp_path / "none.npy")).load().count() == 0
    with pytest.raises(Exception, match="vectors for"):
        spark.read.format("npy").option("path", str(tmp_path / "d.npy")).option("ids", str(tmp_path / "i.npy")).load().collect()
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    for bad in ("f.npy", "o.npy"):
        with pytest.raises(ValueError):
            Matrix(str(tmp_path / bad))
    (tmp_path / "x.npy").write_bytes(b"text")
    with pytest.raises(ValueError):
        Matrix(str(tmp_path / "x.npy"))


def test_best_ancestor(spark):
    edges = [("animal", "root"), ("plant", "root"), ("dog", "animal"), ("cat", "animal"), ("rose", "plant"), ("puppy", "dog"), ("dog", "pet"), ("pet", "root"), ("loop", "puppy"), ("puppy", "loop"), (None, "x")]
    e = spark.createDataFrame(edges, "child string, parent string")
    assert {r.node for r in taxonomy.level(e, 1).collect()} == {"animal", "plant", "pet"}
    words = spark.createDataFrame([("hund", "puppy", 0), ("hund", "rose", 1), ("blume", "rose", 0), ("nix", "nowhere", 0), ("tier", "animal", 0), (None, "dog", 0)], "word string, node string, rank int")
    got = {r.word: (r.ancestor, r.steps) for r in taxonomy.best_ancestor(words, e, 1).collect()}
    assert got == {"hund": ("animal", 2), "blume": ("plant", 1), "tier": ("animal", 0)}
    stop = spark.createDataFrame([("animal",), ("pet",)], "node string")
    assert {r.word: r.ancestor for r in taxonomy.best_ancestor(words, e, 1, stop).collect()} == {"hund": "plant", "blume": "plant"}


def test_vocabulary(spark):
    w = spark.createDataFrame([("time", 6.0), ("time", 5.0), ("running", 6.0), ("ab", 7.0), ("two words", 7.0), ("thing", 6.5), ("rare", 1.0), ("apple", 6.0)], "word string, zipf double")
    stop = spark.createDataFrame([("thing",), (None,)], "word string")
    got = taxonomy.vocabulary(w, "zipf", 2.0, stop, ["ing"], 5).collect()
    assert [tuple(r) for r in got] == [(1, "apple", 6.0), (2, "time", 6.0)]


def test_text_helpers(spark):
    rows = [("http://www.wikidata.org/entity/Q42", "3600, 5400 ,x,", "nan", "a" * 130, "Drama film, drama,, Horror"), (None, None, None, None, None), ("no id", "", " ", "short", " , ")]
    r = spark.createDataFrame(rows, "u string, m string, v string, n string, g string").select(
        X.entity_id(F.col("u")).alias("u"), X.minutes(F.col("m")).alias("m"), X.missing_to_null(F.col("v")).alias("v"), X.short_name(F.col("n")).alias("n"), X.genre_tokens(F.col("g")).alias("g")).collect()
    assert (r[0].u, r[0].m, r[0].v, r[0].g) == ("Q42", [60, 90, None], None, ["drama", "drama", "horror"])
    assert len(r[0].n) == 120 and r[0].n.startswith("a" * 110 + "__")
    assert tuple(r[1]) == (None, None, None, None, None) and (r[2].u, r[2].m, r[2].v, r[2].n, r[2].g) == (None, [], None, "short", [])
