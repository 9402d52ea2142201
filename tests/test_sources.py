import numpy as np
import pytest
from pyspark.errors import PythonException

from quillon.operators import quality, relational, stats
from quillon.sources import files


def npy(folder, year, method, ids, vectors):
    np.save(f"{folder}/movie_embeddings_{year}{method}.npy", np.array(vectors, dtype="float32"))
    np.save(f"{folder}/movie_ids_{year}{method}.npy", np.array(ids))


def test_vectors_of_years_and_method(spark, tmp_path):
    npy(tmp_path, 1950, "_cls", ["Q1", "Q2"], [[1, 0], [0, 1]])
    npy(tmp_path, 1952, "_cls", ["Q1"], [[3, 4]])
    npy(tmp_path, 1952, "_mean", ["Q9"], [[9, 9]])
    npy(tmp_path, 1960, "_cls", ["Q3"], [[5, 5]])
    v = files.read_vectors(spark, str(tmp_path), "_cls", 1950, 1955)
    assert sorted((r.movie_id, r.year, tuple(r.embedding)) for r in v.collect()) == [("Q1", 1950, (1, 0)), ("Q1", 1952, (3, 4)), ("Q2", 1950, (0, 1))]
    assert {r.movie_id: tuple(r.embedding) for r in files.latest_vectors(v).collect()} == {"Q1": (3, 4), "Q2": (0, 1)}


def test_unequal_counts_raise(spark, tmp_path):
    npy(tmp_path, 1950, "", ["Q1"], [[1, 0], [0, 1]])
    with pytest.raises(PythonException, match="2 vectors for 1 ids"):
        files.read_vectors(spark, str(tmp_path), "", 1950, 1950).collect()


def test_sparse_weights(spark, tmp_path):
    lists = lambda rows: np.array([np.array(r) for r in rows] + [None], dtype=object)[:-1]
    np.savez(tmp_path / "s.npz", token_indices=lists([[3, 5], [7]]), weights=lists([[0.5, 0.25], [1.0]]), movie_ids=np.array(["Q1", "Q2"]))
    got = {r.movie_id: r.weights for r in files.read_sparse_npz(spark, str(tmp_path / "s.npz"), trusted=True).collect()}
    assert got == {"Q1": {3: 0.5, 5: 0.25}, "Q2": {7: 1.0}}
    with pytest.raises(PythonException):
        files.read_sparse_npz(spark, str(tmp_path / "s.npz")).collect()


def test_csv_years_missing_files_and_sinks(spark, tmp_path):
    (tmp_path / "wikidata_movies_1950.csv").write_text('movie_id,plot\nQ1,"two\nlines, ""quoted"""\n')
    (tmp_path / "wikidata_movies_1960_to_1969.csv").write_text("movie_id,plot\nQ2,\n")
    got = {(r.movie_id, r.year, r.plot) for r in files.read_years(spark, f"{tmp_path}/wikidata_movies_*.csv", "movie_id string, plot string").collect()}
    assert got == {("Q1", 1950, 'two\nlines, "quoted"'), ("Q2", 1960, None)}
    none = files.read_csv_or_empty(spark, f"{tmp_path}/none.csv", "movie_id string, plot string")
    assert none.columns == ["movie_id", "plot"] and none.count() == 0
    files.write_csv(spark.createDataFrame([("Q1", 1)], "movie_id string, more int"), f"{tmp_path}/out", ["movie_id", "title"])
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/out", "movie_id string, title string").collect()] == [("Q1", None)]


def test_checked_sink_and_kept_results(spark, tmp_path):
    bad = spark.createDataFrame([("a", [1.0, float("nan")])], "movie_id string, embedding array<double>")
    with pytest.raises(ValueError, match="non_finite"):
        files.write_vectors(bad, f"{tmp_path}/bad")
    good = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "movie_id string, embedding array<double>")
    files.write_vectors(good, f"{tmp_path}/good", dim=2)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2
    runs = []
    build = lambda df: (runs.append(1), df.groupBy().count())[1]
    kept = lambda df, **p: files.cached_result(df, p, f"{tmp_path}/kept", build).first()[0]
    assert [kept(good, k=1), kept(good.orderBy("movie_id", ascending=False), k=1), kept(good, k=2), kept(good.limit(1), k=1)] == [2, 2, 2, 1]
    assert len(runs) == 3


def test_new_measures_on_nothing_ties_and_single_rows(spark):
    no = spark.createDataFrame([], "x double, id int, n int")
    assert stats.bin_extremes(no, "id", "x", "n", 1.0).count() == 0
    assert stats.triangle_threshold(no, "x", 8).first().threshold is None
    tied = spark.createDataFrame([(0.1, 2, 5), (0.2, 1, 5), (1.0, 3, 9), (None, 4, 1)], "x double, id int, n int")
    assert sorted(map(tuple, stats.bin_extremes(tied, "id", "x", "n", 1.0).collect())) == [(0, 2, 1, 1), (1, 1, 3, 3)]
    e = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0])], "g int, embedding array<double>")
    assert tuple(quality.silhouette(e, "g").first()) == (3, 2, pytest.approx(2 / 3))
    assert tuple(quality.silhouette(e.where("g = 0"), "g").first()) == (2, 1, 0.0)
    assert tuple(stats.peak(spark.createDataFrame([(2.0, 0.5), (1.0, 0.5), (3.0, 0.1)], "x double, density double")).first()) == (1.0, 0.5)
    n = spark.createDataFrame([(1, [("a", "u"), ("b", "v")]), (2, None)], "k int, items array<struct<v: string, c: string>>")
    assert sorted(map(tuple, relational.nested_rows(n, "items", ["k"], "c", "u", [(9, "z", "u")]).collect())) == [(1, "a", "u"), (9, "z", "u")]
