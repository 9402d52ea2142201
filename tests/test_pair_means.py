import math

import numpy as np
import pytest

from quillon.functions import vectors as V
from quillon.operators import quality, similarity
from pyspark.sql import functions as F

ROWS = [(1, 0, [0.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 1, [-1.0, 0.0]), (5, 1, [0.0, 0.0]), (6, 2, [0.0, 3.0]), (7, None, [1.0, 1.0]), (8, None, [2.0, 0.5]), (9, 3, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, g int, embedding array<double>")


def cosines(vectors):
    """Cosines of all pairs of different rows; a zero vector's are 0."""
    u = [np.array(v) / (np.linalg.norm(v) or 1) for v in vectors]
    return [float(a @ b) for i, a in enumerate(u) for b in u[i + 1 :]]


def groups(null=False):
    out = {}
    for _, g, v in ROWS:
        if v is not None and (g is not None or null):
            out.setdefault(g, []).append(v)
    return out


def test_within_and_cosine_stats(rows):
    got = {r.g: r.mean_distance for r in similarity.within_distance(rows, "g").collect()}
    for g, v in groups(null=True).items():
        c = cosines(v)
        assert got[g] == pytest.approx(1 - np.mean(c) if c else 0.0), g
    assert got[0] == 1.0
    stats = {r.key: r for r in similarity.cosine_stats(rows.where("embedding IS NOT NULL AND g IS NOT NULL"), "g").collect()}
    assert set(stats) == {"0", "1"}
    for g in (0, 1):
        c = cosines(groups()[g])
        r = stats[str(g)]
        assert (r.n_pairs, r.mean_cosine, r.var_cosine) == (len(c), pytest.approx(np.mean(c)), pytest.approx(np.var(c)))


def test_means_of_means(rows):
    r = quality.mean_of_means_distance(rows.where("g IS NOT NULL"), "g").first()
    means = [np.mean(v, 0) for v in groups().values()]
    assert (r.n, r.mean_distance) == (3, pytest.approx(1 - np.mean(cosines(means))))
    zeros = rows.where("id IN (1, 2)").withColumn("g", F.col("id"))
    assert quality.mean_of_means_distance(zeros, "g").first().mean_distance == 1.0


def test_separation_leaves_null_classes_out(rows):
    r = quality.separation(rows, "g").first()
    g = groups()
    intra = [c for v in g.values() for c in cosines(v)]
    every = [c for c in cosines([x for v in g.values() for x in v])]
    inter = (sum(every) - sum(intra)) / (len(every) - len(intra))
    assert (r.intra, r.inter) == (pytest.approx(np.mean(intra)), pytest.approx(inter))
    assert r.ratio is None  # intra is not above 0
    one = quality.separation(rows.where("g = 0 OR g IS NULL"), "g").first()
    assert (one.intra, one.inter) == (0.0, None)
    assert quality.separation(rows.where("false"), "g").count() <= 1


def test_sums_by_partials(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 3))
    k = rnd.integers(0, 40, 500)
    df = spark.createDataFrame([(int(g) if g else None, f"s{g % 3}", v.tolist()) for g, v in zip(k, x)], "a long, b string, embedding array<double>").repartition(7)
    got = {(r.a, r.b): r for r in V.vector_sums(df, ["a", "b"]).collect()}
    for g in set(k.tolist()):
        r = got[(g or None, f"s{g % 3}")]
        assert r.n == (k == g).sum() and np.allclose(r.total, x[k == g].sum(0)) and math.isclose(r.own, (x[k == g] ** 2).sum())
    assert V.vector_sums(df.where("false"), ["a"]).count() == 0 and V.vector_sums(df.where("false"), []).count() == 0
    assert V.vector_sums(df, []).first().n == 500
    mixed = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        V.vector_sums(mixed, []).collect()


def test_hoeffding_bounds(spark):
    low, high = quality.hoeffding_bounds(F.col("m"), F.col("n"))
    got = spark.createDataFrame([(0.9, 10), (0.5, 100_000), (None, 0)], "m double, n long").select(low.alias("l"), high.alias("h")).collect()
    e = math.sqrt(-math.log(0.025) / 20)
    assert (got[0].l, got[0].h) == (pytest.approx(0.9 - e), 1.0) and got[1].h - got[1].l < 0.01
