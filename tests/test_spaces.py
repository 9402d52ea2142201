import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import classify, concepts, gaussian, linalg, pooling, similarity
from quillon.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, x, **more):
    rows = [(i, v.tolist(), *(c[i] for c in more.values())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>" + "".join(f", {c} {'array<string>' if isinstance(v[0], list) else 'long'}" for c, v in more.items()))


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def test_chi_square():
    for d in (1, 2, 3, 7, 64, 1024):
        p = np.array([1e-6, 0.01, 0.2, 0.5, 0.975, 0.999999])
        x = special.chi2_quantile(p, d)
        assert np.allclose(1 - special.chi2_tail(x, d), p, atol=1e-12)
    x = np.array([0.0, 0.3, 1.0, 5.0, 60.0])
    assert np.allclose(special.chi2_tail(x, 1), [math.erfc(math.sqrt(v / 2)) for v in x], atol=1e-13)
    assert np.allclose(special.chi2_tail(x, 4), np.exp(-x / 2) * (1 + x / 2), atol=1e-13)
    assert special.chi2_quantile(np.array([0.0, 1.0]), 3).tolist() == [0.0, math.inf] and np.isnan(special.chi2_quantile(np.array([np.nan]), 3)[0])
    assert special.chi2_quantile(np.array([0.95]), 10)[0] == pytest.approx(18.307038053275143, abs=1e-9)


def test_columns_of_chi_square(spark):
    df = spark.createDataFrame([(0.95, 18.307038053275143), (None, None)], "p double, x double")
    a, b = df.select(special.chi2_at(F.col("p"), 10).alias("q"), special.chi2_p_value(F.col("x"), 10).alias("t")).collect()
    assert (a.q, a.t) == (pytest.approx(18.307038053275143), pytest.approx(0.05)) and tuple(b) == (None, None)


def test_kth_smallest(spark):
    x = np.r_[np.full(3000, 0.5), np.random.default_rng(1).normal(size=4001)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    for k in (1, 700, 3500, 4000, 7001):
        assert gaussian.kth_smallest(df, "x", k) == gaussian.kth_smallest(df, "x", k, hold=50) == np.sort(x)[k - 1]
    with pytest.raises(ValueError):
        gaussian.kth_smallest(df, "x", 0)


def concentrated(x, h, starts):
    """Least covariance determinant by the same steps in NumPy."""
    import hashlib

    n, d = x.shape
    fit = lambda y: (y.mean(0), np.cov(y.T, ddof=0))
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        q = dist(m, c)
        return fit(x[q <= np.sort(q)[h - 1] * (1 + 1e-12)])

    best = []
    for s in range(starts):
        keep = np.array([s == 0 or int(hashlib.md5(f"{i}-{s}-42".encode()).hexdigest()[:8], 16) / 2**32 < h / n for i in range(n)])
        now = fit(x[keep])
        for _ in range(2):
            now = step(*now)
        best.append((np.linalg.slogdet(now[1])[1], s, now))
    volume, _, now = min(best, key=lambda b: b[:2])
    for _ in range(30):
        then = step(*now)
        v = np.linalg.slogdet(then[1])[1]
        if not v < volume - 1e-9:
            break
        volume, now = v, then
    q = dist(*now)
    q = q / (np.median(q) / special.chi2_quantile(np.array([0.5]), d)[0])
    return fit(x[q < special.chi2_quantile(np.array([0.975]), d)[0]])


def test_robust_covariance_and_record(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(301, 4)) @ np.diag([1, 2, 0.5, 1]) + 3
    x[:40] += [30, -20, 10, 5]
    df = frame(spark, x).withColumn("d2", F.lit("clash"))
    mean, cov = gaussian.robust_covariance(df, "id")
    h = math.ceil(gaussian.support_share(301) * 301)
    want = concentrated(x, h, 3)
    assert np.allclose(mean, want[0]) and np.allclose(cov, want[1])
    assert np.abs(mean - 3).max() < 0.5  # the outliers do not pull it
    d2 = {r.id: r.d2 for r in gaussian.mahalanobis(df, "id").collect()}
    q = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0))
    assert np.allclose([d2[i] for i in range(301)], q)
    rows = {r.alpha: r for r in gaussian.gaussianity(df, "id", alphas=(0.01, 0.05)).collect()}
    edge = special.chi2_quantile(np.array([0.95]), 4)[0]
    r = rows[0.05]
    assert (r.outliers, r.threshold, r.n, r.d) == ((q > edge).sum(), pytest.approx(edge), 301, 4)
    assert r.representativeness == pytest.approx(1 - min(1, abs(q.mean() - 4) / 4)) and r.std_d2 == pytest.approx(q.std()) and r.first10 == pytest.approx(1.0) and not r.likely
    plain = gaussian.gaussianity(df, "id", robust=False).first()
    assert plain.mean_d2 == pytest.approx(4 * 300 / 301)


def test_quantile_pairs(spark, table):
    x, _ = table
    got = sorted(gaussian.chi2_pairs(gaussian.mahalanobis(frame(spark, x), "id", robust=False), "id", 64).collect(), key=lambda r: r.rn)
    c = x - x.mean(0)
    q = np.sort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T)), c))
    assert np.allclose([r.observed for r in got], q)
    assert np.allclose([r.theoretical for r in got], special.chi2_quantile(np.linspace(0.01, 0.99, len(x)), 64))
    w, v = np.linalg.eigh(np.cov(x.T))
    got = gaussian.component_pairs(frame(spark, x), "id", 2, principal=True).collect()
    for k in (0, 1):
        y = c @ v[:, ::-1][:, k]
        y = np.sort(y / y.std())
        mine = [r.observed for r in sorted((r for r in got if r.component == k), key=lambda r: r.rn)]
        assert np.allclose(mine, y) or np.allclose(mine, -y[::-1])


def test_cosine_spectrum(spark):
    x = np.random.default_rng(2).normal(size=(40, 6)) + 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    w = np.linalg.eigvalsh(np.cov((c - c.mean()).T))[::-1]
    got = gaussian.cosine_spectrum(frame(spark, x), 10).collect()
    assert np.allclose([r.eigenvalue for r in got], np.maximum(w[:10], 0), atol=1e-12) and len(got) == 10
    assert np.allclose([r.cumulative for r in got], np.cumsum(w[:10]) / w.sum())
    i, j = np.triu_indices(40, 1)
    r = gaussian.cosine_report(frame(spark, x), "id").first()
    angles = np.arccos(c[i, j])
    assert (r.mean_angle, r.std_angle, r.mean_cosine, r.var_cosine) == tuple(pytest.approx(v) for v in (angles.mean(), angles.std(), c[i, j].mean(), c[i, j].var()))
    assert r.first10 == pytest.approx(1.0) and r["first"] == pytest.approx(w[0] / w.sum())
    assert gaussian.cosine_spectrum(frame(spark, x[:1])).count() == 0 and gaussian.rayleigh(frame(spark, x[:1]).where("false")).count() == 0


def test_concepts(spark):
    rnd = np.random.default_rng(8)
    words = rnd.normal(size=(700, 5))
    words[50] = words[10]
    space = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(words)], "idx long, word string, vec array<double>")
    q = rnd.normal(size=(90, 5))
    q[3], q[4] = 0, words[10]
    got = concepts.search(space, frame(spark, q), "id", 7).collect()
    s = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ (words / np.linalg.norm(words, axis=1, keepdims=True)).T
    for i in range(90):
        mine = sorted((r for r in got if r.id == i), key=lambda r: r.rank)
        want = [] if i == 3 else sorted(range(700), key=lambda k: (-round(s[i, k], 12), k))[:7]
        assert [r.idx for r in mine] == want and [r.rank for r in mine] == list(range(1, len(want) + 1))
    assert [r.idx for r in sorted((r for r in got if r.id == 4), key=lambda r: r.rank)][:2] == [10, 50]
    assert concepts.search(space, frame(spark, q).where("false"), "id", 3).count() == 0
    with pytest.raises(ValueError, match="components"):
        concepts.search(space, frame(spark, q[:, :3]), "id", 3)
    lemmas = spark.createDataFrame([("a", "c1", 2.0), ("a", "x", 1.0), ("a", "lost", 1.0), ("b", "x", 5.0), (None, "c2", 1.0), ("c", None, 1.0)], "key string, word string, weight double")
    vectors = spark.createDataFrame([("x", q[0].tolist())], "word string, vec array<double>")
    near = max(range(700), key=lambda k: s[0, k])
    out = {(r.key, r.word): (r.rank, r.score) for r in concepts.map_lemmas(lemmas, space, vectors, "key").collect()}
    assert out == {("a", "c1"): (1, 0.5), ("a", f"c{near}"): (2, 0.25), ("b", f"c{near}"): (1, 1.0), (None, "c2"): (1, 1.0)}
    assert concepts.relevant(space, frame(spark, np.zeros((2, 5)))).count() == 0


def test_concept_projection(spark):
    rnd = np.random.default_rng(3)
    words, x = rnd.normal(size=(60, 4)), rnd.normal(size=(200, 4)) * [3, 2, 1, 0.5] + 1
    space = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(words)], "idx long, word string, vec array<double>")
    got = concepts.project(space, frame(spark, x), 2, k=20, each=6).collect()
    m = x.mean(0)
    top = np.argsort(-(words / np.linalg.norm(words, axis=1, keepdims=True)) @ (m / np.linalg.norm(m)))[:20]
    axes = linalg.eigen(np.cov(x.T))[1][:, :2]
    for d in (0, 1):
        y = words[top] @ axes[:, d]
        for positive, order in ((True, np.argsort(-y)), (False, np.argsort(y))):
            mine = sorted((r for r in got if r.dimension == d and r.positive == positive), key=lambda r: r.rank)
            assert [r.word for r in mine] == [f"c{top[i]}" for i in order[:3]] and np.allclose([r.projection for r in mine], y[order[:3]])


@pytest.mark.parametrize("size,stride", [(8, 4), (8, 3), (5, 0), (4, 7), (100, 50), (1, 1)])
def test_late_chunks(spark, size, stride):
    rnd = np.random.default_rng(size)
    seqs = {k: rnd.normal(size=(n, 3)) for k, n in ((1, 1), (2, 8), (3, 9), (4, 47), (None, 20))}
    rows = [(k, i, v.tolist()) for k, x in seqs.items() for i, v in enumerate(x)] + [(9, 0, None)]
    got = {r.k: r for r in pooling.late_chunks(spark.createDataFrame(rows, "k long, pos long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("block", F.lit("x")), "k", "pos", size, stride).collect()}
    step = stride if stride > 0 else size
    unit = lambda v: v / np.linalg.norm(v)
    assert set(got) == set(seqs)
    for k, x in seqs.items():
        windows, start = [], 0
        while start < len(x):
            windows.append(unit(x[start : start + size].mean(0)))
            if start + size >= len(x):
                break
            start += step
        raw = np.mean(windows, 0)
        assert got[k].windows == len(windows) and np.allclose(got[k].raw, raw) and np.allclose(got[k].embedding, unit(raw))


def test_classifier_against_newton(spark, table):
    x, y = table
    labels = [[f"g{v}", f"m{v % 3}"] for v in y]
    df = frame(spark, x, labels=labels)
    names = classify.label_names(df, "labels")
    w = classify.fit(df, "labels", names)
    z = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.ones(x.shape[1]), 0]
    for k, name in enumerate(names):
        t = np.array([name in v for v in labels], float)
        p = 1 / (1 + np.exp(-z @ w[k]))
        assert np.abs(z.T @ (p - t) + ridge * w[k]).max() < 1e-7  # the slope is 0 at the fit
    train = np.array([r.t for r in df.select("id", classify.in_training(F.col("id")).alias("t")).orderBy("id").collect()])
    w = classify.fit(df.where(classify.in_training(F.col("id"))), "labels", names)
    hits = [{names[k] for k in np.flatnonzero(v > 0)} for v in (z @ w.T)[~train]]
    truth = [set(v) for v, t in zip(labels, train) if not t]
    r = classify.evaluate(df, "id", "labels").first()
    assert (r.n_train, r.n) == (train.sum(), (~train).sum())
    assert r.subset_accuracy == pytest.approx(np.mean([a == b for a, b in zip(hits, truth)]))
    assert r.micro_f1 == pytest.approx(2 * sum(len(a & b) for a, b in zip(hits, truth)) / sum(len(a) + len(b) for a, b in zip(hits, truth)))


def test_classifier_edges(spark):
    x = np.random.default_rng(1).normal(size=(30, 2))
    df = frame(spark, x, labels=[["all", "pos"] if v[0] > 0 else ["all"] for v in x])
    w = classify.fit(df, "labels", ["all", "none", "pos"])
    assert w[0].tolist() == [0, 0, 30] and w[1].tolist() == [0, 0, -30]
    out = classify.predict(df.unionByName(spark.createDataFrame([(99, None, None)], df.schema)), w, ["all", "none", "pos"])
    assert {r.id: r.predicted for r in out.collect()}[99] is None
    assert classify.evaluate(df.where("false"), "id", "labels").first().micro_f1 is None


def test_novelty_under_skew(spark):
    """Half of the rows at one time, ties, a first time: against all pairs."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(400, 6))
    x[5] = 0
    t = np.r_[np.full(200, 5), rnd.integers(0, 12, 200)]
    df = spark.createDataFrame([(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, t))] + [(999, [1.0] * 6, None), (998, None, 3)], "id long, embedding array<double>, year long")
    got = {r.id: r.novelty for r in similarity.novelty(df, "id", "year").collect()}
    u = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    c = np.where(t[None] < t[:, None], u @ u.T, -np.inf).max(1)
    assert got == {i: pytest.approx(1 - c[i], abs=1e-9) for i in range(400) if np.isfinite(c[i])}


def test_principal_quantities(spark, table):
    """The queries without SQL against NumPy."""
    x, y = table
    got = {n: QUERIES[n](spark, SF).collect() for n in ("pca_explained", "mahalanobis_outliers", "whitened_spread", "debiased_mean_distance", "kmeans_sizes")}
    c = x - x.mean(0)
    w, v = np.linalg.eigh(np.cov(x.T))
    w, v = w[::-1], v[:, ::-1]
    assert np.allclose([r.eigenvalue for r in got["pca_explained"]], w, atol=1e-6) and np.allclose([r.cumulative for r in got["pca_explained"]], np.cumsum(w) / w.sum(), atol=1e-6)
    d2 = np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T)), c)
    assert np.allclose([r.d2 for r in sorted(got["mahalanobis_outliers"], key=lambda r: r.vec_id)], d2, atol=1e-5)
    assert np.allclose([r.variance for r in got["whitened_spread"]], 1, atol=1e-5)
    z = c - c @ v[:, :3] @ v[:, :3].T
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for r in got["debiased_mean_distance"]:
        m = z[y == r.label]
        s = m @ m.T
        assert r.mean_distance == pytest.approx(1 - s[np.triu_indices(len(m), 1)].mean(), abs=1e-5)
    assert sum(r.n for r in got["kmeans_sizes"]) == len(x) and len(got["kmeans_sizes"]) == 10


def test_spectra_by_year(spark):
    movies = spark.sql("SELECT 1").sparkSession  # the film view, by the same joins as the query
    from quillon.plans.queries import movies as film_view

    rows = film_view(movies, SF).select("year", "embedding").collect()
    for r in QUERIES["spectral_by_year"](spark, SF).collect():
        x = np.array([m.embedding for m in rows if m.year == int(r.key)], float)
        s = np.linalg.svd(x - x.mean(0), compute_uv=False)
        assert (r.n, r.frobenius, r.spectral) == (len(x), pytest.approx(np.sqrt((s**2).sum()), abs=1e-5), pytest.approx(s[0], abs=1e-5))
        assert r.pve == pytest.approx(s[0] ** 2 / (s**2).sum(), abs=1e-5) and r.n95 == int((np.cumsum(s**2) / (s**2).sum() < 0.95).sum()) + 1


def test_lemma_scores_are_divided_once(spark):
    """25 of 640 words are 0.0390625, whatever the order in which they are added up."""
    space = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "idx long, word string, vec array<double>")
    vectors = spark.createDataFrame([], "word string, vec array<double>")
    counts = [3, 25, 41, 67, 201]
    rows = [(n, "a", 1) for n in counts for _ in range(n)] + [(n, "b", 640 - n) for n in counts]
    got = concepts.map_lemmas(spark.createDataFrame(rows, "key long, word string, weight long"), space, vectors, "key").where("word = 'a'")
    assert {r.key: r.score for r in got.collect()} == {n: n / 640 for n in counts}


def test_lemma_weights_are_made_once_and_shuffled_once(spark):
    """The words are counted in one pass and without a shuffle, and what is left is one shuffle by key."""
    rows = [(1, ["a", "b", "a", None]), (2, []), (3, None), (1, ["b"]), (None, ["c"])]
    df = spark.createDataFrame(rows, "key long, w array<string>")
    weights = concepts.hashed_lemmas(df, "key", "w", 7)
    code = {t: "w" + str(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 7) for t in "abc"}
    want = [(k, code[t], ts.count(t)) for k, ts in rows if ts for t in set(ts) - {None}]
    assert len(set(code.values())) == 3 and sorted(map(repr, map(tuple, weights.collect()))) == sorted(map(repr, want))
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    space = spark.createDataFrame([(i, f"w{i}", [1.0, float(i)]) for i in (0, 3, 6)], "idx long, word string, vec array<double>")
    vectors = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(7)], "word string, vec array<double>")
    out = concepts.map_lemmas(weights.mapInArrow(counted, weights.schema), space, vectors, "key")
    assert {r.key for r in out.collect()} == {1, None} and read.value == len(want)
