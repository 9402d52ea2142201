"""Gaussian fits of vector collections: robust covariance, Gaussianity record, quantile pairs, cosine spectra."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.kept import drop, keep
from quillon.functions.ordered import running
from quillon.functions.special import chi2_at, chi2_p_value, chi2_quantile
from quillon.functions.vectors import gram
from quillon.operators import linalg
from quillon.operators.blocks import build, cosines, scan
from quillon.operators.similarity import cosine_stats, resultant_length
from quillon.operators.stats import inverse_normal

HOLD = 1_000_000  # numbers that the driver sorts itself
STEPS = 30  # concentration steps, at most


def kth_smallest(df: DataFrame, column: str, k: int, hold: int = HOLD) -> float:
    """The k-th smallest number of a column, exactly. A band around it is found from approximate percentiles and narrowed
    until it has at most `hold` rows or one value; only that band comes to the driver."""
    rows, kept = df.select(F.col(column).alias("x")).where("x IS NOT NULL"), []
    n = rows.count()
    if not 1 <= k <= n:
        raise ValueError(f"there is no {k}-th of {n} values")
    while n > hold:
        if not kept:
            rows = keep(rows, "selection")
            kept.append(rows)
        p, e = k / n, max(0.0005, 2 / n)
        low, high = rows.agg(F.percentile_approx("x", [max(0.0, p - e), min(1.0, p + e)], 10_000)).first()[0]
        below, inside = rows.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
        if low == high and below < k <= below + inside:
            n, rows = 0, None
            break
        if not below < k <= below + inside or inside == n:  # not in the band, or it does not shrink: halve the range
            low, high = rows.agg(F.min("x"), F.max("x")).first()
            middle = low + (high - low) / 2
            under = rows.where(F.col("x") <= middle).count()
            rows, k, n = (rows.where(F.col("x") <= middle), k, under) if k <= under else (rows.where(F.col("x") > middle), k - under, n - under)
            if low == high:
                rows = None
                break
            continue
        rows, k, n = rows.where(F.col("x").between(low, high)), k - below, inside
    out = low if rows is None else float(np.partition(rows.toArrow()["x"].to_numpy(), k - 1)[k - 1])
    drop(*kept)
    return out


def squared_distances(df: DataFrame, mean: np.ndarray, cov: np.ndarray, vector: str = "embedding", out: str = "d2") -> DataFrame:
    """Rows with their squared Mahalanobis distance; directions without variance are left out (pseudo-inverse)."""
    w, v = linalg.eigen(cov)
    real = w > w.max() * 1e-12 if len(w) and w.max() > 0 else np.zeros(len(w), bool)
    y = linalg.apply_affine(df, mean, v[:, real] / np.sqrt(w[real]), vector, out="__y")
    return y.withColumn(out, F.aggregate("__y", F.lit(0.0), lambda s, x: s + x * x)).drop("__y")


def _fit(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance over n."""
    n, mean, cov = linalg.moments(df, vector)
    return n, mean, cov * max(n - 1, 1) / n


def _volume(cov: np.ndarray) -> float:
    """Log determinant over the directions that have variance."""
    w = np.linalg.eigvalsh(cov)
    return float(np.log(w[w > max(w.max(), 0) * 1e-12]).sum()) if len(w) and w.max() > 0 else -math.inf


def support_share(n: int) -> float:
    return min(0.8, max(0.5, 1.0 - 10.0 / max(n, 1)))


def robust_covariance(df: DataFrame, id_col: str, vector: str = "embedding", share: float | None = None, starts: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(location, covariance) by least covariance determinant: the h = ceil(share * n) rows whose covariance has the least
    determinant, found by concentration steps from several starts: all rows, and shares of them drawn by a hash of the
    id. A step takes the h rows of least distance (rows that tie with the last of them too), two steps from every
    start, then from the best one until the determinant stays. The covariance is made consistent by the median distance
    over the median of chi-square, then rows within its 97.5 % quantile give the final one. Rows without a vector are
    left out. A step is a pass of distances, an exact selection of the h-th and a pass of Gram sums."""
    df = df.where(F.col(vector).isNotNull())
    n, mean, cov = _fit(df, vector)
    d, h = len(mean), max(1, math.ceil((share or support_share(n)) * n))

    def step(mean, cov):
        rows = squared_distances(df, mean, cov, vector)
        edge = kth_smallest(rows, "d2", h)
        return _fit(rows.where(F.col("d2") <= edge * (1 + 1e-12)).drop("d2"), vector)[1:]

    u = lambda s: F.conv(F.substring(F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(s), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    found = []
    for s in range(starts):
        now = (mean, cov)
        if s:
            some = df.where(u(s) < h / n)
            if some.limit(2).count() < 2:
                continue
            now = _fit(some, vector)[1:]
        for _ in range(2):
            now = step(*now)
        found.append((_volume(now[1]), s, now))
    volume, _, now = min(found, key=lambda x: x[:2])
    for _ in range(STEPS):
        then = step(*now)
        if not _volume(then[1]) < volume - 1e-9:
            break
        volume, now = _volume(then[1]), then
    rows = squared_distances(df, *now, vector)
    k = n // 2
    median = kth_smallest(rows, "d2", k + 1) if n % 2 else (kth_smallest(rows, "d2", max(k, 1)) + kth_smallest(rows, "d2", k + 1)) / 2
    factor = median / float(chi2_quantile(np.array([0.5]), d)[0])
    edge = float(chi2_quantile(np.array([0.975]), d)[0])
    inside = rows.where(F.col("d2") < edge * factor) if factor > 0 else rows.where("d2 <= 0")
    return _fit(inside.drop("d2"), vector)[1:]


def mahalanobis(df: DataFrame, id_col: str, robust: bool = True, vector: str = "embedding") -> DataFrame:
    """(id, d2): squared distances to the mean of all rows under the robust or the plain covariance (over n - 1)."""
    df = df.where(F.col(vector).isNotNull())
    _, mean, cov = linalg.moments(df, vector)
    if robust:
        cov = robust_covariance(df, id_col, vector)[1]
    return squared_distances(df, mean, cov, vector).select(id_col, "d2")


def diagonal_distances(df: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """(id, d2): squared distances to the mean, each component over its variance; components without spread are left out."""
    df = df.where(F.col(vector).isNotNull())
    _, mean, cov = linalg.moments(df, vector)
    return squared_distances(df, mean, np.diag(np.diag(cov)), vector).select(id_col, "d2")


def gaussianity(df: DataFrame, id_col: str, robust: bool = True, alphas=(0.05,), vector: str = "embedding") -> DataFrame:
    """A row for each alpha: n, d, mean_d2, std_d2, expected_std, representativeness 1 - min(1, |mean - d| / d), threshold
    (chi-square quantile of 1 - alpha), outliers above it and their share, first10 (share of variance of the first ten
    principal components) and likely, if that is below a half."""
    df = df.where(F.col(vector).isNotNull())
    _, _, cov = linalg.moments(df, vector)
    d, w = len(cov), linalg.eigen(cov)[0]
    first10 = float(w[:10].sum() / w.sum()) if w.sum() > 0 else 1.0
    edges = [float(x) for x in chi2_quantile(1 - np.array(alphas), d)]
    dist = mahalanobis(df, id_col, robust, vector)
    counts = dist.agg(F.count("*").alias("n"), F.avg("d2").alias("mean_d2"), F.stddev_pop("d2").alias("std_d2"), *[F.count_if(F.col("d2") > e).alias(f"o{i}") for i, e in enumerate(edges)])
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(e).alias("threshold"), F.col(f"o{i}").alias("outliers")) for i, (a, e) in enumerate(zip(alphas, edges))])).alias("x")
    rows = counts.select("n", "mean_d2", "std_d2", each).select("n", F.lit(d).alias("d"), "mean_d2", "std_d2", "x.*")
    like = 1 - F.least(F.lit(1.0), F.abs(F.col("mean_d2") - d) / d)
    return rows.select("alpha", "n", "d", "mean_d2", "std_d2", F.lit(math.sqrt(2 * d)).alias("expected_std"), like.alias("representativeness"), "threshold", "outliers", (F.col("outliers") / F.col("n")).alias("share"), F.lit(first10).alias("first10"), F.lit(first10 < 0.5).alias("likely"))


def _p(rank, n):
    return 0.01 + 0.98 * (rank - 1) / F.greatest(n - 1, F.lit(1))


def chi2_pairs(dist: DataFrame, id_col: str, d: int, value: str = "d2") -> DataFrame:
    """(rn, observed, theoretical): sorted squared distances beside chi-square quantiles of d degrees."""
    r = running(dist.select(id_col, value), [value, id_col], {"rn": F.lit(1)}).withColumnRenamed("rn_total", "n")
    return r.select("rn", F.col(value).alias("observed"), chi2_at(_p(F.col("rn"), F.col("n")), d).alias("theoretical"))


def component_pairs(df: DataFrame, id_col: str, components: int, vector: str = "embedding", principal: bool = False) -> DataFrame:
    """(component, rn, observed, theoretical): for each of the first vector components, or principal components, the
    standardised values in order beside normal quantiles. A component without spread is only centred."""
    df = df.where(F.col(vector).isNotNull())
    n, mean, cov = linalg.moments(df, vector)
    k = min(components, len(mean))
    basis = linalg.eigen(cov)[1][:, :k] if principal else np.eye(len(mean))[:, :k]
    spread = np.sqrt(np.maximum(np.diag(basis.T @ cov @ basis) * max(n - 1, 1) / n, 0))
    y = linalg.apply_affine(df, mean, basis / np.where(spread > 1e-10, spread, 1), vector, out="__y")
    out = None
    for c in range(k):
        one = y.select(F.col(id_col).alias("id"), F.col("__y")[c].alias("observed"))
        r = running(one, ["observed", "id"], {"rn": F.lit(1)}).withColumnRenamed("rn_total", "n")
        r = r.select(F.lit(c).alias("component"), "rn", "observed", inverse_normal(_p(F.col("rn"), F.col("n"))).alias("theoretical"))
        out = r if out is None else out.unionByName(r)
    return out


def rayleigh(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """n, resultant, rayleigh (n d R^2) and its p-value by chi-square of d degrees. Without vectors no row."""
    some = df.where(F.col(vector).isNotNull())
    first = some.select(F.size(vector)).first()
    return resultant_length(some, vector).withColumn("p", chi2_p_value(F.col("rayleigh"), first[0] if first else 1))


def cosine_spectrum(df: DataFrame, most: int = 50, vector: str = "embedding") -> DataFrame:
    """(component, eigenvalue, ratio, cumulative) of the principal components of the n x n matrix of cosines, which is never
    made: with U the unit rows its centred columns are U_c U', so its variances are the eigenvalues of G S, where G = U'U
    and S is the covariance of U: a d x d problem. min(most, n - 1) rows; beyond d they are 0."""
    row = gram(df.where(F.col(vector).isNotNull()), None, vector, normalise=True).first()
    spark = df.sparkSession
    schema = "component int, eigenvalue double, ratio double, cumulative double"
    if row is None or row["n"] < 2:
        return spark.createDataFrame([], schema)
    n, s = row["n"], np.array(row["s"])
    g = np.array(row["g"]).reshape(len(s), -1)
    w, v = np.linalg.eigh(g)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    values = np.maximum(np.linalg.eigvalsh(root @ (g - np.outer(s, s) / n) @ root)[::-1], 0) / (n - 1)
    values = np.r_[values, np.zeros(max(0, min(most, n - 1) - len(values)))]
    share = values / values.sum() if values.sum() > 0 else values
    return spark.createDataFrame([(i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(values, share, share.cumsum()))][: min(most, n - 1)], schema)


class Angles:
    """Kernel: sums of the angles, in radians, of each row with all others: n, total, squares (of blocks' rows)."""

    SCHEMA = "n long, total double, squares double"

    def begin(self, block) -> None:
        self.block, self.n, self.total, self.squares = block, 0, 0.0, 0.0

    def least(self, block) -> float:
        return -np.inf

    def meet(self, block) -> None:
        angle = np.arccos(np.clip(cosines(self.block, block), -1, 1))
        if block.number == self.block.number:
            angle = angle[~np.eye(len(angle), dtype=bool)]
        times = 1 if block.own else 2  # two blocks meet on one side
        self.n, self.total, self.squares = self.n + times * angle.size, self.total + times * angle.sum(), self.squares + times * (angle * angle).sum()

    def finish(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), pa.array([self.total], pa.float64()), pa.array([self.squares], pa.float64())], names=["n", "total", "squares"])


def angle_spread(df: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """mean_angle and std_angle (radians, population) over all pairs of rows, summed up block by block."""
    index = build(df, id_col, vector)
    sums = scan(index, index, Angles(), Angles.SCHEMA, once=True).agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"))
    mean = F.try_divide("t", "n")
    return sums.select(mean.alias("mean_angle"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("std_angle"))


def cosine_report(df: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """One row: n, d, mean and variance of all pairs' cosines, spread of their angles, resultant length, Rayleigh's test, and
    the shares of the first and the first ten components of the cosine spectrum."""
    df = df.where(F.col(vector).isNotNull())
    pairs = cosine_stats(df, None, vector).select("mean_cosine", "var_cosine")
    spectrum = cosine_spectrum(df, vector=vector)
    shares = spectrum.agg(F.max(F.when(F.col("component") == 1, F.col("ratio"))).alias("first"), F.max(F.when(F.col("component") <= 10, F.col("cumulative"))).alias("first10"))
    width = df.agg(F.max(F.size(vector)).alias("d"))
    return rayleigh(df, vector).join(pairs).join(angle_spread(df, id_col, vector)).join(shares).join(width)  # one row each
