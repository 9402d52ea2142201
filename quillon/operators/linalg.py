"""Embedding-space linear algebra: d x d matrices on the driver, rows on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import doubles, gram, vector_sums


def moments(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance (ddof 1) from one pass of partial Gram matrices."""
    row = gram(df, None, vector).first()
    n, mean = row["n"], np.array(row["s"]) / row["n"]
    g = np.array(row["g"]).reshape(len(mean), -1)
    return n, mean, (g - n * np.outer(mean, mean)) / max(n - 1, 1)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and directions in columns (largest component positive)."""
    w, v = np.linalg.eigh(cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])


def apply_affine(df: DataFrame, mean: np.ndarray, matrix: np.ndarray, vector: str = "embedding", out: str = "embedding", normalise: bool = False) -> DataFrame:
    """(x - mean) @ matrix for each row, in Arrow batches; mean and matrix are d and d x k numbers."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        y = (np.stack(x.to_numpy()).astype(float) - mean) @ matrix
        if normalise:
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-10)
        return pd.Series(list(y))

    return df.withColumn(out, run(doubles(vector)))


def centre(df, vector="embedding") -> DataFrame:
    """Rows with the mean of all taken away; from one pass of sums."""
    total = vector_sums(df, [], vector).first()
    if total is None:
        return df
    mean = np.array(total["total"]) / total["n"]
    return apply_affine(df.where(F.col(vector).isNotNull()), mean, np.eye(len(mean)), vector)


def whiten(df, components=None, normalise=True, vector="embedding") -> DataFrame:
    _, mean, cov = moments(df, vector)
    w, v = eigen(cov)
    k = components or len(w)
    return apply_affine(df, mean, v[:, :k] / np.sqrt(np.maximum(w[:k], 1e-10)), vector, normalise=normalise)


def debias(df, k=3, normalise=False, vector="embedding") -> DataFrame:
    """All but the top: centred, the first k principal directions removed (k is clamped to the dimension)."""
    _, mean, cov = moments(df, vector)
    v = eigen(cov)[1][:, : min(k, len(mean))]
    return apply_affine(df, mean, np.eye(len(mean)) - v @ v.T, vector, normalise=normalise)


def pca_explained(df, vector="embedding") -> DataFrame:
    """component, eigenvalue, ratio, cumulative."""
    w, _ = eigen(moments(df, vector)[2])
    r = w / max(w.sum(), 1e-300)
    return df.sparkSession.createDataFrame([(i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(w, r, r.cumsum()))], "component int, eigenvalue double, ratio double, cumulative double")


def mahalanobis(df, id_col, vector="embedding") -> DataFrame:
    """Squared distance to the mean under the (pseudo-)inverse covariance."""
    _, mean, cov = moments(df, vector)
    w, v = eigen(cov)
    keep = w > w.max() * 1e-12
    y = apply_affine(df, mean, v[:, keep] / np.sqrt(w[keep]), vector, out="__y")
    return y.select(id_col, F.aggregate("__y", F.lit(0.0), lambda s, x: s + x * x).alias("d2"))


def group_spectra(df, key, vector="embedding") -> DataFrame:
    """By group: n, Frobenius and spectral norm of the centred rows, share of the first component, components
    for 95 % of the variance; from the groups' Gram matrices."""

    @F.pandas_udf("frobenius double, spectral double, pve double, n95 int")
    def run(n: pd.Series, s: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for n_, s_, g_ in zip(n, s, g):
            mean = np.asarray(s_) / n_
            w = np.maximum(np.linalg.eigvalsh(np.asarray(g_).reshape(len(mean), -1) - n_ * np.outer(mean, mean))[::-1], 0)
            total = w.sum()
            out.append((np.sqrt(total), np.sqrt(w[0]), w[0] / total if total else 0.0, int((np.cumsum(w) / total < 0.95).sum()) + 1 if total else 0))
        return pd.DataFrame(out, columns=["frobenius", "spectral", "pve", "n95"])

    return gram(df, key, vector).select(F.col("key"), "n", run("n", "s", "g").alias("x")).select("key", "n", "x.*")


def kmeans(df, id_col, k, seed=123, vector="embedding") -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(id_col, array_to_vector(doubles(vector)).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(id_col, F.col("prediction").alias("cluster"))
