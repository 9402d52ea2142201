"""One-vs-rest logistic regression over vectors with lists of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import doubles

MAX_LABELS = 10_000
NUMBERS = 4 << 20  # that a task holds of the second derivatives; labels are fitted in groups that fit


def in_training(id_col: Column, share: float = 0.8, seed: int = 42) -> Column:
    """A fixed share of the ids, by a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", id_col.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return u < share


def label_names(df: DataFrame, labels: str) -> list:
    """All labels in order; their number is checked."""
    found = [r[0] for r in df.select(F.explode(labels).alias("x")).where("x IS NOT NULL").distinct().limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return sorted(found)


def _sums(rows: DataFrame, weights: np.ndarray, names: list) -> np.ndarray:
    """For each label loss, gradient and second derivatives (d x d) of the log loss at its weights, and how many rows have
    it: partial sums by task, one row a label and matrix row."""
    size = weights.shape[1]

    def run(batches):
        out = np.zeros((len(names), 2 + size + size * size))
        place = {x: i for i, x in enumerate(names)}
        some = False
        for b in batches:
            if not b.num_rows:
                continue
            some = True
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = np.c_[x, np.ones(len(x))]
            y = np.zeros((len(x), len(names)))
            for i, have in enumerate(b.column(1).to_pylist()):
                for k in {place[h] for h in have if h in place}:
                    y[i, k] = 1
            z = x @ weights.T
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            out[:, 0] += (np.logaddexp(0, z) - y * z).sum(0)
            out[:, 1] += y.sum(0)
            out[:, 2 : 2 + size] += (p - y).T @ x
            for k in range(len(names)):
                out[k, 2 + size :] += ((x * (p[:, k] * (1 - p[:, k]))[:, None]).T @ x).ravel()
        if some:
            cells = [(k, r, row.tolist()) for k in range(len(names)) for r, row in [(-1, out[k, : 2 + size]), *((r, out[k, 2 + size + r * size : 2 + size + (r + 1) * size]) for r in range(size))]]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.list_(pa.float64()))], names=["label", "row", "x"])

    parts = rows.mapInArrow(run, "label int, row int, x array<double>").select("label", "row", F.posexplode("x").alias("pos", "x"))
    cells = parts.groupBy("label", "row", "pos").agg(F.sum("x").alias("x")).toArrow()  # labels x (d + 1) x (d + 2) numbers
    out = np.zeros((len(names), 2 + size + size * size))
    label, row, pos, x = (cells[c].to_numpy() for c in ("label", "row", "pos", "x"))
    out[label, np.where(row < 0, pos, 2 + size + row * size + pos)] = x
    return out


def fit(df: DataFrame, labels: str, names: list, vector: str = "embedding", c: float = 1.0, most: int = 50) -> np.ndarray:
    """Weights (a row a label, the intercept last) that minimise |w|^2 / 2 + c * log loss, the intercept free: Newton steps,
    halved where the loss would rise, to 1e-10. A label that all rows or none have gets the constant 30 or -30."""
    rows = df.where(F.col(vector).isNotNull() & F.col(labels).isNotNull()).select(doubles(vector).alias("x"), labels)
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit on")
    size = len(first["x"]) + 1
    ridge = np.r_[np.ones(size - 1), 0.0]
    n = rows.count()
    out = np.zeros((len(names), size))
    group = max(1, NUMBERS // (size * size))
    for a in range(0, len(names), group):
        mine = names[a : a + group]
        w, step, loss = np.zeros((len(mine), size)), np.zeros((len(mine), size)), np.full(len(mine), np.inf)
        open_ = np.ones(len(mine), bool)
        for _ in range(most):
            s = _sums(rows, w, mine)
            now = c * s[:, 0] + (w * w * ridge).sum(1) / 2
            for k in np.flatnonzero(open_):
                if s[k, 1] in (0, n):
                    w[k], open_[k] = np.r_[np.zeros(size - 1), 30.0 if s[k, 1] else -30.0], False
                elif now[k] > loss[k] + 1e-9 * abs(loss[k]):
                    step[k] /= 2
                    w[k] -= step[k]
                else:
                    loss[k] = now[k]
                    slope = c * s[k, 2 : 2 + size] + ridge * w[k]
                    step[k] = -np.linalg.lstsq(c * s[k, 2 + size :].reshape(size, size) + np.diag(ridge), slope, rcond=None)[0]
                    w[k] += step[k]
                    open_[k] = np.abs(step[k]).max() > 1e-10
            if not open_.any():
                break
        out[a : a + group] = w
    return out


def predict(df: DataFrame, weights: np.ndarray, names: list, vector: str = "embedding", out: str = "predicted") -> DataFrame:
    """Rows with the labels whose probability is above a half, in order; a null vector has none."""
    kind = df.sparkSession.createDataFrame([(names[0],)], ["x"]).schema["x"].dataType.simpleString()

    @F.pandas_udf(f"array<{kind}>")
    def run(x: pd.Series) -> pd.Series:
        none = np.zeros(weights.shape[1] - 1)
        z = np.stack([none if v is None else v for v in x]) @ weights[:, :-1].T + weights[:, -1] if len(x) else []
        return pd.Series([[names[k] for k in np.flatnonzero(row > 0)] for row in z], dtype=object)

    return df.withColumn(out, F.when(F.col(vector).isNotNull(), run(doubles(vector))))


def scores(df: DataFrame, labels: str, predicted: str = "predicted") -> DataFrame:
    """n, subset_accuracy (all labels right) and micro_f1 (over labels; 0 without any)."""
    a, b = F.array_distinct(labels), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(a, b))
    sums = df.agg(F.count("*").alias("n"), F.count_if((hit == F.size(a)) & (hit == F.size(b))).alias("same"), F.sum(hit).alias("hit"), F.sum(F.size(a) + F.size(b)).alias("all"))
    return sums.select("n", F.try_divide("same", "n").alias("subset_accuracy"), F.coalesce(F.try_divide(2 * F.col("hit"), F.col("all")), F.lit(0.0)).alias("micro_f1"))


def evaluate(df: DataFrame, id_col: str, labels: str, vector: str = "embedding", share: float = 0.8, seed: int = 42) -> DataFrame:
    """Fits on a fixed share of the rows that have labels and a vector and scores the others: n_train, n, subset_accuracy,
    micro_f1. Labels are learned from the training rows alone. Fewer than two labelled rows, or none to train on, give
    null scores."""
    rows = df.where(F.col(vector).isNotNull() & (F.size(F.coalesce(labels, F.array())) > 0)).withColumn("__train", in_training(F.col(id_col), share, seed))
    train, test = rows.where("__train"), rows.where("NOT __train")
    n = train.count()
    if n < 1 or n + test.limit(2).count() < 2:
        return df.sparkSession.createDataFrame([(n, test.count(), None, None)], "n_train long, n long, subset_accuracy double, micro_f1 double")
    names = label_names(train, labels)
    out = scores(predict(test, fit(train, labels, names, vector), names, vector), labels)
    return out.select(F.lit(n).cast("long").alias("n_train"), "n", "subset_accuracy", "micro_f1")
