"""The regularised incomplete gamma function and chi-square quantiles, over arrays and as column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_tail(a: float, x: np.ndarray) -> np.ndarray:
    """Q(a, x) = 1 - P(a, x), to about 1e-13: by the power series below a + 1, by a continued fraction above."""
    x = np.asarray(x, float)
    out = np.where(x <= 0, 1.0, 0.0)
    out[np.isnan(x)] = np.nan
    scale = lambda y: np.exp(a * np.log(y) - y - math.lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        y = x[low]
        term = total = np.full(len(y), 1.0 / a)
        k = a
        while True:
            k += 1
            term = term * y / k
            total = total + term
            if (term <= total * 1e-17).all():
                break
        out[low] = 1 - total * scale(y)
    high = (x >= a + 1) & np.isfinite(x)
    if high.any():
        y = x[high]
        b = y + 1 - a
        c, d = np.full(len(y), 1e300), 1 / b
        h = d
        for k in range(1, 10_000):
            f = -k * (k - a)
            b = b + 2
            d = f * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + f / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = h * scale(y)
    return out


def chi2_tail(x: np.ndarray, d: float) -> np.ndarray:
    """Probability that a chi-square variable of d degrees is above x."""
    return gamma_tail(d / 2, np.asarray(x, float) / 2)


def chi2_quantile(p: np.ndarray, d: float) -> np.ndarray:
    """x with P(X <= x) = p, for p in (0, 1); 0 and infinity at the ends. Newton steps kept inside a bracket."""
    p = np.asarray(p, float)
    out = np.where(p <= 0, 0.0, np.inf)
    out[np.isnan(p)] = np.nan
    some = (p > 0) & (p < 1)
    if not some.any():
        return out
    q, a = p[some], d / 2
    low, high = np.zeros(len(q)), np.full(len(q), max(d, 1.0))
    while (short := 1 - chi2_tail(high, d) < q).any():
        high[short] *= 2
    x = (low + high) / 2
    for _ in range(200):
        f = 1 - chi2_tail(x, d) - q
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slope = np.exp((a - 1) * np.log(x / 2) - x / 2 - math.lgamma(a)) / 2
        step = np.where(slope > 1e-300, x - f / np.maximum(slope, 1e-300), -1)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if (np.abs(new - x) <= 1e-13 * x).all():
            x = new
            break
        x = new
    out[some] = x
    return out


def chi2_p_value(x: Column, d: int) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail(v.to_numpy(float, na_value=np.nan), d))

    return F.when(x.isNotNull(), run(x))


def chi2_at(p: Column, d: int) -> Column:
    """The quantile of a column of probabilities."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(chi2_quantile(v.to_numpy(float, na_value=np.nan), d))

    return F.when(p.isNotNull(), run(p))
