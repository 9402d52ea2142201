"""Distribution tests, histograms, regressions and threshold sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.ordered import running


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, cdf) at the distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    return running(c, [value], {"run": F.col("c")}).select(value, (F.col("run") / F.col("run_total")).alias("cdf"))


def ks_distance(df: DataFrame, value: str, group: str, a, b, weight: str | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D (step functions) with both sizes; counts may come weighted, never expanded."""
    w = F.col(weight) if weight else F.lit(1)
    c = df.where(F.col(group).isin(a, b)).groupBy(value).agg(F.sum(F.when(F.col(group) == a, w).otherwise(0)).alias("ca"), F.sum(F.when(F.col(group) == b, w).otherwise(0)).alias("cb"))
    c = running(c, [value], {"a": F.col("ca"), "b": F.col("cb")})
    c = c.select(F.abs(F.col("a") / F.col("a_total") - F.col("b") / F.col("b_total")).alias("d"), F.col("a_total").alias("n_a"), F.col("b_total").alias("n_b"))
    return c.agg(F.max("d").alias("d"), F.max("n_a").cast("long").alias("n_a"), F.max("n_b").cast("long").alias("n_b"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value (Kolmogorov series)."""
    if not n or not m:
        raise ValueError("a sample is empty")
    x = d * math.sqrt(n * m / (n + m))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """ks_p_value of columns: 100 terms of the Kolmogorov series."""
    x = d * F.sqrt(n.cast("double") * m / (n + m))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def ks_effect(d: Column) -> Column:
    return F.when(d < 0.1, "negligible").when(d < 0.2, "small").when(d < 0.3, "medium").otherwise("large")


def ks_interpret(d: Column, p: Column, n: Column, m: Column, alpha: float = 0.05) -> Column:
    """Whether two samples differ: with over 1000 rows each by effect size (D of 0.2 or more), else by p."""
    return F.when(F.least(n, m) > 1000, d >= 0.2).otherwise(p < alpha)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed: bin, n, density."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    x = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return x.groupBy(b.alias("bin"), width.alias("w"), "total").agg(F.count("*").alias("n")).select("bin", "n", (F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).cast("long").alias("n"))


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute difference with its sample std, and the paired t statistic."""
    d = F.col(a) - F.col(b)
    s = df.agg(F.avg(F.abs(d)).alias("mae"), F.stddev_samp(F.abs(d)).alias("mae_std"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    return s.select("mae", "mae_std", (F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.col("n").cast("long").alias("n"))


def kde(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid between the extremes: x, density."""
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    grid = s.select("h", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x"))
    # equal values share a kernel, so rows meet the grid after grouping
    v = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).where("v IS NOT NULL")
    z = (F.col("x") - F.col("v")) / F.col("h")
    return v.crossJoin(F.broadcast(grid)).groupBy("x", "h", "n").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s")).select("x", (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def fbeta_threshold(df: DataFrame, score: str, label: str, beta: float = 0.5) -> DataFrame:
    """The score threshold (score >= threshold is positive) with the best F-beta; of equals the smallest."""
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("c"))
    c = running(c, [F.desc(score)], {"tp": F.col("p"), "got": F.col("c")})
    tp, got, all_ = F.col("tp"), F.col("got"), F.col("tp_total")
    k = beta * beta
    f = c.select(F.col(score).alias("threshold"), ((1 + k) * tp / (k * all_ + got)).alias("f"))
    return f.agg(F.max(F.struct("f", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f").alias("f_beta"))


# Coefficients of the rational forms of the normal quantile in the middle and in the tails.
MIDDLE = ([-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00], [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0])
TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00], [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0])


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal by rational forms (relative error below 1.2e-9)."""

    def horner(coefficients, x):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    low = F.least(p, 1 - p)
    q, t = 0.5 - low, F.sqrt(-2 * F.log(low))
    middle = q * horner(MIDDLE[0], q * q) / horner(MIDDLE[1], q * q)
    x = F.when(low < 0.02425, -horner(TAIL[0], t) / horner(TAIL[1], t)).otherwise(middle)
    return F.when(p < 0.5, -x).otherwise(x)


def qq_pairs(df: DataFrame, value: str) -> DataFrame:
    """(rn, observed, theoretical) with p = 0.01 + 0.98 (rn - 1) / (n - 1)."""
    r = running(df.where(F.col(value).isNotNull()).select(F.col(value).alias("observed")), ["observed"], {"rn": F.lit(1)}).withColumnRenamed("rn_total", "n")
    return r.select("rn", "observed", inverse_normal(0.01 + 0.98 * (F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("theoretical"))


def field_completeness(df: DataFrame, fields: list[str], by: str) -> DataFrame:
    """total, present, missing, percent, and lengths of each field, per `by` and overall (null `by`)."""
    long = df.select(F.col(by).alias("by_value"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select("by_value", "x.field", "x.v")
    t = F.trim("v")
    ok = F.col("v").isNotNull() & (t != "") & (F.lower(t) != "nan")
    size = F.when(ok, F.length("v"))
    out = long.select("by_value", "field", ok.cast("int").alias("ok"), size.alias("size")).groupingSets([["by_value", "field"], ["field"]], "by_value", "field")
    return out.agg(F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("present"), F.avg("size").alias("avg_length"), F.max("size").cast("long").alias("max_length")).withColumn("percent", F.round(100.0 * F.col("present") / F.col("total"), 2))


def triangle_threshold(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """One row `threshold`: the centre of the histogram bin that lies farthest below the line from the highest bin to the
    end of the longer tail; of equals the bin nearest to that end. Nulls are left out; without values it is null. What
    is broadcast has one row a bin at most."""
    found = histogram(df, value, bins).select("bin", "n")
    span = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    shape = found.agg(F.max(F.struct("n", (-F.col("bin")).alias("at"))).alias("top"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    peak = -F.col("top.at")
    end = F.when(peak - F.col("low") < F.col("high") - peak, F.col("high")).otherwise(F.col("low"))
    line = shape.select(F.col("top.n").alias("height"), peak.alias("peak"), end.alias("end"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(found), "bin", "left").join(F.broadcast(line)).join(F.broadcast(span))
    steps, width = F.abs(F.col("bin") - F.col("end")), F.abs(F.col("peak") - F.col("end"))
    between = (steps < F.greatest(width, F.lit(1))) & ((F.col("bin") - F.col("end")) * (F.col("peak") - F.col("end")) >= 0)
    below = F.col("height") * steps - width * F.coalesce("n", F.lit(0))
    centre = F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / bins)
    return every.where(between).agg(F.max(F.struct(below.alias("below"), (-steps).alias("near"), centre.alias("threshold"))).alias("best")).select("best.threshold")


def bin_extremes(df: DataFrame, id_col: str, value: str, size: str, width: float) -> DataFrame:
    """Per half-open bin of `value`: n, and the ids of the rows with the smallest and the largest `size` (of equals the
    smallest id). Rows with a null in either column are left out."""
    x = df.where(F.col(value).isNotNull() & F.col(size).isNotNull()).withColumn("bin", F.floor(F.col(value) / width).cast("long"))
    low, high = F.min(F.struct(size, id_col)), F.max(F.struct(F.col(size), (-F.col(id_col)).alias("back")))
    return x.groupBy("bin").agg(F.count("*").alias("n"), low.alias("a"), high.alias("b")).select("bin", "n", F.col(f"a.{id_col}").alias("shortest"), (-F.col("b.back")).alias("longest"))


def peak(density: DataFrame) -> DataFrame:
    """(x, density) of the highest point of a density; of equals the smallest x."""
    return density.agg(F.max(F.struct("density", (-F.col("x")).alias("back"))).alias("m")).select((-F.col("m.back")).alias("x"), F.col("m.density").alias("density"))
