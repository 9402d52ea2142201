"""Quality measures of vector collections, and normalised drift of groups over time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.vectors import FLUSH, cosine_distance, dot, doubles, long_form, mean_vectors, norm, unit_sums
from quillon.operators.similarity import mean_pair_cosine


def norm_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """n, min_norm, max_norm, mean_norm and zeros of all vectors, in one pass."""
    n = norm(doubles(vector))
    return df.select(n.alias("x")).agg(F.count("x").alias("n"), F.min("x").alias("min_norm"), F.max("x").alias("max_norm"), F.avg("x").alias("mean_norm"), F.count_if(F.col("x") == 0).alias("zeros"))


def length_norm_correlation(df: DataFrame, length: str, vector: str = "embedding") -> DataFrame:
    """Pearson correlation of a text's length and its vector's norm; 0 where the norms are all one."""
    x = df.select(F.col(length).cast("double").alias("a"), norm(doubles(vector)).alias("b"))
    out = x.agg(F.corr("a", "b").alias("r"), (F.max("b") - F.min("b")).alias("span"))
    return out.select(F.when(F.col("span") < 1e-9, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("correlation"))


def centroid_distance(df: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """Cosine distance of each vector to the mean of all: (id, distance). One broadcast row."""
    mean = mean_vectors(df, [], vector).select("centroid")
    return df.join(F.broadcast(mean)).select(id_col, cosine_distance(doubles(vector), F.col("centroid")).alias("distance"))


def mean_of_means_distance(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance of the groups' mean vectors, exactly: n, mean_distance. A mean that is zero has
    distance 1 to all others; 0 below two groups."""
    means = mean_vectors(df, [key], vector).select(F.col("centroid").alias("v"))
    s, n = unit_sums(means, [], "v"), F.col("n").cast("double")
    return s.select(F.col("n").cast("long").alias("n"), F.when(F.col("n") < 2, 0.0).otherwise(1 - mean_pair_cosine(F.col("total"), F.col("own"), n)).alias("mean_distance"))


def separation(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """intra (mean cosine of pairs within a class, over all such pairs, so a class counts by its pairs), inter (of pairs
    across classes, likewise), gap and ratio inter / intra (null unless intra > 0), from sums of unit vectors: no pair is
    made. Rows with a null class are left out; without a pair of the kind intra or inter is null."""
    df = df.where(F.col(key).isNotNull())
    s = unit_sums(df, [key], vector).select(F.col("n").cast("double").alias("n"), F.col("own").alias("nonzero"), dot(F.col("total"), F.col("total")).alias("own"))
    per = s.agg(F.sum(F.col("own") - F.col("nonzero")).alias("inside"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum("own").alias("own"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    whole = unit_sums(df, [], vector).select(F.col("n").cast("double").alias("all_n"), dot(F.col("total"), F.col("total")).alias("all_own"))
    across = F.col("all_n") * F.col("all_n") - F.col("squares")
    out = per.join(F.broadcast(whole)).select(F.try_divide("inside", "pairs").alias("intra"), F.try_divide(F.col("all_own") - F.col("own"), across).alias("inter"))
    return out.select("intra", "inter", (F.col("intra") - F.col("inter")).alias("gap"), F.when(F.col("intra") > 0, F.col("inter") / F.col("intra")).alias("ratio"))


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def hoeffding(n: Column, low: float = 0.0, high: float = 1.0, alpha: float = 0.05) -> Column:
    """Half width of the two-sided Hoeffding interval of a mean of n values in [low, high]; null without values."""
    return F.sqrt(-F.log(F.lit(alpha / 2)) * (high - low) ** 2 / (2 * F.nullif(n, F.lit(0))))


def hoeffding_bounds(mean: Column, n: Column, low: float = 0.0, high: float = 1.0, alpha: float = 0.05) -> tuple[Column, Column]:
    """The interval's ends, clipped to [low, high]."""
    e = hoeffding(n, low, high, alpha)
    clip = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
    return clip(mean - e), clip(mean + e)


def component_by_period(df: DataFrame, period: str, periods: list, vector: str = "embedding") -> DataFrame:
    """Rows are components, columns the given periods, cells the mean: pos, p_<period>..."""
    x = long_form(df, [period], vector)
    means = [F.avg(F.when(F.col(period) == F.lit(p), F.col("x"))).alias(f"p_{p}") for p in periods]
    return x.groupBy(F.col("pos").cast("int").alias("pos")).agg(*means)


def spread_sigma(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Pooled sigma (one row) of cosine distances to the group's mean vector, groups below two rows left out. A
    group's mean is joined back, so nothing is collected; squares are summed by group with n - 1 degrees each."""
    means = mean_vectors(df, keys, vector)
    d = cosine_distance(doubles(vector), F.col("centroid"))
    per = df.join(means, keys).where("n > 1").select(*keys, "n", (d * d).alias("q")).groupBy(*keys).agg(F.avg("q").alias("v"), F.max("n").alias("n"))
    free = F.col("n") - 1
    return per.agg(F.sqrt(F.sum(free * F.col("v")) / F.sum(free)).alias("sigma"))


class NoNormalization:
    """Strategy: the rows as they are, the drift as it is."""

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def normalise(self, drift: DataFrame) -> DataFrame:
        return drift.withColumn("normalised", F.col("velocity"))


class SmallestGroup(NoNormalization):
    """Strategy: every group (of one column or several) is sampled down to the smallest group's size."""

    def __init__(self, keys: str | list[str], id_col: str):
        self.keys, self.id_col = [keys] if isinstance(keys, str) else list(keys), id_col

    def prepare(self, df: DataFrame) -> DataFrame:
        from quillon.operators.relational import downsample_to_smallest

        return downsample_to_smallest(df.withColumn("__key", F.struct(*self.keys)), "__key", self.id_col).drop("__key")


class StandardError(NoNormalization):
    """Strategy: drift / (sigma sqrt(1/n + 1/next_n)); unchanged where that is null or 0."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def prepare(self, df: DataFrame) -> DataFrame:
        self.sigma = spread_sigma(df, self.keys)
        return df

    def normalise(self, drift: DataFrame) -> DataFrame:
        error = F.col("sigma") * F.sqrt(1.0 / F.col("n") + 1.0 / F.col("next_n"))
        rows = drift.join(F.broadcast(self.sigma))
        return rows.withColumn("normalised", F.when(error > 0, F.col("velocity") / error).otherwise(F.col("velocity"))).drop("sigma")


def drift_metrics(df: DataFrame, strategy, g="genre", t="year", vector="embedding") -> DataFrame:
    """Velocity of each group between its present periods under a strategy, with its change and running sum:
    g, t, n, next_n, velocity, normalised, acceleration, cumulative."""
    from quillon.operators.temporal import drift_velocity

    w = W.partitionBy(g).orderBy(t)
    out = strategy.normalise(drift_velocity(strategy.prepare(df), g, t, vector))
    return out.withColumns({"acceleration": F.lead("normalised").over(w) - F.col("normalised"), "cumulative": F.sum("normalised").over(w.rowsBetween(W.unboundedPreceding, 0))})


def drift_by_periods(df: DataFrame, id_col: str, strategy, years: int = 1, most: int | None = None, reps: int | None = None, g="genre", t="year", vector="embedding") -> DataFrame:
    """Drift between periods of `years` years: of each group and period at most the first `most` rows by id, then
    drift_metrics under the strategy; with reps also median, low and high of bootstrapped replicates of the same rows."""
    from quillon.operators.cleaning import head_per_group
    from quillon.operators.temporal import period

    rows = df.withColumn(t, period(F.col(t), years))
    rows = strategy.prepare(rows)
    rows = head_per_group(rows, [g, t], [id_col], most) if most else rows
    out = drift_metrics(rows, _Prepared(strategy), g, t, vector)
    if reps:
        ends = bootstrapped_change(rows, id_col, g, t, vector, reps).select(F.col(g).alias("__g"), F.col(t).alias("__t"), "median", "low", "high")
        out = out.join(ends, F.col(g).eqNullSafe(F.col("__g")) & F.col(t).eqNullSafe(F.col("__t")), "left").drop("__g", "__t")
    return out


class _Prepared(NoNormalization):
    """A strategy whose rows are prepared already."""

    def __init__(self, strategy):
        self.normalise = strategy.normalise


def bootstrapped_change(df: DataFrame, id_col: str, g="genre", t="year", vector="embedding", reps: int = 20, seed: int = 42) -> DataFrame:
    """Drift of Poisson(1)-weighted replicates: g, t, median, low, high (2.5 and 97.5 percent) of the cosine distance
    to the next present period's mean in the same replicate. A row's weight in a replicate follows from a hash of its
    id, so a task that runs again draws the same; a task adds up its rows for all replicates by a matrix product and
    hands on one array a group, period and replicate. The last period has no row; rows without an id or a vector are left
    out."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    kinds = [df.schema[c].dataType.simpleString() for c in (g, t)]

    def partial(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            ids = [str(i).encode() for i in b.column(0).to_pylist()]
            u = np.array([[int(hashlib.md5(b"%b-%d-%d" % (i, r, seed)).hexdigest()[:8], 16) for r in range(reps)] for i in ids])
            w = ((u[:, :, None] + 0.5) / 4294967296.0 > np.array(steps)).sum(2).astype(float)
            code: dict = {}
            at = np.array([code.setdefault(k, len(code)) for k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
            for key, c in code.items():  # replicates x rows by rows x components
                mine = at == c
                part = np.c_[w[mine].sum(0), w[mine].T @ x[mine]]
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) * (x.shape[1] + 1) * reps > FLUSH:
                yield from flush(sums, b)
                sums = {}
            last = b
        if sums:
            yield from flush(sums, last)

    def flush(sums, b):
        rows = [(key, r, line) for key, part in sums.items() for r, line in enumerate(part) if line[0] > 0]
        cols = [pa.array([k[i] for k, _, _ in rows], b.schema.field(1 + i).type) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([r for _, r, _ in rows], pa.int32()), pa.array([line[0] for _, _, line in rows]), pa.array([line[1:].tolist() for _, _, line in rows], pa.list_(pa.float64()))], names=["g", "t", "rep", "w", "x"])

    drawn = df.select(F.col(id_col).cast("string").alias("id"), F.col(g).alias("g"), F.col(t).alias("t"), doubles(vector).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    parts = drawn.mapInArrow(partial, f"g {kinds[0]}, t {kinds[1]}, rep int, w double, x array<double>").select(F.col("g").alias(g), F.col("t").alias(t), "rep", "w", F.posexplode("x").alias("pos", "x"))
    sums = parts.groupBy(g, t, "rep", "pos").agg((F.sum("x") / F.sum("w")).alias("m"))
    means = sums.groupBy(g, t, "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda c: c["m"]).alias("c"))
    change = means.withColumn("d", cosine_distance(F.col("c"), F.lead("c").over(W.partitionBy(g, "rep").orderBy(t)))).where("d IS NOT NULL")
    p = F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return change.groupBy(g, t).agg(p.alias("p"), F.count("*").alias("n")).select(g, t, "n", F.col("p")[1].alias("median"), F.col("p")[0].alias("low"), F.col("p")[2].alias("high"))


def top_weights(df: DataFrame, weights: str, k: int) -> Column:
    """The k heaviest entries of a map<term, weight>, ties by term, as array<struct<term, weight>>."""
    rows = F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("term")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda e: F.struct(e["term"].alias("term"), (-e["order"]).alias("weight")))


def frequent_weights(long: DataFrame, id_col: str, term: str, weight: str, lexicon: DataFrame, frequency: str, least: float) -> DataFrame:
    """Rows of terms whose frequency in a lexicon (term, frequency) is at least `least`, weights adding up to 1 an id."""
    kept = long.join(lexicon.where(F.col(frequency) >= least).select(term), term)
    return kept.select(id_col, term, (F.col(weight) / F.sum(weight).over(W.partitionBy(id_col))).alias(weight))


def silhouette(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(n, labels, silhouette): the mean over all rows of (b - a) / max(a, b) by cosine distance, where a is the mean
    distance to the others of the row's class and b the smallest mean distance to another class; 0 for a row that is
    alone in its class and for fewer than two classes. Rows with a null class are left out. Mean distances come from
    the classes' sums of unit vectors, exactly: rows meet classes, never each other. Sums are one row a class."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("own"), doubles(vector).alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(norm(F.col("v")) > 0, x / norm(F.col("v"))).otherwise(0.0)))
    sums = unit_sums(df.where(F.col(key).isNotNull()), [key], vector).select(F.col(key).alias("other"), F.col("n").cast("double").alias("n"), "total")
    classes = sums.agg(F.collect_list(F.struct("other", "n", "total")).alias("classes"))
    cosines = lambda c: dot(F.col("v"), c["total"])
    self_cosine = dot(F.col("v"), F.col("v"))
    mine = F.get(F.filter("classes", lambda c: c["other"] == F.col("own")), F.lit(0))
    a = 1 - (cosines(mine) - self_cosine) / (mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("classes", lambda c: c["other"] != F.col("own")), lambda c: 1 - cosines(c) / c["n"]))
    x = rows.join(F.broadcast(classes)).select(F.when(mine["n"] > 1, a).alias("a"), b.alias("b"), F.size("classes").alias("labels"))
    score = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(score)
    return x.agg(F.count("*").alias("n"), F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.avg(score), F.lit(0.0)).alias("silhouette"))
