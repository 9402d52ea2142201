"""Reports that put operators together: balls with their rows, spreads between and within groups, repeated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.ordered import running
from quillon.functions.vectors import cosine_distance, dot, doubles, gram, mean_vectors, unit_sums
from quillon.operators import linalg, similarity
from quillon.operators.relational import draw_key, length_buckets


def ball_rows(df: DataFrame, to: DataFrame, id_col: str, facts: DataFrame, eps: float, exclude: list = (), vector: str = "embedding") -> DataFrame:
    """The rows within eps of an anchor row with what is known of them (facts by the same id, null where nothing is):
    id, the facts, distance, similarity, rank from 1, ties by id. Ranks add up by ranges of the distance."""
    inside = similarity.epsilon_ball(df, to, id_col, eps, exclude, vector).withColumn("distance", F.round("distance", 12))
    ranked = running(inside, ["distance", id_col], {"rank": F.lit(1)}).drop("rank_total")
    named = ranked.join(facts.withColumnRenamed(id_col, "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")
    return named.withColumn("similarity", 1 - F.col("distance"))


def spread_within_and_between(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(kind, n_pairs, mean, variance, std) of the cosines of all pairs of rows of one class ('intra') and of two classes
    ('inter'), from Gram matrices: the squared cosines of all pairs add up to the matrix's squares. Rows with a null class
    are left out; a kind without pairs has null figures."""
    df = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())

    def sums(g: DataFrame) -> DataFrame:
        own = F.round(F.aggregate(F.sequence(F.lit(0), F.size("s") - 1), F.lit(0.0), lambda t, i: t + F.get("g", i * (F.size("s") + 1))))
        return g.select(F.col("n").cast("double").alias("n"), (dot(F.col("s"), F.col("s")) - own).alias("c"), (dot(F.col("g"), F.col("g")) - own).alias("q"))

    per = sums(gram(df, key, vector, normalise=True)).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("p1"), F.sum("c").alias("c1"), F.sum("q").alias("q1"))
    whole = sums(gram(df, None, vector, normalise=True)).select((F.col("n") * (F.col("n") - 1)).alias("p"), "c", "q")
    kinds = F.array(F.struct(F.lit("intra").alias("kind"), F.col("p1").alias("p"), F.col("c1").alias("c"), F.col("q1").alias("q")), F.struct(F.lit("inter").alias("kind"), (F.col("p") - F.col("p1")).alias("p"), (F.col("c") - F.col("c1")).alias("c"), (F.col("q") - F.col("q1")).alias("q")))
    rows = per.join(F.broadcast(whole)).select(F.explode(kinds).alias("x")).select("x.*")  # one row each
    mean = F.try_divide("c", "p")
    var = F.greatest(F.try_divide("q", "p") - mean * mean, F.lit(0.0))
    return rows.select("kind", (F.col("p") / 2).cast("long").alias("n_pairs"), mean.alias("mean"), F.when(F.col("p") > 0, var).alias("variance"), F.when(F.col("p") > 0, F.sqrt(var)).alias("std"))


def bucket_distances(df: DataFrame, id_col: str, length: str, buckets: int, vector: str = "embedding") -> DataFrame:
    """Equal-count buckets by length: bucket, n, max_length, centroid_distance (mean distance to the bucket's mean vector),
    mean and std of the cosine distances of all its pairs (0 below two rows)."""
    b = length_buckets(df, id_col, length, buckets).select(F.col(id_col).alias("__id"), "bucket")
    rows = df.join(b, F.col(id_col) == F.col("__id")).select("bucket", F.col(length).alias("length"), F.col(vector).alias("v"))
    means = mean_vectors(rows, ["bucket"], "v").select(F.col("bucket").alias("__b"), "centroid")
    centre = rows.join(means, F.col("bucket") == F.col("__b")).groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("max_length"), F.avg(cosine_distance(doubles("v"), F.col("centroid"))).alias("centroid_distance"))
    pairs = similarity.cosine_stats(rows, "bucket", "v").select(F.col("key").cast("int").alias("__b"), (1 - F.col("mean_cosine")).alias("mean"), F.col("std_cosine").alias("std"))
    return centre.join(pairs, F.col("bucket") == F.col("__b"), "left").select("bucket", "n", "max_length", "centroid_distance", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def group_report(df: DataFrame, groups: dict[str, Column], vector: str = "embedding") -> DataFrame:
    """For each named condition over the rows: n, within (mean distance of its pairs), others (mean distance to the rows
    outside) and everywhere (mean distance of all pairs); null where there are no such pairs. One pass of sums."""
    df = df.where(F.col(vector).isNotNull())
    whole = unit_sums(df, [], vector).select(F.col("n").cast("double").alias("all_n"), F.col("own").alias("all_own"), F.col("total").alias("all_total"))
    inside = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in groups.items()]))
    some = unit_sums(df.select(F.explode(inside).alias("name"), F.col(vector).alias("v")), ["name"], "v")
    names = df.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    x = names.join(some, F.col("group") == F.col("name"), "left").join(F.broadcast(whole), how="left")  # one row
    n, rest = F.col("n").cast("double"), F.zip_with("all_total", "total", lambda a, b: a - b)
    within = 1 - F.try_divide(dot(F.col("total"), F.col("total")) - F.col("own"), n * (n - 1))
    others = 1 - F.try_divide(dot(F.col("total"), rest), n * (F.col("all_n") - n))
    every = 1 - F.try_divide(dot(F.col("all_total"), F.col("all_total")) - F.col("all_own"), F.col("all_n") * (F.col("all_n") - 1))
    return x.select("group", F.coalesce("n", F.lit(0)).cast("long").alias("n"), within.alias("within"), others.alias("others"), every.alias("everywhere"))


def repeated_samples(df: DataFrame, id_col: str, n: int, runs: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """(run, n, mean_cosine, std_cosine) of `runs` samples of n rows each, drawn without replacement by a hash of the id and
    seed + run, all pairs of a sample counted. A sampling operator."""
    out = None
    for r in range(runs):
        some = df.where(F.col(vector).isNotNull()).orderBy(draw_key(id_col, seed + r), id_col).limit(n)
        one = similarity.cosine_stats(some, None, vector).select(F.lit(r).alias("run"), F.lit(n).cast("long").alias("n"), "mean_cosine", "std_cosine")
        out = one if out is None else out.unionByName(one)
    return out


def principal_extremes(df: DataFrame, id_col: str, group: str, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(id, group, score, top): of each group the k rows with the largest and the smallest score on the first principal
    direction of all rows; ties by id."""
    df = df.where(F.col(vector).isNotNull())
    _, mean, cov = linalg.moments(df, vector)
    y = linalg.apply_affine(df, mean, linalg.eigen(cov)[1][:, :1], vector, out="__y").select(id_col, group, F.round(F.col("__y")[0], 9).alias("score"))
    place = lambda o: F.row_number().over(W.partitionBy(group).orderBy(o, id_col))  # noqa: E731 - Spark keeps k rows a group and task
    tops = [y.withColumn("r", place(o)).where(F.col("r") <= k).select(id_col, group, "score", F.lit(top).alias("top")) for o, top in ((F.desc("score"), True), (F.asc("score"), False))]
    return tops[0].unionByName(tops[1])
