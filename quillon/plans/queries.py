"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import linalg, relational, similarity, stats, temporal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def movies(spark, sf) -> DataFrame:
    """Documents with their vector and date: the film view of the driver's tables."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("movie_id"), F.col("text").alias("plot"), F.col("lang").alias("country"), "n_chars")
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("movie_id"), F.col("label").cast("int").alias("genre"), "embedding")
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("movie_id"), F.year("o_orderdate").alias("year"))
    return d.join(e, "movie_id").join(o, "movie_id")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


MV = """mv AS (SELECT d.doc_id AS movie_id, d.text AS plot, d.lang AS country, d.n_chars, CAST(e.label AS INT) AS genre, e.embedding::DOUBLE[] AS embedding, CAST(year(o.o_orderdate) AS INT) AS year
 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id JOIN orders o ON o.o_orderkey = d.doc_id)"""
CENT = MV + """, x AS (SELECT genre, year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv),
c AS (SELECT genre, year, pos, avg(v) m, count(*) n FROM x GROUP BY ALL), g AS (SELECT genre, year, max(n) n, list(m ORDER BY pos) c FROM c GROUP BY ALL)"""
VEL = CENT + """, l AS (SELECT *, lead(c) OVER w nx, lead(n) OVER w nn FROM g WINDOW w AS (PARTITION BY genre ORDER BY year)),
vel AS (SELECT genre, year, n, nn AS next_n, 1 - list_cosine_similarity(c, nx) AS velocity FROM l WHERE nx IS NOT NULL)"""
EM = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


# --- drift -------------------------------------------------------------------------------------------------
@query(f"WITH {VEL} SELECT genre, year, n, next_n, round(velocity, 6) AS velocity FROM vel")
def genre_drift_velocity(spark, sf):
    return r6(temporal.drift_velocity(movies(spark, sf)), "velocity")


@query(f"WITH {CENT}, d AS (SELECT genre, year, CAST(pos - 1 AS INT) AS pos, lead(m) OVER (PARTITION BY genre, pos ORDER BY year) - m AS diff FROM c) SELECT genre, year, pos, round(diff, 6) + 0.0 AS diff FROM d WHERE diff IS NOT NULL")
def drift_vector_components(spark, sf):
    return r6(temporal.drift_components(movies(spark, sf)), "diff")


@query(f"WITH {VEL}, a AS (SELECT genre, year, lead(velocity) OVER (PARTITION BY genre ORDER BY year) - velocity AS a FROM vel) SELECT genre, year, round(a, 6) + 0.0 AS acceleration FROM a WHERE a IS NOT NULL")
def drift_acceleration(spark, sf):
    return r6(temporal.acceleration(temporal.drift_velocity(movies(spark, sf))), "acceleration")


@query(f"WITH {VEL} SELECT genre, year, round(sum(velocity) OVER (PARTITION BY genre ORDER BY year), 6) AS cumulative FROM vel")
def drift_cumulative(spark, sf):
    return r6(temporal.cumulative(temporal.drift_velocity(movies(spark, sf))), "cumulative")


PAIRS = CENT + ", p AS (SELECT a.year, a.genre AS genre_1, b.genre AS genre_2, 1 - list_cosine_similarity(a.c, b.c) AS distance FROM g a JOIN g b ON a.year = b.year AND a.genre < b.genre)"


@query(f"WITH {PAIRS} SELECT year, genre_1, genre_2, round(distance, 6) AS distance FROM p")
def genre_convergence_pairs(spark, sf):
    return r6(temporal.convergence_pairs(movies(spark, sf)), "distance")


@query(f"WITH {PAIRS}, b AS (SELECT year, genre_1 AS genre, distance FROM p UNION ALL SELECT year, genre_2, distance FROM p) SELECT year, genre, round(avg(distance), 6) AS mean_distance FROM b GROUP BY ALL")
def genre_convergence_mean(spark, sf):
    return r6(temporal.convergence_mean(temporal.convergence_pairs(movies(spark, sf))), "mean_distance")


@query(f"""WITH {MV}, x AS (SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), c AS (SELECT decade, pos, avg(v) m FROM x GROUP BY ALL), g AS (SELECT decade, list(m ORDER BY pos) c FROM c GROUP BY ALL),
l AS (SELECT decade, c, lead(c) OVER (ORDER BY decade) nx FROM g) SELECT decade, round(1 - list_cosine_similarity(c, nx), 6) AS velocity FROM l WHERE nx IS NOT NULL""")
def decade_drift(spark, sf):
    m = movies(spark, sf).select(F.lit(0).alias("genre"), temporal.period(F.col("year"), 10).alias("year"), "embedding")
    return r6(temporal.drift_velocity(m).select(F.col("year").alias("decade"), "velocity"), "velocity")


MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)"


def months(spark, sf):
    return read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(f"WITH {MONTHS} SELECT month, n, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean_3, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mean_4 FROM m")
def smoothed_series_centered(spark, sf):
    return r6(months(spark, sf).select("month", "n", temporal.centred_mean("n", "month", 3).alias("mean_3"), temporal.centred_mean("n", "month", 4).alias("mean_4")), "mean_3", "mean_4")


@query(f"WITH {MONTHS} SELECT month, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS sma_3, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS sma_10, round(n / max(n) OVER (), 6) AS share FROM m")
def trailing_sma(spark, sf):
    return r6(months(spark, sf).select("month", temporal.trailing_mean("n", "month", 3).alias("sma_3"), temporal.trailing_mean("n", "month", 10).alias("sma_10"), (F.col("n") / F.max("n").over(W.partitionBy())).alias("share")), "sma_3", "sma_10", "share")


# --- similarity --------------------------------------------------------------------------------------------
def emb(spark, sf):
    return read(spark, sf, "embeddings")


@query(f"WITH {EM}, a AS (SELECT v AS a FROM e WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(v, a), 6) AS distance, row_number() OVER (ORDER BY 1 - list_cosine_similarity(v, a), vec_id) AS rank FROM e, a WHERE vec_id <> 0 ORDER BY rank LIMIT 10")
def knn_topk(spark, sf):
    e = emb(spark, sf)
    return r6(similarity.nearest(e, similarity.anchor(e, [0], "vec_id"), "vec_id", 10, [0]), "distance")


def _multi(agg):
    return f"WITH {EM}, x AS (SELECT unnest(v) v, generate_subscripts(v, 1) pos FROM e WHERE vec_id IN (1, 2, 3)), c AS (SELECT pos, {agg} m FROM x GROUP BY pos), a AS (SELECT list(m ORDER BY pos) a FROM c), d AS (SELECT vec_id, 1 - list_cosine_similarity(v, a) AS d FROM e, a WHERE vec_id NOT IN (1, 2, 3)) SELECT vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) AS rank FROM d ORDER BY rank LIMIT 10"


@query(_multi("avg(v)"))
def knn_multi_anchor_mean(spark, sf):
    e = emb(spark, sf)
    return r6(similarity.nearest(e, similarity.anchor(e, [1, 2, 3], "vec_id"), "vec_id", 10, [1, 2, 3]), "distance")


@query(_multi("quantile_cont(v, 0.5)"))
def knn_multi_anchor_median(spark, sf):
    e = emb(spark, sf)
    return r6(similarity.nearest(e, similarity.anchor(e, [1, 2, 3], "vec_id", method="median"), "vec_id", 10, [1, 2, 3]), "distance")


@query(f"WITH {EM}, a AS (SELECT v AS a FROM e WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(v, a), 6) AS distance, row_number() OVER (ORDER BY list_cosine_similarity(v, a), vec_id) AS rank FROM e, a WHERE vec_id <> 0 ORDER BY rank LIMIT 10")
def farthest_topk(spark, sf):
    e = emb(spark, sf)
    return r6(similarity.nearest(e, similarity.anchor(e, [0], "vec_id"), "vec_id", 10, [0], farthest=True), "distance")


@query(f"WITH {EM}, a AS (SELECT v AS a FROM e WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(v, a), 6) AS distance FROM e, a WHERE vec_id <> 0 AND 1 - list_cosine_similarity(v, a) <= 0.8")
def epsilon_ball(spark, sf):
    e = emb(spark, sf)
    return r6(similarity.epsilon_ball(e, similarity.anchor(e, [0], "vec_id"), "vec_id", 0.8, [0]), "distance")


@query(f"WITH {EM}, a AS (SELECT v AS a FROM e WHERE vec_id = 0), d AS (SELECT 1 - list_cosine_similarity(v, a) AS d FROM e, a WHERE vec_id <> 0), g AS (SELECT i / 10.0::DOUBLE AS eps FROM range(0, 21) t(i)) SELECT CAST(eps AS DOUBLE) AS eps, (SELECT count(*) FROM d WHERE d <= eps) AS neighbours FROM g")
def neighbours_vs_epsilon(spark, sf):
    e = emb(spark, sf)
    return similarity.counts_by_epsilon(similarity.distances(e, similarity.anchor(e, [0], "vec_id"), "vec_id", exclude=[0]), [i / 10 for i in range(21)])


NOV = MV + ", n AS (SELECT a.movie_id, a.year, min(1 - list_cosine_similarity(a.embedding, b.embedding)) AS novelty FROM mv a JOIN mv b ON b.year < a.year GROUP BY ALL)"


def _novel(spark, sf):
    m = movies(spark, sf).select("movie_id", "year", "embedding")
    return similarity.novelty(m, "movie_id", "year").join(m.select("movie_id", "year"), "movie_id")


@query(f"WITH {NOV} SELECT movie_id, year, round(novelty, 6) + 0.0 AS novelty FROM n")
def novelty_per_movie(spark, sf):
    return r6(_novel(spark, sf), "novelty")


@query(f"WITH {NOV} SELECT year, count(*) AS n, round(avg(novelty), 6) AS mean_novelty, round(stddev_samp(novelty), 6) AS std_novelty FROM n GROUP BY year")
def novelty_by_year(spark, sf):
    return r6(_novel(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.avg("novelty").alias("mean_novelty"), F.stddev_samp("novelty").alias("std_novelty")), "mean_novelty", "std_novelty")


@query(f"WITH {NOV}, y AS (SELECT year, avg(novelty) AS m FROM n GROUP BY year) SELECT round(regr_slope(m, year), 6) + 0.0 AS slope, round(regr_intercept(m, year), 4) AS intercept, round(regr_r2(m, year), 6) AS r2, count(*) AS n FROM y")
def novelty_trend(spark, sf):
    y = _novel(spark, sf).groupBy("year").agg(F.avg("novelty").alias("m"))
    return r6(stats.ols(y, "m", "year"), "slope", "r2").withColumn("intercept", F.round("intercept", 4))


@query(f"WITH {EM}, s AS (SELECT a.label, a.vec_id, round(sum(1 - list_cosine_similarity(a.v, b.v)), 6) AS d FROM e a JOIN e b ON a.label = b.label GROUP BY ALL) SELECT label, arg_min(vec_id, d) AS vec_id, min(d) AS sum_distance FROM s GROUP BY label")
def medoid_per_group(spark, sf):
    return r6(similarity.medoids(emb(spark, sf), "label", "vec_id").drop("embedding"), "sum_distance")


@query(f"WITH {EM}, x AS (SELECT unnest(v) v, generate_subscripts(v, 1) pos FROM e), c AS (SELECT pos, avg(v) m FROM x GROUP BY pos), a AS (SELECT list(m ORDER BY pos) a FROM c) SELECT vec_id, round(1 - list_cosine_similarity(v, a), 6) AS distance FROM e, a ORDER BY 1 - list_cosine_similarity(v, a), vec_id LIMIT 10")
def most_average(spark, sf):
    e = emb(spark, sf)
    mean = V.mean_vectors(e, [], out="anchor").select("anchor")
    return r6(similarity.nearest(e, mean, "vec_id", 10).drop("rank"), "distance")


@query(f"WITH {EM} SELECT a.label, (SELECT count(*) FROM e x WHERE x.label = a.label) AS n, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS mean_distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def within_group_distance(spark, sf):
    return r6(similarity.within_distance(emb(spark, sf), "label"), "mean_distance")


@query(f"WITH {EM} SELECT a.label AS label_1, b.label AS label_2, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS mean_distance FROM e a JOIN e b ON a.label < b.label GROUP BY ALL")
def between_group_distance(spark, sf):
    return r6(similarity.between_distance(emb(spark, sf), "label"), "mean_distance")


@query(f"WITH {EM} SELECT CAST(a.label AS VARCHAR) AS key, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS mean_cosine, round(var_pop(list_cosine_similarity(a.v, b.v)), 6) AS var_cosine, round(stddev_pop(list_cosine_similarity(a.v, b.v)), 6) AS std_cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def cluster_cosine_stats(spark, sf):
    return r6(similarity.cosine_stats(emb(spark, sf), "label"), "mean_cosine", "var_cosine", "std_cosine")


@query(f"WITH {EM} SELECT '' AS key, count(*) AS n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS mean_cosine, round(var_pop(list_cosine_similarity(a.v, b.v)), 6) AS var_cosine, round(stddev_pop(list_cosine_similarity(a.v, b.v)), 6) AS std_cosine FROM e a JOIN e b ON a.vec_id < b.vec_id")
def global_cosine_stats(spark, sf):
    return r6(similarity.cosine_stats(emb(spark, sf), None), "mean_cosine", "var_cosine", "std_cosine")


@query(f"WITH {EM}, u AS (SELECT unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) x, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(x) m, count(*) n FROM u GROUP BY pos) SELECT max(n) AS n, round(sqrt(sum(m * m)), 6) AS resultant, round(max(n) * count(*) * sum(m * m), 4) AS rayleigh FROM m")
def resultant_length(spark, sf):
    return r6(similarity.resultant_length(emb(spark, sf)), "resultant").withColumn("rayleigh", F.round("rayleigh", 4))


# --- grouped moments ---------------------------------------------------------------------------------------
GP = CENT + ", s AS (SELECT genre, year, pos, var_samp(v) var, count(*) n, avg(v) m FROM x GROUP BY ALL)"


@query(f"WITH {GP} SELECT CAST(pos - 1 AS INT) AS pos, round(sqrt(sum((n - 1) * var) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1)), 6) AS pooled_sigma, round(sum(n * m) / sum(n), 6) + 0.0 AS weighted_mean FROM s GROUP BY pos")
def pooled_moments_dim(spark, sf):
    return r6(temporal.pooled_moments(movies(spark, sf), ["genre", "year"]), "pooled_sigma", "weighted_mean")


@query(f"""WITH {GP}, q AS (SELECT * FROM s WHERE pos = 4), p AS (SELECT sqrt(sum((n - 1) * var) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1)) sg, sum(n * m) / sum(n) mu FROM q), b AS (SELECT year, avg(m) m, sum(n) n FROM q GROUP BY year)
SELECT year, round(m, 6) + 0.0 AS mean_value, CAST(n AS BIGINT) AS n, round((m - mu) / sg, 6) + 0.0 AS z, round((m - mu) / (sg / sqrt(n)), 6) + 0.0 AS z_se FROM b, p""")
def zscore_dim_by_year(spark, sf):
    return r6(temporal.zscore_dimension(movies(spark, sf), 3), "mean_value", "z", "z_se")


@query(f"WITH {MV}, x AS (SELECT year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), c AS (SELECT year, pos, avg(v) m, count(*) n, sum(v * v) q FROM x GROUP BY ALL) SELECT CAST(year AS VARCHAR) AS year, max(n) AS n, round(sqrt(sum(q - n * m * m)), 5) AS frobenius FROM c GROUP BY year")
def frobenius_by_year(spark, sf):
    return linalg.group_spectra(movies(spark, sf), "year").select(F.col("key").alias("year"), "n", F.round("frobenius", 5).alias("frobenius"))


@query()
def spectral_by_year(spark, sf):
    return r6(linalg.group_spectra(movies(spark, sf), "year"), "frobenius", "spectral", "pve")


@query(f"WITH {MV}, x AS (SELECT movie_id, year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), c AS (SELECT year, pos, avg(v) m FROM x GROUP BY ALL), d AS (SELECT x.movie_id, x.year, sqrt(sum((v - m) ** 2)) d FROM x JOIN c USING (year, pos) GROUP BY ALL) SELECT year, round(avg(d), 6) AS mean_l2 FROM d GROUP BY year")
def mean_l2_by_year(spark, sf):
    m = movies(spark, sf)
    j = m.join(V.mean_vectors(m, ["year"]).select("year", "centroid"), "year")
    return r6(j.groupBy("year").agg(F.avg(V.norm(V.subtract(V.doubles("embedding"), F.col("centroid")))).alias("mean_l2")), "mean_l2")


@query(f"WITH {MV}, x AS (SELECT year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), c AS (SELECT year, pos, avg(v) m FROM x GROUP BY ALL), t AS (SELECT pos, avg(v) m FROM x GROUP BY pos) SELECT year, round(sqrt(sum((c.m - t.m) ** 2)), 6) AS centroid_l2 FROM c JOIN t USING (pos) GROUP BY year")
def centroid_l2_by_year(spark, sf):
    m = movies(spark, sf)
    c = V.mean_vectors(m, ["year"]).crossJoin(F.broadcast(V.mean_vectors(m, [], out="middle").select("middle")))
    return r6(c.select("year", V.norm(V.subtract(F.col("centroid"), F.col("middle"))).alias("centroid_l2")), "centroid_l2")


DIR = MV + """, x AS (SELECT genre, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), c AS (SELECT genre, pos, avg(v) m FROM x WHERE genre IN (0, 1) GROUP BY ALL),
dir AS (SELECT list(m1 - m0 ORDER BY pos) d FROM (SELECT pos, max(m) FILTER (WHERE genre = 1) m1, max(m) FILTER (WHERE genre = 0) m0 FROM c GROUP BY pos)), p AS (SELECT movie_id, year, list_inner_product(embedding, d) AS s FROM mv, dir)"""


def _projection(spark, sf):
    m = movies(spark, sf)
    c = V.mean_vectors(m.where("genre IN (0, 1)"), ["genre"])
    d = c.agg(F.max_by("centroid", "genre").alias("one"), F.min_by("centroid", "genre").alias("zero")).select(V.subtract(F.col("one"), F.col("zero")).alias("d"))
    return m.crossJoin(F.broadcast(d)).select("movie_id", "year", V.dot(V.doubles("embedding"), F.col("d")).alias("score"))


@query(f"WITH {DIR} SELECT movie_id, round(s, 6) + 0.0 AS score FROM p")
def projection_on_direction(spark, sf):
    return r6(_projection(spark, sf).select("movie_id", "score"), "score")


@query(f"WITH {DIR} SELECT year, count(*) AS n, round(avg(s), 6) + 0.0 AS mean, round(stddev_pop(s), 6) AS std, round(kurtosis_pop(s), 5) + 0.0 AS kurtosis FROM p GROUP BY year")
def projection_moments(spark, sf):
    p = _projection(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.kurtosis("score").alias("kurtosis"))
    return r6(p, "mean", "std").withColumn("kurtosis", F.round("kurtosis", 5) + 0.0)


@query()
def pca_explained(spark, sf):
    return r6(linalg.pca_explained(emb(spark, sf)), "eigenvalue", "ratio", "cumulative")


@query()
def mahalanobis_outliers(spark, sf):
    return r6(linalg.mahalanobis(emb(spark, sf), "vec_id"), "d2")


@query()
def whitened_spread(spark, sf):
    return r6(V.long_form(linalg.whiten(emb(spark, sf), normalise=False), []).groupBy("pos").agg(F.var_samp("x").alias("variance")), "variance")


@query()
def debiased_mean_distance(spark, sf):
    return r6(similarity.within_distance(linalg.debias(emb(spark, sf), 3), "label"), "mean_distance")


@query()
def kmeans_sizes(spark, sf):
    return linalg.kmeans(emb(spark, sf), "vec_id", 10).groupBy("cluster").agg(F.count("*").alias("n"))


# --- distributions -----------------------------------------------------------------------------------------
def events(spark, sf):
    return read(spark, sf, "events")


KINDS = "k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events)"


def _kinds(spark, sf):
    return tuple(events(spark, sf).agg(F.min("event_type"), F.max("event_type")).first())


KS = f"{KINDS}, c AS (SELECT value, count(*) FILTER (WHERE event_type = a) ca, count(*) FILTER (WHERE event_type = b) cb FROM events, k GROUP BY value), r AS (SELECT abs(sum(ca) OVER o / sum(ca) OVER () - sum(cb) OVER o / sum(cb) OVER ()) AS d, sum(ca) OVER () AS na, sum(cb) OVER () AS nb FROM c WINDOW o AS (ORDER BY value)), ks AS (SELECT max(d) AS d, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM r)"


@query(f"WITH {KS} SELECT round(d, 6) AS d, n_a, n_b FROM ks")
def ks_distance(spark, sf):
    return r6(stats.ks_distance(events(spark, sf), "value", "event_type", *_kinds(spark, sf)), "d")


@query(f"WITH {KS} SELECT CASE WHEN d < 0.1 THEN 'negligible' WHEN d < 0.2 THEN 'small' WHEN d < 0.3 THEN 'medium' ELSE 'large' END AS effect, least(n_a, n_b) > 1000 AS large_samples FROM ks")
def ks_interpret(spark, sf):
    k = stats.ks_distance(events(spark, sf), "value", "event_type", *_kinds(spark, sf))
    return k.select(stats.ks_effect(F.col("d")).alias("effect"), (F.least("n_a", "n_b") > 1000).alias("large_samples"))


@query(f"WITH {MV}, c AS (SELECT year, count(*) FILTER (WHERE genre = 0) a, count(*) FILTER (WHERE genre = 1) b FROM mv GROUP BY year), r AS (SELECT abs(sum(a) OVER o / sum(a) OVER () - sum(b) OVER o / sum(b) OVER ()) AS d, sum(a) OVER () n, sum(b) OVER () m FROM c WINDOW o AS (ORDER BY year)) SELECT round(max(d), 6) AS d, CAST(max(n) AS BIGINT) AS n_a, CAST(max(m) AS BIGINT) AS n_b FROM r")
def ks_temporal(spark, sf):
    c = movies(spark, sf).where("genre IN (0, 1)").groupBy("year", "genre").agg(F.count("*").alias("c"))
    return r6(stats.ks_distance(c, "year", "genre", 0, 1, weight="c"), "d")


@query("SELECT DISTINCT value, round(cume_dist() OVER (ORDER BY value), 6) AS cdf FROM events WHERE value IS NOT NULL")
def ecdf(spark, sf):
    return r6(stats.ecdf(events(spark, sf), "value"), "cdf")


@query("WITH s AS (SELECT min(value) lo, max(value) hi, count(value) t FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n, round(count(*) / (max(t) * max((hi - lo) / 50)), 6) AS density FROM events, s GROUP BY 1")
def histogram50(spark, sf):
    return r6(stats.histogram(events(spark, sf), "value", 50), "density")


@query()  # its SQL stands in spaces.py
def qq_pairs(spark, sf):
    return r6(stats.qq_pairs(events(spark, sf), "value"), "theoretical")


@query("""WITH s AS (SELECT min(value) lo, max(value) hi, stddev_samp(value) * power(count(value), -0.2) h, count(value) n FROM events), g AS (SELECT lo + (hi - lo) * i / 199 AS x, h, n FROM s, range(0, 200) t(i))
SELECT round(x, 6) AS x, round(sum(exp(-(((x - value) / h) ** 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM g, events GROUP BY x""")
def kde_grid(spark, sf):
    return r6(stats.kde(events(spark, sf), "value"), "x", "density")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) w FROM documents), c AS (SELECT doc_id, w, count(*) c FROM t GROUP BY ALL), f AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY doc_id),
j AS (SELECT coalesce(f.e, 0) AS e, l.quality AS y FROM labels l JOIN documents d USING (doc_id) LEFT JOIN f USING (doc_id)), g AS (SELECT round(e, 6) AS e, sum(y) p, count(*) c FROM j GROUP BY 1), h AS (SELECT e, sum(p) OVER o tp, sum(c) OVER o got, sum(p) OVER () a FROM g WINDOW o AS (ORDER BY e DESC)),
s AS (SELECT e, 1.25 * tp / (0.25 * a + got) AS f FROM h) SELECT e AS threshold, round(f, 6) AS f_beta FROM s ORDER BY f DESC, e LIMIT 1""")
def entropy_threshold_fbeta(spark, sf):
    e = relational.token_features(read(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("e"))
    return r6(stats.fbeta_threshold(read(spark, sf, "labels").join(e, "doc_id"), "e", "quality"), "f_beta")


@query("WITH y AS (SELECT year(o_orderdate) AS y, avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%') a, avg(o_totalprice) b FROM orders GROUP BY 1), d AS (SELECT a - b AS d FROM y) SELECT round(avg(abs(d)), 4) AS mae, round(stddev_samp(abs(d)), 4) AS mae_std, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, count(d) AS n FROM d")
def paired_series(spark, sf):
    y = read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg(F.when(F.col("o_orderpriority").like("1%"), F.col("o_totalprice"))).alias("a"), F.avg("o_totalprice").alias("b"))
    return r6(stats.paired(y, "a", "b"), "t").withColumns({"mae": F.round("mae", 4), "mae_std": F.round("mae_std", 4)})


@query("SELECT round(regr_slope(value, ln(1 + user_id)), 6) + 0.0 AS slope, round(regr_intercept(value, ln(1 + user_id)), 6) AS intercept, round(regr_r2(value, ln(1 + user_id)), 6) AS r2, count(*) AS n FROM events")
def log_fit(spark, sf):
    return r6(stats.ols(events(spark, sf).withColumn("lx", F.log(1.0 + F.col("user_id"))), "value", "lx"), "slope", "intercept", "r2")


# --- texts and cleaning ------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) w FROM documents), c AS (SELECT doc_id, w, count(*) c FROM t GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_tokens, count(w) AS n_distinct, round(coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0), 6) + 0.0 AS entropy FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def token_entropy(spark, sf):
    return r6(relational.token_features(read(spark, sf, "documents"), "doc_id", "text"), "entropy")


@query("""SELECT count(text) AS n, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, min(length(text)) AS min, max(length(text)) AS max, round(stddev_samp(length(text)), 6) AS std FROM documents""")
def text_length_stats(spark, sf):
    n = F.length("text")
    return r6(read(spark, sf, "documents").agg(F.count("text").alias("n"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"), F.stddev_samp(n).alias("std")), "mean", "std")


@query("""WITH f AS (SELECT trim(text) <> '' AS a, length(trim(text)) > 200 AS b, length(trim(text)) <= 14000 AS c, quality IS NULL OR quality = 1 AS d FROM documents LEFT JOIN labels USING (doc_id))
SELECT 0 AS step, 'with text' AS name, count(*) FILTER (WHERE a) AS n FROM f UNION ALL SELECT 1, 'not short', count(*) FILTER (WHERE a AND b) FROM f UNION ALL SELECT 2, 'not long', count(*) FILTER (WHERE a AND b AND c) FROM f UNION ALL SELECT 3, 'not bad', count(*) FILTER (WHERE a AND b AND c AND d) FROM f""")
def clean_funnel(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    n = F.length(F.trim("text"))
    return relational.clean_funnel(d, "doc_id", "text", [("with text", F.trim("text") != ""), ("not short", n > 200), ("not long", n <= 14000), ("not bad", F.col("quality").isNull() | (F.col("quality") == 1))])


@query("""WITH l AS (SELECT source AS by_value, 'text' AS field, text AS v FROM documents UNION ALL SELECT source, 'lang', lang FROM documents), m AS (SELECT *, v IS NOT NULL AND trim(v) <> '' AND lower(trim(v)) <> 'nan' AS ok FROM l)
SELECT by_value, field, count(*) AS total, count(*) FILTER (WHERE ok) AS present, round(avg(length(v)) FILTER (WHERE ok), 6) AS avg_length, max(length(v)) FILTER (WHERE ok) AS max_length, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 2) AS percent FROM m GROUP BY GROUPING SETS ((by_value, field), (field))""")
def field_completeness(spark, sf):
    return r6(stats.field_completeness(read(spark, sf, "documents"), ["text", "lang"], "source"), "avg_length")


@query("""WITH r AS (SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), b AS (SELECT r.*, (SELECT max(i) FROM range(0, 10) t(i) WHERE floor(i * r.n / 10) <= r.r) AS bucket FROM r)
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, min(len) AS min_length, max(len) AS max_length FROM b GROUP BY bucket""")
def length_bucket_stats(spark, sf):
    b = relational.length_buckets(read(spark, sf, "documents").withColumn("len", F.length("text").cast("long")), "doc_id", "len", 10)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.min("len").alias("min_length"), F.max("len").alias("max_length"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '\\r\\n|\\r|\\n', ' ', 'g'), ' +', ' ', 'g'))) AS cleaned, md5(regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS stripped FROM pages")
def clean_page_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(X.clean_text(F.col("html"))).alias("cleaned"), F.md5(X.strip_controls(F.col("html"))).alias("stripped"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_titles(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


# --- multi-valued attributes and lookups -------------------------------------------------------------------
WORDS = "w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)"


def words(spark, sf):
    return relational.explode_list(read(spark, sf, "part"), "p_name", " ", "word")


@query(f"WITH {WORDS} SELECT * FROM w")
def explode_genres(spark, sf):
    return words(spark, sf).select("p_partkey", "word")


@query(f"WITH {WORDS}, t AS (SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 5) SELECT w.p_partkey, w.word FROM w JOIN t USING (word)")
def genre_top_n(spark, sf):
    w = words(spark, sf)
    return w.join(F.broadcast(relational.top_values(w, "word", 5)), "word", "left_semi").select("p_partkey", "word")


@query(f"WITH {WORDS}, t AS (SELECT word, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS INT) AS rank FROM w GROUP BY word) SELECT * FROM t WHERE rank IN (0, 2, 999)")
def genre_rank_select(spark, sf):
    return relational.values_at_ranks(words(spark, sf), "word", [0, 2, 999])


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' x' || p_partkey, ' ')) AS word, generate_subscripts(string_split(p_name || ' x' || p_partkey, ' '), 1) AS pos FROM part), c AS (SELECT word FROM w GROUP BY word HAVING count(*) > 1)
SELECT p_partkey, string_agg(word, ' ' ORDER BY pos) AS p_name FROM w WHERE word IN (SELECT word FROM c) GROUP BY p_partkey""")
def singleton_genre_removal(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat_ws("", "p_name", F.lit(" x"), "p_partkey").alias("p_name"))
    return relational.drop_single_values(p, "p_partkey", "p_name", " ").where("p_name <> ''")


# A small lookup of words to clusters.
LOOKUP = [("almond", "a"), ("azure", "a"), ("blue", "b"), ("green", "b"), ("red", "c"), ("steel", "d"), ("widget", "e")]


@query(f"WITH {WORDS}, l(word, cluster) AS (VALUES {', '.join(str(x) for x in LOOKUP)}), m AS (SELECT p_partkey, string_agg(DISTINCT cluster, '|' ORDER BY cluster) AS mapped FROM w JOIN l USING (word) GROUP BY p_partkey) SELECT p.p_partkey, m.mapped FROM part p LEFT JOIN m USING (p_partkey)")
def list_map_lookup(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("values"))
    lookup = spark.createDataFrame(LOOKUP, "word string, cluster string")
    return relational.map_lists(p, "p_partkey", "values", F.broadcast(lookup), "word", "cluster")


@query("WITH p AS (SELECT string_split(p_name, ' ') AS a, [p_brand, p_type] AS b FROM part), z AS (SELECT unnest(list_zip(a, b)) AS z FROM p) SELECT z[1] AS name, string_agg(DISTINCT z[2], ',' ORDER BY z[2]) AS ids FROM z WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL GROUP BY 1")
def arrays_zip_ids(spark, sf):
    p = read(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("names"), F.concat_ws(",", "p_brand", "p_type").alias("ids"))
    return relational.zip_lists(p, "names", "ids")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 're') AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))")
def keyword_search(spark, sf):
    p = read(spark, sf, "part")
    return p.where(X.contains_all([F.col("p_name")], ["RE", " "]) & X.contains_all([F.col("p_name"), F.col("p_type")], ["a"])).select("p_partkey").distinct()


@query("WITH t AS (SELECT lower(trim(p_name)) AS title, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY 1) SELECT title, len(ids) AS n, ids[1] AS first_id FROM t WHERE title IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey <= 5)")
def title_match(spark, sf):
    p = read(spark, sf, "part").withColumn("title", F.lower(F.trim("p_name")))
    asked = p.where("p_partkey <= 5").select("title").distinct()
    return p.join(asked, "title", "left_semi").groupBy("title").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def ratings_left_join(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")


@query("SELECT d.source, count(*) AS n, count(*) FILTER (WHERE coalesce(l.quality, 0) = 0) AS missing, round(100.0 * count(*) FILTER (WHERE coalesce(l.quality, 0) = 0) / count(*), 6) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def missing_rating_pct(spark, sf):
    j = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    gone = F.count_if(F.coalesce("quality", F.lit(0)) == 0)
    return r6(j.groupBy("source").agg(F.count("*").alias("n"), gone.alias("missing"), (100.0 * gone / F.count("*")).alias("percent")), "percent")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS flagged FROM documents")
def semi_flag(spark, sf):
    t = read(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return read(spark, sf, "documents").select("doc_id").join(t, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("flagged"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT country, n FROM (SELECT lang AS country, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, country LIMIT 20")
def country_counts(spark, sf):
    return relational.top_values(read(spark, sf, "documents").withColumnRenamed("lang", "country"), "country", 20)


@query("WITH a AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS n_f, coalesce(b.n, 0) AS n_o FROM a FULL JOIN b ON a.year = b.year")
def aligned_year_counts(spark, sf):
    o = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return o.where("o_orderstatus IN ('F', 'O')").groupBy("year").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS first_value, k AS first_key FROM (SELECT event_id, props, list_sort(json_keys(props))[1] AS k FROM events)")
def json_extract(spark, sf):
    m = F.from_json("props", "map<string,string>")
    k = F.array_sort(F.map_keys(m))[0]
    return events(spark, sf).select("event_id", F.try_element_at(m, k).alias("first_value"), k.alias("first_key"))


# --- samples -----------------------------------------------------------------------------------------------
@query(f"WITH {MV}, r AS (SELECT movie_id, year, row_number() OVER (PARTITION BY year ORDER BY md5(CAST(movie_id AS VARCHAR) || '-42'), movie_id) rn FROM mv) SELECT movie_id, year FROM r WHERE rn <= 5")
def per_group_sample(spark, sf):
    return relational.sample_per_group(movies(spark, sf).select("movie_id", "year"), "year", "movie_id", 5)


@query(f"WITH {MV}, r AS (SELECT movie_id, genre, row_number() OVER (PARTITION BY genre ORDER BY md5(CAST(movie_id AS VARCHAR) || '-42'), movie_id) rn, (SELECT min(c) FROM (SELECT count(*) c FROM mv GROUP BY genre)) m FROM mv) SELECT movie_id, genre FROM r WHERE rn <= m")
def min_group_downsample(spark, sf):
    return relational.downsample_to_smallest(movies(spark, sf).select("movie_id", "genre"), "genre", "movie_id")


@query("WITH r AS (SELECT doc_id, CAST(floor(length(text) / 500) AS INT) AS bin FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) rn FROM r) SELECT doc_id, bin FROM s WHERE rn <= 10")
def stratified_sample(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.length("text") / 500).cast("int").alias("bin"))
    return relational.sample_per_group(d, "bin", "doc_id", 10)


@query()
def poisson_bootstrap_ci(spark, sf):
    return r6(relational.poisson_bootstrap(_projection(spark, sf), "year", "movie_id", "score"), "median", "low", "high")


# --- graph patterns ----------------------------------------------------------------------------------------
@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's1', 'r1'), c AS (SELECT 'r0' AS root, 'r0' AS node UNION SELECT 'r1', 'r1' UNION SELECT c.root, e.child FROM c JOIN e ON e.parent = c.node) SELECT DISTINCT root, node FROM c""")
def subclass_closure(spark, sf):
    n = read(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    loop = spark.createDataFrame([("s1", "r1")], "parent string, child string")
    return relational.closure(n.unionByName(s).unionByName(loop), spark.createDataFrame([("r0",), ("r1",)], "node string"))


@query("SELECT o_orderkey FROM orders o WHERE year(o_orderdate) = 1996 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate)")
def not_exists_earlier(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return o.where(F.year("o_orderdate") == 1996).join(first, "o_custkey").where("o_orderdate <= first").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1)) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def minus_pattern(spark, sf):
    inside = read(spark, sf, "nation").where("n_regionkey IN (0, 1)").select(F.col("n_nationkey").alias("c_nationkey"))
    out = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(F.broadcast(inside), "c_nationkey", "left_semi").select("c_custkey").join(out, "c_custkey", "left_anti").distinct()


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities, min(o_orderdate) AS first_date, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY o_custkey")
def group_concat_distinct(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("priorities"), F.min("o_orderdate").alias("first_date"), F.countDistinct("o_orderstatus").alias("n_status"))


@query("WITH o AS (SELECT o_custkey, count(*) n, max(o_totalprice) p FROM orders GROUP BY 1), l AS (SELECT o_custkey, sum(l_quantity) q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT c_custkey, coalesce(n, 0) AS n_orders, p AS max_price, round(CAST(q AS DOUBLE), 2) AS quantity FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey")
def preaggregated_optional_joins(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    a = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("max_price"))
    li = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    b = li.join(o.select("o_orderkey", "c_custkey"), "o_orderkey").groupBy("c_custkey").agg(F.round(F.sum("q").cast("double"), 2).alias("quantity"))
    return read(spark, sf, "customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "max_price", "quantity")


# --- chunking ----------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(ceil((len(t) - 128) / 64.0), 0) AS INT) + 1)) * 64 AS start FROM t WHERE len(t) > 0)
SELECT doc_id, CAST(start AS INT) AS start, CAST(len(t[start + 1:start + 128]) AS INT) AS n, md5(array_to_string(t[start + 1:start + 128], ' ')) AS chunk FROM s""")
def chunk_windows(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return relational.chunk_windows(d, "doc_id", "t", 128, 64).select("doc_id", "start", F.size("chunk").alias("n"), F.md5(F.array_join("chunk", " ")).alias("chunk"))


@query(f"WITH {EM}, x AS (SELECT label, unnest(v) v, generate_subscripts(v, 1) pos FROM e), m AS (SELECT label, pos, avg(v) m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) n FROM m GROUP BY label) SELECT m.label, CAST(pos - 1 AS INT) AS pos, round(m / n, 6) + 0.0 AS x FROM m JOIN n USING (label)")
def mean_pool(spark, sf):
    p = V.mean_vectors(emb(spark, sf), ["label"]).select("label", V.unit(F.col("centroid")).alias("embedding"))
    return r6(V.long_form(p, ["label"]).withColumn("pos", F.col("pos").cast("int")), "x")


@query("""WITH p AS (SELECT conv_id, turn AS s, turn + 2 AS e, CAST(length(text) AS DOUBLE) AS w FROM conversations), q AS (SELECT conv_id, turn AS s, turn + 1 AS e, role AS term FROM conversations), j AS (SELECT p.conv_id, q.term, sum(p.w) AS w FROM p JOIN q ON p.conv_id = q.conv_id AND p.s < q.e AND p.e > q.s GROUP BY ALL)
SELECT conv_id, term, round(w / sum(w) OVER (PARTITION BY conv_id), 6) AS weight FROM j""")
def interval_overlap_weights(spark, sf):
    c = read(spark, sf, "conversations")
    p = c.select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 2).alias("e"), F.length("text").cast("double").alias("w"))
    q = c.select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 1).alias("e"), F.col("role").alias("term"))
    return r6(relational.overlap_weights(p, q, "conv_id"), "weight")


from quillon.plans import more, records, spaces  # noqa: E402,F401 - they register their queries here
