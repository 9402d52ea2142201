"""Queries that put several operators into one record."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import cleaning, gaussian, quality, reports, similarity, stats
from quillon.plans.queries import EM, MV, emb, events, movies, query, r6, read


@query(f"WITH {EM}, a AS (SELECT v AS a FROM e WHERE vec_id = 0), d AS (SELECT vec_id, round(1 - list_cosine_similarity(v, a), 12) AS d FROM e, a WHERE vec_id <> 0), i AS (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id) AS rank FROM d WHERE d <= 0.8) SELECT vec_id, p_name AS title, p_size AS size, round(d, 6) + 0.0 AS distance, round(1 - d, 6) + 0.0 AS similarity, rank FROM i LEFT JOIN part ON p_partkey = vec_id")
def epsilon_ball_rows(spark, sf):
    facts = read(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    e = emb(spark, sf)
    return r6(reports.ball_rows(e, similarity.anchor(e, [0], "vec_id"), "vec_id", facts, 0.8, [0]), "distance", "similarity")


@query(f"""WITH {MV}, a AS (SELECT embedding AS a FROM mv WHERE movie_id = 0), x AS (SELECT unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv), m AS (SELECT list(a ORDER BY pos) AS m FROM (SELECT pos, avg(v) AS a FROM x GROUP BY pos)),
s AS (SELECT year, list_cosine_similarity(embedding, a) >= 0.2 AS ball, list_cosine_similarity(embedding, m) >= 0.2 AS control FROM mv, a, m WHERE movie_id <> 0), c AS (SELECT year, count(*) FILTER (WHERE ball) AS x, count(*) FILTER (WHERE control) AS y FROM s GROUP BY year),
f AS (SELECT abs(sum(x) OVER o / sum(x) OVER () - sum(y) OVER o / sum(y) OVER ()) AS d, sum(x) OVER () AS n, sum(y) OVER () AS m FROM c WINDOW o AS (ORDER BY year)) SELECT round(max(d), 6) AS d, CAST(max(n) AS BIGINT) AS n_a, CAST(max(m) AS BIGINT) AS n_b FROM f""")
def epsilon_ball_temporal(spark, sf):
    """Years inside a ball around a film against years inside a control ball around the mean of all."""
    m = movies(spark, sf)
    near = similarity.distances(m, similarity.anchor(m, [0], "movie_id"), "movie_id", exclude=[0]).where("distance <= 0.8").select("movie_id", F.lit(0).alias("g"))
    control = quality.centroid_distance(m.where("movie_id IS NOT NULL"), "movie_id").where("movie_id <> 0 AND distance <= 0.8").select("movie_id", F.lit(1).alias("g"))
    years = m.select(F.col("movie_id").alias("id"), "year")
    both = near.unionByName(control).join(years, F.col("movie_id") == F.col("id")).groupBy("year", "g").agg(F.count("*").alias("c"))
    return r6(stats.ks_distance(both, "year", "g", 0, 1, weight="c"), "d")


@query(f"WITH {EM}, p AS (SELECT CASE WHEN a.label = b.label THEN 'intra' ELSE 'inter' END AS kind, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE a.label IS NOT NULL AND b.label IS NOT NULL) SELECT kind, count(*) AS n_pairs, round(avg(c), 6) + 0.0 AS mean, round(var_pop(c), 6) AS variance, round(stddev_pop(c), 6) AS std FROM p GROUP BY kind")
def spread_within_and_between(spark, sf):
    return r6(reports.spread_within_and_between(emb(spark, sf), "label"), "mean", "variance", "std")


@query(f"""WITH {MV}, r AS (SELECT movie_id, n_chars, embedding, row_number() OVER (ORDER BY n_chars, movie_id) - 1 AS r, count(*) OVER () AS n FROM mv), b AS (SELECT *, CAST((SELECT max(i) FROM range(0, 8) t(i) WHERE floor(i * r.n / 8) <= r.r) AS INT) AS bucket FROM r),
x AS (SELECT bucket, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM b), c AS (SELECT bucket, list(m ORDER BY pos) AS c FROM (SELECT bucket, pos, avg(v) AS m FROM x GROUP BY ALL) GROUP BY bucket),
d AS (SELECT bucket, count(*) AS n, max(n_chars) AS max_length, avg(1 - list_cosine_similarity(embedding, c)) AS cd FROM b JOIN c USING (bucket) GROUP BY bucket), p AS (SELECT a.bucket, avg(1 - list_cosine_similarity(a.embedding, z.embedding)) AS m, stddev_pop(list_cosine_similarity(a.embedding, z.embedding)) AS s FROM b a JOIN b z ON a.bucket = z.bucket AND a.movie_id < z.movie_id GROUP BY a.bucket)
SELECT bucket, n, max_length, round(cd, 6) AS centroid_distance, round(m, 6) AS mean, round(s, 6) AS std FROM d JOIN p USING (bucket)""")
def length_bucket_distances(spark, sf):
    return r6(reports.bucket_distances(movies(spark, sf), "movie_id", "n_chars", 8), "centroid_distance", "mean", "std")


GROUPS = {"french": "country = 'fr'", "long": "n_chars > 3000", "nobody": "n_chars < 0"}


@query(f"""WITH {MV}, g(name) AS (VALUES ('french'), ('long'), ('nobody')), f AS (SELECT name, movie_id, embedding, CASE name WHEN 'french' THEN country = 'fr' WHEN 'long' THEN n_chars > 3000 ELSE n_chars < 0 END AS inside FROM mv, g),
w AS (SELECT a.name, avg(1 - list_cosine_similarity(a.embedding, b.embedding)) FILTER (WHERE a.inside AND b.inside) AS within, avg(1 - list_cosine_similarity(a.embedding, b.embedding)) FILTER (WHERE a.inside <> b.inside) AS others, avg(1 - list_cosine_similarity(a.embedding, b.embedding)) AS everywhere FROM f a JOIN f b ON a.name = b.name AND a.movie_id < b.movie_id GROUP BY a.name)
SELECT f.name AS "group", count(*) FILTER (WHERE inside) AS n, round(max(within), 6) + 0.0 AS within, round(max(others), 6) + 0.0 AS others, round(max(everywhere), 6) + 0.0 AS everywhere FROM f JOIN w USING (name) GROUP BY f.name""")
def keyword_groups(spark, sf):
    return r6(reports.group_report(movies(spark, sf), {n: F.expr(c) for n, c in GROUPS.items()}), "within", "others", "everywhere")


@query(f"""WITH {EM}, r AS (SELECT vec_id, v, run, row_number() OVER (PARTITION BY run ORDER BY md5(CAST(vec_id AS VARCHAR) || '-' || (42 + run)), vec_id) AS k FROM e, range(0, 3) t(run)), s AS (SELECT * FROM r WHERE k <= 100),
p AS (SELECT a.run, list_cosine_similarity(a.v, b.v) AS c FROM s a JOIN s b ON a.run = b.run AND a.vec_id < b.vec_id) SELECT CAST(run AS INT) AS run, CAST(100 AS BIGINT) AS n, round(avg(c), 6) + 0.0 AS mean_cosine, round(stddev_pop(c), 6) AS std_cosine FROM p GROUP BY run""")
def repeated_samples(spark, sf):
    return r6(reports.repeated_samples(emb(spark, sf), "vec_id", 100, 3), "mean_cosine", "std_cosine")


@query()
def principal_extremes_by_year(spark, sf):
    return r6(reports.principal_extremes(movies(spark, sf).select("movie_id", "year", "embedding"), "movie_id", "year"), "score")


@query(f"""WITH {EM}, x AS (SELECT vec_id, unnest(v) v, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(v) m, var_samp(v) s FROM x GROUP BY pos), d AS (SELECT vec_id, sqrt(sum((v - m) ** 2 / s)) AS d FROM x JOIN m USING (pos) GROUP BY vec_id) SELECT vec_id, round(d, 6) AS distance FROM d WHERE round(d, 9) > 8.5""")
def high_distance_rows(spark, sf):
    d = gaussian.diagonal_distances(emb(spark, sf), "vec_id").select("vec_id", F.sqrt("d2").alias("distance"))
    return r6(d.where(F.round("distance", 9) > 8.5), "distance")


@query("""WITH s AS (SELECT min(value) lo, max(value) hi, stddev_samp(value) * power(count(value), -0.2) h, count(value) n, avg(value) m, stddev_pop(value) sd FROM events), g AS (SELECT lo + (hi - lo) * i / 199 AS x, h, n, m, sd FROM s, range(0, 200) t(i)),
d AS (SELECT x, sum(exp(-(((x - value) / h) ** 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())) AS density, max(m) AS m, max(sd) AS sd FROM g, events GROUP BY x) SELECT round(arg_max(x, density), 6) AS x, round(max(density), 6) AS density, round(max(m), 6) AS mean, round(max(sd), 6) AS std FROM d""")
def density_peak(spark, sf):
    e = events(spark, sf)
    moments = e.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return r6(stats.peak(stats.kde(e, "value")).join(moments), "x", "density", "mean", "std")  # one row each


_DRIFT = """x AS (SELECT genre, year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM z), c AS (SELECT genre, year, pos, avg(v) m, count(*) n FROM x GROUP BY ALL), g AS (SELECT genre, year, max(n) n, list(m ORDER BY pos) c FROM c GROUP BY ALL),
l AS (SELECT *, lead(c) OVER w nx, lead(n) OVER w nn FROM g WINDOW w AS (PARTITION BY genre ORDER BY year)), vel AS (SELECT genre, year, n, nn AS next_n, 1 - list_cosine_similarity(c, nx) AS velocity FROM l WHERE nx IS NOT NULL)"""


@query(f"WITH {MV}, r AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY md5(CAST(movie_id AS VARCHAR) || '-42'), movie_id) AS rn, (SELECT min(c) FROM (SELECT count(*) AS c FROM mv GROUP BY genre)) AS least FROM mv), z AS (SELECT * FROM r WHERE rn <= least), {_DRIFT} SELECT genre, year, n, next_n, round(velocity, 6) AS normalised FROM vel")
def drift_smallest_group(spark, sf):
    m = movies(spark, sf).select("movie_id", "genre", "year", "embedding")
    return r6(quality.drift_metrics(m, quality.SmallestGroup("genre", "movie_id")).select("genre", "year", "n", "next_n", "normalised"), "normalised")


@query(f"WITH {MV}, r AS (SELECT movie_id, genre, CAST(floor(year / 2) * 2 AS INT) AS year, embedding FROM mv), k AS (SELECT *, row_number() OVER (PARTITION BY genre, year ORDER BY movie_id) AS rn FROM r), z AS (SELECT * FROM k WHERE rn <= 12), {_DRIFT} SELECT genre, year, n, next_n, round(velocity, 6) AS normalised, round(sum(velocity) OVER (PARTITION BY genre ORDER BY year), 6) AS cumulative FROM vel")
def drift_two_year_groups(spark, sf):
    m = movies(spark, sf).select("movie_id", "genre", "year", "embedding")
    out = quality.drift_by_periods(m, "movie_id", quality.NoNormalization(), years=2, most=12)
    return r6(out.select("genre", "year", "n", "next_n", "normalised", "cumulative"), "normalised", "cumulative")


@query()
def drift_two_year_bootstrap(spark, sf):
    """Drift of two-year groups beside replicates of the same rows."""
    m = movies(spark, sf).select("movie_id", "genre", "year", "embedding")
    out = quality.drift_by_periods(m, "movie_id", quality.StandardError(["genre", "year"]), years=2, most=12, reps=8)
    return r6(out.select("genre", "year", "normalised", "median", "low", "high"), "normalised", "median", "low", "high")


# A small lookup of genre words.
LOOKUP = [("small", "1", "one"), ("red", "2", "two"), ("cold", "3", "three"), ("shiny", "1", "one"), ("hot", "2", "two")]


@query(f"""WITH d AS (SELECT doc_id, text, source, p_name || ' only' || doc_id AS g, lang FROM documents LEFT JOIN part ON p_partkey = doc_id), a AS (SELECT * FROM d WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(text)) <> 'nan' AND source NOT IN ('web')),
w AS (SELECT doc_id, unnest(string_split(g, ' ')) AS v, generate_subscripts(string_split(g, ' '), 1) AS pos FROM a), o AS (SELECT v FROM w WHERE v <> '' GROUP BY v HAVING count(*) > 1), l(raw, cluster, label) AS (VALUES {', '.join(map(str, LOOKUP))}),
t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) w FROM a), c AS (SELECT doc_id, w, count(*) c FROM t GROUP BY ALL), e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT cluster)) AS ids, array_to_string(list_sort(list(DISTINCT cluster)), ' ') AS cluster_ids, array_to_string(list_transform(list_sort(list(DISTINCT struct_pack(c := cluster, l := label))), lambda x: x.l), ' ') AS cluster_names FROM w JOIN o USING (v) JOIN l ON l.raw = w.v GROUP BY doc_id)
SELECT a.doc_id, length(text) AS plot_length, round(e, 6) AS entropy, coalesce(cluster_ids, '') AS cluster_ids, coalesce(cluster_names, '') AS cluster_names FROM a JOIN e USING (doc_id) LEFT JOIN m USING (doc_id) WHERE length(text) <= 14000 AND round(e, 6) >= 4.8398 AND NOT coalesce(list_contains(ids, '3'), false)""")
def cleaned_dataset(spark, sf):
    """The whole cleaning job: classes, single genres, length, entropy, clusters, blanks."""
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    d = read(spark, sf, "documents").join(p, F.col("doc_id") == F.col("p_partkey"), "left").withColumn("genres", F.concat("p_name", F.lit(" only"), F.col("doc_id").cast("string")))
    wrong = spark.createDataFrame([("web",)], "value string")
    lookup = spark.createDataFrame(LOOKUP, "raw string, cluster string, label string")
    out = cleaning.clean_collection(d, "doc_id", "text", "source", "genres", wrong, F.broadcast(lookup), ["3"], 4.8398, 14_000, ["cluster_ids", "cluster_names"], " ")
    return r6(out.select("doc_id", "plot_length", "entropy", "cluster_ids", "cluster_names"), "entropy")
