"""More queries over the driver's tables: cleaning, vector quality, normalised drift, patterns."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import cleaning, quality, relational, stats
from quillon.plans.queries import CENT, EM, MV, VEL, emb, events, movies, query, r6, read, words

CLASSES = ["widget", "bolt"]


@query("SELECT p_partkey FROM part WHERE p_name IS NULL OR NOT list_has_any(string_split(p_name, ' '), ['widget', 'bolt'])")
def excluded_classes(spark, sf):
    return cleaning.without_classes(read(spark, sf, "part"), "p_name", CLASSES, " ").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT list_contains(string_split(p_name, ' '), 'cold')")
def cluster_removal(spark, sf):
    return cleaning.without_value(read(spark, sf, "part"), "p_name", "cold", " ").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'small')")
def given_genre(spark, sf):
    return cleaning.with_value(read(spark, sf, "part"), "p_name", "small", " ").select("p_partkey")


def _labelled(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", "text").join(read(spark, sf, "labels"), "doc_id", "left")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def blanks_for_nulls(spark, sf):
    return cleaning.blanks_for_nulls(_labelled(spark, sf), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing(spark, sf):
    return _labelled(spark, sf).dropna(subset=["quality"]).select("doc_id", "quality")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND CAST(doc_id AS VARCHAR) LIKE '1%'")
def work_list(spark, sf):
    return cleaning.work_list(_labelled(spark, sf), "doc_id", "quality", "1").select("doc_id")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL")
def existing_ids(spark, sf):
    return cleaning.existing_ids(read(spark, sf, "labels"), "doc_id")


@query(f"WITH {MV} SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT movie_id FROM mv WHERE year BETWEEN 1996 AND 1998)")
def vectors_of_years(spark, sf):
    films = movies(spark, sf).select(F.col("movie_id").alias("vec_id"), "year")
    return cleaning.vectors_of_years(emb(spark, sf), films, "vec_id", "year", 1996, 1998).select("vec_id", "label")


@query(f"WITH {MV} SELECT movie_id, year FROM mv WHERE contains(lower(country), 'e') AND year BETWEEN 1995 AND 1999")
def old_genre_in_decade(spark, sf):
    m = movies(spark, sf).where(X.contains_all([F.col("country")], ["E"]) & F.col("year").between(1995, 1999))
    return m.select("movie_id", "year")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) w FROM documents), c AS (SELECT doc_id, w, count(*) c FROM t GROUP BY ALL), e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY doc_id)
SELECT doc_id, length(trim(text)) AS plot_length, round(e, 6) AS entropy FROM documents JOIN e USING (doc_id) WHERE trim(text) <> '' AND lower(trim(text)) <> 'nan' AND length(trim(text)) <= 14000 AND round(e, 6) >= 4.8398 AND source <> 'web'""")
def cleaned_collection(spark, sf):
    """The cleaning job: with a text, not too long, entropy high enough, class and cluster not excluded."""
    d = read(spark, sf, "documents")
    e = relational.token_features(d, "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))
    d = d.where(cleaning.present(F.col("text"))).withColumn("plot_length", F.length(F.trim("text")).cast("long")).where("plot_length <= 14000")
    return cleaning.without_value(d.join(e, "doc_id").where("entropy >= 4.8398"), "source", "web").select("doc_id", "plot_length", "entropy")


@query("SELECT string_agg(coalesce(p_name, CAST(i AS VARCHAR)), '__' ORDER BY pos) AS name FROM (VALUES (0, 7), (1, 3), (2, -5)) t(pos, i) LEFT JOIN part ON p_partkey = i")
def anchor_names(spark, sf):
    return cleaning.names_of([7, 3, -5], read(spark, sf, "part"), "p_partkey", "p_name")


@query("WITH m AS (SELECT trim(replace(lower(string_split(p_name, ' ')[1] || ' Film'), 'film', '')) AS raw, CASE p_size % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'cluster_' || (p_size % 5) END AS label, p_partkey FROM part) SELECT raw, arg_max(label, p_partkey) AS label FROM m GROUP BY raw")
def genre_label_map(spark, sf):
    p = read(spark, sf, "part").select(F.concat(F.split("p_name", " ")[0], F.lit(" Film")).alias("raw"), (F.col("p_size") % 5).alias("cluster"), "p_partkey")
    return cleaning.label_map(p, "raw", "cluster", "p_partkey", {"0": "zero", "1": "one"})


@query("SELECT doc_id, upper(coalesce(lang, '')) AS lang, coalesce(CAST(quality AS VARCHAR), '') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def post_processed(spark, sf):
    return cleaning.post_processed(_labelled(spark, sf), {"lang": F.upper, "quality": None}).select("doc_id", "lang", "quality")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) <> 'p'")
def not_deprecated(spark, sf):
    return cleaning.ranked_below(read(spark, sf, "orders"), "o_orderstatus", "p").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus <> 'F')")
def only_place(spark, sf):
    return cleaning.only_place(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "F").select("o_orderkey", "o_custkey")


@query(f"WITH {MV}, r AS (SELECT movie_id, year, row_number() OVER (PARTITION BY year ORDER BY n_chars DESC, movie_id) AS rn FROM mv) SELECT movie_id, year FROM r WHERE rn <= 3")
def head_per_year(spark, sf):
    return cleaning.head_per_group(movies(spark, sf), ["year"], [F.desc("n_chars"), "movie_id"], 3).select("movie_id", "year")


@query(f"WITH {MV}, p AS (SELECT movie_id, year, round(embedding[1], 6) AS score FROM mv), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, movie_id) AS a, row_number() OVER (PARTITION BY year ORDER BY score, movie_id) AS b FROM p) SELECT movie_id, year, score, a <= 5 AS top FROM r WHERE a <= 5 OR b <= 5")
def score_extremes_by_year(spark, sf):
    p = movies(spark, sf).select("movie_id", "year", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))
    rank = lambda o: F.row_number().over(W.partitionBy("year").orderBy(o, "movie_id"))
    return p.withColumns({"a": rank(F.desc("score")), "b": rank(F.asc("score"))}).where("a <= 5 OR b <= 5").select("movie_id", "year", "score", (F.col("a") <= 5).alias("top"))


@query("SELECT DISTINCT p_brand, p_type, p_retailprice FROM part ORDER BY p_retailprice DESC, p_brand, p_type LIMIT 50")
def discovery(spark, sf):
    return cleaning.discovered(read(spark, sf, "part"), ["p_brand", "p_type"], "p_retailprice", 50)


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['cold', 'bolt']) AS meets FROM part")
def set_overlap(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("cold"), F.lit("bolt"))).alias("meets"))


@query(f"WITH {EM} SELECT vec_id, round(v[1], 6) AS x FROM e WHERE vec_id = 17 LIMIT 1")
def vector_by_id(spark, sf):
    return r6(emb(spark, sf).where("vec_id = 17").limit(1).select("vec_id", F.element_at("embedding", 1).cast("double").alias("x")), "x")


# --- vector quality ----------------------------------------------------------------------------------------
NORM = "sqrt(list_dot_product(v, v))"


@query(f"WITH {EM}, n AS (SELECT {NORM} AS x FROM e) SELECT count(*) AS n, round(min(x), 6) AS min_norm, round(max(x), 6) AS max_norm, round(avg(x), 6) AS mean_norm, count(*) FILTER (WHERE x = 0) AS zeros FROM n")
def norm_stats(spark, sf):
    return r6(quality.norm_stats(emb(spark, sf)), "min_norm", "max_norm", "mean_norm")


@query(f"WITH {MV}, s AS (SELECT n_chars AS a, sqrt(list_dot_product(embedding, embedding)) * (1 + (movie_id % 7)) AS b FROM mv) SELECT round(corr(a, b), 6) AS correlation FROM s")
def length_norm_correlation(spark, sf):
    m = movies(spark, sf).withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: x * (1 + F.col("movie_id") % 7)))
    return r6(quality.length_norm_correlation(m, "n_chars"), "correlation")


ALL_MEAN = "x AS (SELECT unnest(v) v, generate_subscripts(v, 1) pos FROM e), c AS (SELECT pos, avg(v) m FROM x GROUP BY pos), a AS (SELECT list(m ORDER BY pos) a FROM c)"


@query(f"WITH {EM}, {ALL_MEAN} SELECT vec_id, round(1 - list_cosine_similarity(v, a), 6) AS distance FROM e, a")
def centroid_distance(spark, sf):
    return r6(quality.centroid_distance(emb(spark, sf), "vec_id"), "distance")


@query(f"WITH {EM}, x AS (SELECT label, unnest(v) v, generate_subscripts(v, 1) pos FROM e), c AS (SELECT label, pos, avg(v) m FROM x GROUP BY ALL), g AS (SELECT label, list(m ORDER BY pos) c FROM c GROUP BY label), p AS (SELECT 1 - list_cosine_similarity(a.c, b.c) AS d FROM g a JOIN g b ON a.label < b.label) SELECT (SELECT count(*) FROM g) AS n, round(avg(d), 6) AS mean_distance FROM p")
def between_film_distance(spark, sf):
    return r6(quality.mean_of_means_distance(emb(spark, sf), "label"), "mean_distance")


@query(f"WITH {EM}, p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id), s AS (SELECT avg(c) FILTER (WHERE same) AS intra, avg(c) FILTER (WHERE NOT same) AS inter FROM p) SELECT round(intra, 6) AS intra, round(inter, 6) + 0.0 AS inter, round(intra - inter, 6) AS gap, round(CASE WHEN intra > 0 THEN inter / intra END, 4) + 0.0 AS ratio FROM s")
def separation_power(spark, sf):
    return r6(quality.separation(emb(spark, sf), "label"), "intra", "inter", "gap").withColumn("ratio", F.round("ratio", 4) + 0.0)


@query(f"WITH {EM}, {ALL_MEAN} SELECT vec_id, round(degrees(acos(greatest(-1, least(1, list_cosine_similarity(v, a))))), 4) AS angle FROM e, a")
def centroid_angle(spark, sf):
    return quality.centroid_distance(emb(spark, sf), "vec_id").select("vec_id", F.round(quality.angle_degrees(1 - F.col("distance")), 4).alias("angle"))


@query(f"WITH {MV}, y AS (SELECT year, count(*) AS n, avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0.0 END) AS m, sqrt(-ln(0.025) / (2 * count(*))) AS e FROM mv GROUP BY year) SELECT year, n, round(m, 6) AS mean, round(least(1, greatest(0, m - e)), 6) AS low, round(least(1, greatest(0, m + e)), 6) AS high FROM y")
def hoeffding_by_year(spark, sf):
    """The yearly share of long plots with both ends of its Hoeffding interval."""
    n = movies(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 1500).cast("double")).alias("mean"))
    low, high = quality.hoeffding_bounds(F.col("mean"), F.col("n"))
    return r6(n.select("year", "n", "mean", low.alias("low"), high.alias("high")), "mean", "low", "high")


@query(f"WITH {EM}, {ALL_MEAN}, y AS (SELECT vec_id, unnest(v) v, generate_subscripts(v, 1) pos FROM e) SELECT y.vec_id, CAST(y.pos - 1 AS INT) AS pos, round(y.v - c.m, 6) + 0.0 AS x FROM y JOIN c USING (pos)")
def mean_centred(spark, sf):
    mean = V.mean_vectors(emb(spark, sf), []).select("centroid")
    e = emb(spark, sf).join(F.broadcast(mean)).select("vec_id", V.subtract(V.doubles("embedding"), F.col("centroid")).alias("embedding"))
    return r6(V.long_form(e, ["vec_id"]).withColumn("pos", F.col("pos").cast("int")), "x")


@query(f"WITH {MV}, x AS (SELECT year, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM mv WHERE genre = 1) SELECT CAST(pos - 1 AS INT) AS pos, " + ", ".join(f"round(avg(v) FILTER (WHERE year = {y}), 6) + 0.0 AS p_{y}" for y in range(1995, 2002)) + " FROM x GROUP BY pos")
def genre_heatmap(spark, sf):
    years = list(range(1995, 2002))
    return r6(quality.component_by_period(movies(spark, sf).where("genre = 1"), "year", years), *[f"p_{y}" for y in years])


# --- normalised drift --------------------------------------------------------------------------------------
SIGMA = VEL + """, k AS (SELECT g.n, 1 - list_cosine_similarity(m.embedding, g.c) AS d, m.genre, m.year FROM mv m JOIN g USING (genre, year) WHERE g.n > 1),
kv AS (SELECT genre, year, max(n) - 1 AS f, avg(d * d) AS v FROM k GROUP BY ALL), sg AS (SELECT sqrt(sum(f * v) / sum(f)) AS sigma FROM kv)"""


@query(f"WITH {SIGMA}, z AS (SELECT genre, year, n, next_n, velocity, velocity / (sigma * sqrt(1.0 / n + 1.0 / next_n)) AS normalised FROM vel, sg) SELECT genre, year, round(normalised, 6) AS normalised, round(lead(normalised) OVER w - normalised, 6) + 0.0 AS acceleration, round(sum(normalised) OVER w, 6) AS cumulative FROM z WINDOW w AS (PARTITION BY genre ORDER BY year)")
def drift_standard_error(spark, sf):
    out = quality.drift_metrics(movies(spark, sf), quality.StandardError(["genre", "year"]))
    return r6(out.select("genre", "year", "normalised", "acceleration", "cumulative"), "normalised", "acceleration", "cumulative")


@query(f"WITH {VEL} SELECT genre, year, round(velocity, 6) AS normalised, round(sum(velocity) OVER (PARTITION BY genre ORDER BY year), 6) AS cumulative FROM vel")
def drift_not_normalised(spark, sf):
    return r6(quality.drift_metrics(movies(spark, sf), quality.NoNormalization()).select("genre", "year", "normalised", "cumulative"), "normalised", "cumulative")


_U = "(CAST('0x' || substr(md5(movie_id || '-' || rep || '-42'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
_STEPS = [sum(0.36787944117144233 / factorial(j) for j in range(k + 1)) for k in range(8)]


@query(f"""WITH {MV}, r AS (SELECT movie_id, genre, year, embedding, rep, {_U} AS u FROM mv, range(0, 10) t(rep)), w AS (SELECT *, {' + '.join(f'CAST(u > {s!r} AS INT)' for s in _STEPS)} AS w FROM r),
x AS (SELECT genre, year, rep, w, unnest(embedding) v, generate_subscripts(embedding, 1) pos FROM w WHERE w > 0), m AS (SELECT genre, year, rep, pos, sum(w * v) / sum(w) AS m FROM x GROUP BY ALL), c AS (SELECT genre, year, rep, list(m ORDER BY pos) c FROM m GROUP BY ALL),
d AS (SELECT genre, year, 1 - list_cosine_similarity(c, lead(c) OVER (PARTITION BY genre, rep ORDER BY year)) AS d FROM c) SELECT genre, year, count(d) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d WHERE d IS NOT NULL GROUP BY ALL""")
def bootstrapped_drift(spark, sf):
    return r6(quality.bootstrapped_change(movies(spark, sf), "movie_id", reps=10), "median", "low", "high")


# --- sparse weights ----------------------------------------------------------------------------------------
TF = "t AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM conversations), w AS (SELECT conv_id, term, CAST(count(*) AS DOUBLE) AS weight FROM t GROUP BY ALL)"


def _weights(spark, sf):
    t = read(spark, sf, "conversations").select("conv_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return t.groupBy("conv_id", "term").agg(F.count("*").cast("double").alias("weight"))


@query(f"WITH {TF}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, term) AS rank FROM w) SELECT conv_id, CAST(rank AS INT) AS rank, term, weight FROM r WHERE rank <= 5")
def top_lexical_weights(spark, sf):
    maps = _weights(spark, sf).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    top = maps.select("conv_id", F.posexplode(quality.top_weights(maps, "weights", 5)).alias("at", "x"))
    return top.select("conv_id", (F.col("at") + 1).alias("rank"), "x.term", "x.weight")


@query(f"WITH {TF}, l AS (SELECT term, count(*) AS f FROM w GROUP BY term HAVING count(*) >= 5) SELECT conv_id, term, round(weight / sum(weight) OVER (PARTITION BY conv_id), 6) AS weight FROM w JOIN l USING (term)")
def frequent_lexical_weights(spark, sf):
    w = _weights(spark, sf)
    lexicon = w.groupBy("term").agg(F.count("*").alias("f"))
    return r6(quality.frequent_weights(w, "conv_id", "term", "weight", lexicon, "f", 5), "weight")


# --- epsilon balls with both tests -------------------------------------------------------------------------
def _p_value(d, n, m):
    return f"CASE WHEN {d} * sqrt({n} * {m} / ({n} + {m})) < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * {d} * {d} * {n} * {m} / ({n} + {m})) for k in range(1, 101)]))) END"


@query(f"""WITH {EM}, {ALL_MEAN}, b AS (SELECT v AS b FROM e WHERE vec_id = 0), s AS (SELECT round(1 - list_cosine_similarity(v, b), 6) AS da, round(1 - list_cosine_similarity(v, a), 6) AS dc FROM e, a, b WHERE vec_id <> 0), u AS (SELECT da AS d, 0 AS g FROM s UNION ALL SELECT dc, 1 FROM s),
cc AS (SELECT d, count(*) FILTER (WHERE g = 0) AS x, count(*) FILTER (WHERE g = 1) AS y FROM u GROUP BY d), f AS (SELECT abs(sum(x) OVER o / sum(x) OVER () - sum(y) OVER o / sum(y) OVER ()) AS gap, sum(x) OVER () AS n, sum(y) OVER () AS m FROM cc WINDOW o AS (ORDER BY d)), k AS (SELECT max(gap) AS d, CAST(max(n) AS DOUBLE) AS n, CAST(max(m) AS DOUBLE) AS m FROM f),
i AS (SELECT count(*) FILTER (WHERE da <= 0.9) AS inside, count(*) FILTER (WHERE dc <= 0.9) AS control FROM s), p AS (SELECT d, n, m, {_p_value('d', 'n', 'm')} AS p FROM k)
SELECT round(d, 6) AS d, round(p, 6) AS p, CASE WHEN d < 0.1 THEN 'negligible' WHEN d < 0.2 THEN 'small' WHEN d < 0.3 THEN 'medium' ELSE 'large' END AS effect, CASE WHEN least(n, m) > 1000 THEN d >= 0.2 ELSE p < 0.05 END AS differs, inside, control FROM p, i""")
def epsilon_ball_report(spark, sf):
    """Ball around an anchor, control ball around the mean of all, and the test of their distances."""
    e = emb(spark, sf)
    anchor = e.where("vec_id = 0").select(V.doubles("embedding").alias("b"))
    control = quality.centroid_distance(e, "vec_id").where("vec_id <> 0").select(F.round("distance", 6).alias("d"), F.lit(1).alias("g"))
    near = e.where("vec_id <> 0").join(F.broadcast(anchor)).select(F.round(V.cosine_distance(V.doubles("embedding"), F.col("b")), 6).alias("d"), F.lit(0).alias("g"))
    both = near.unionByName(control)
    k = stats.ks_distance(both, "d", "g", 0, 1).join(both.agg(F.count_if((F.col("g") == 0) & (F.col("d") <= 0.9)).alias("inside"), F.count_if((F.col("g") == 1) & (F.col("d") <= 0.9)).alias("control")))
    k = k.withColumn("p", stats.ks_p(F.col("d"), F.col("n_a"), F.col("n_b")))
    differs = stats.ks_interpret(F.col("d"), F.col("p"), F.col("n_a"), F.col("n_b"))
    return k.select(F.round("d", 6).alias("d"), (F.round("p", 6) + 0.0).alias("p"), stats.ks_effect(F.col("d")).alias("effect"), differs.alias("differs"), "inside", "control")


# --- string functions --------------------------------------------------------------------------------------
@query("SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS last, regexp_replace(regexp_replace(regexp_replace(replace(url, ' ', '_'), '[<>:\"/\\\\|?*]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS file, regexp_replace(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') = html AS plain FROM pages")
def text_functions(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "([^/]+)$", 1).alias("last"), X.file_name(F.col("url")).alias("file"), (X.strip_controls(F.col("html")) == F.col("html")).alias("plain"))


# --- thresholds, densities, class separation ---------------------------------------------------------------
@query("""WITH s AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents), h AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 64)), 63) AS INT) AS bin, count(*) AS n FROM documents, s GROUP BY ALL),
l AS (SELECT max(n) AS height, arg_max(bin, n * 1000 - bin) AS peak, min(bin) AS low, max(bin) AS high FROM h), e AS (SELECT *, CASE WHEN peak - low < high - peak THEN high ELSE low END AS e FROM l),
d AS (SELECT i AS bin, abs(i - e) AS steps, height * abs(i - e) - abs(peak - e) * coalesce(n, 0) AS below FROM range(0, 64) t(i) LEFT JOIN h ON h.bin = i, e WHERE abs(i - e) < greatest(abs(peak - e), 1) AND (i - e) * (peak - e) >= 0)
SELECT round(lo + (bin + 0.5) * ((hi - lo) / 64), 6) AS threshold FROM d, s ORDER BY below DESC, steps LIMIT 1""")
def length_triangle(spark, sf):
    return r6(stats.triangle_threshold(read(spark, sf, "documents"), "n_chars", 64), "threshold")


@query("""WITH t AS (SELECT doc_id, n_chars, CAST(floor(round(ln(n_chars), 6) / 0.5) AS BIGINT) AS bin FROM documents WHERE n_chars > 0)
SELECT DISTINCT bin, count(*) OVER (PARTITION BY bin) AS n, first_value(doc_id) OVER (PARTITION BY bin ORDER BY n_chars, doc_id) AS shortest, first_value(doc_id) OVER (PARTITION BY bin ORDER BY n_chars DESC, doc_id) AS longest FROM t""")
def length_bin_extremes(spark, sf):
    d = read(spark, sf, "documents").where("n_chars > 0").withColumn("x", F.round(F.log("n_chars"), 6))
    return stats.bin_extremes(d, "doc_id", "x", "n_chars", 0.5)


@query(f"""WITH {EM}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / {NORM}) AS u FROM e WHERE label IS NOT NULL), p AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_dot_product(a.u, b.u)) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM p GROUP BY vec_id) SELECT count(*) AS n, (SELECT count(DISTINCT label) FROM u) AS labels, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def label_silhouette(spark, sf):
    return r6(quality.silhouette(emb(spark, sf), "label"), "silhouette")


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' UNION ALL SELECT -1, 0, 'user'")
def nested_list_rows(spark, sf):
    """Rows of a nested JSON list of one category, with rows added by hand."""
    c = read(spark, sf, "conversations")
    packed = c.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("json"))
    nested = packed.select("conv_id", F.from_json("json", "array<struct<turn: int, role: string>>").alias("items"))
    return relational.nested_rows(nested, "items", ["conv_id"], "role", "user", [(-1, 0, "user")])
