"""Queries over vector spaces: density clustering, concept search, Gaussian fits, spectra, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import classify, concepts, density, gaussian, linalg, pooling, taxonomy
from quillon.operators.stats import MIDDLE, TAIL
from quillon.plans.more import _STEPS, _U
from quillon.plans.queries import DIR, EM, SQL, emb, query, r6, read

# --- density clustering ------------------------------------------------------------------------------------
CENTRED = f"""WITH {EM}, t AS (SELECT vec_id, unnest(v) v, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(v) m FROM t GROUP BY pos), c AS (SELECT vec_id, list(v - m ORDER BY pos) AS v FROM t JOIN m USING (pos) GROUP BY vec_id),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS d FROM c a JOIN c b ON a.vec_id <> b.vec_id), r AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d), core AS (SELECT a AS vec_id, d AS core FROM r WHERE k = 5)"""


def _centred(spark, sf):
    return linalg.centre(emb(spark, sf))


@query(f"{CENTRED} SELECT vec_id, round(core, 6) AS core FROM core")
def core_distances(spark, sf):
    return r6(density.core_distances(_centred(spark, sf), "vec_id"), "core")


@query(f"""{CENTRED.replace('WITH', 'WITH RECURSIVE', 1)}, reach AS (SELECT a, b, greatest(d, x.core, y.core) AS w FROM d JOIN core x ON x.vec_id = d.a JOIN core y ON y.vec_id = d.b),
prim AS (SELECT vec_id AS id, CASE WHEN vec_id = (SELECT min(vec_id) FROM core) THEN CAST(-1 AS DOUBLE) ELSE CAST(1e9 AS DOUBLE) END AS key, 0 AS step, CAST(0 AS DOUBLE) AS total FROM core
 UNION ALL SELECT p.id, least(p.key, r.w), p.step + 1, m.total FROM prim p, (SELECT arg_min(id, key) AS id, greatest(min(key), 0) + max(total) AS total FROM prim) m JOIN reach r ON r.a = m.id WHERE r.b = p.id AND p.id <> m.id)
SELECT (SELECT count(*) - 1 FROM core) AS n, round((SELECT max(total + key) FROM prim WHERE step = (SELECT max(step) FROM prim)), 4) AS total""")
def spanning_tree_weight(spark, sf):
    """Edges and total reach of the least spanning tree of mutual reachability."""
    return density.tree_weight(_centred(spark, sf), "vec_id").withColumn("total", F.round("total", 4))


@query()
def density_clusters(spark, sf):
    return r6(density.density_clusters(_centred(spark, sf), "vec_id", least=10, k=5), "stability")


# --- concept spaces: every third vector is a concept, tokens of documents have vectors by a hash ---------------
SPACE = EM + ", c AS (SELECT vec_id AS idx, 'w' || vec_id AS word, v FROM e WHERE vec_id % 3 = 0)"


def _space(spark, sf):
    return emb(spark, sf).where("vec_id % 3 = 0").select(F.col("vec_id").alias("idx"), F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))


@query(f"WITH {SPACE}, s AS (SELECT vec_id, idx, word, list_cosine_similarity(e.v, c.v) AS s FROM e, c WHERE list_dot_product(e.v, e.v) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, idx) AS rank FROM s) SELECT vec_id, CAST(rank AS INT) AS rank, idx, word, round(s, 6) + 0.0 AS score FROM r WHERE rank <= 5")
def concept_search(spark, sf):
    return r6(concepts.search(_space(spark, sf), emb(spark, sf), "vec_id", 5), "score")


LEMMAS = "t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents), l AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 400 AS id FROM t), w AS (SELECT doc_id, id, count(*) AS n FROM l GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM w)"


@query(f"""WITH {SPACE}, {LEMMAS}, near AS (SELECT e.vec_id AS id, arg_min(c.idx, struct_pack(a := -round(list_cosine_similarity(e.v, c.v), 12), b := c.idx)) AS idx FROM e, c WHERE e.vec_id < 400 AND list_dot_product(e.v, e.v) > 0 GROUP BY e.vec_id),
m AS (SELECT q.doc_id, CASE WHEN q.id % 3 = 0 THEN q.id ELSE near.idx END AS idx, sum(q.share) AS score FROM q JOIN near USING (id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, idx) AS rank FROM m)
SELECT doc_id, CAST(rank AS INT) AS rank, 'w' || idx AS word, round(score, 6) AS score FROM r WHERE rank <= 10""")
def concept_lemmas(spark, sf):
    """The ten heaviest concepts of each document's words."""
    weights = concepts.hashed_lemmas(read(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")), "doc_id", "w", 400)
    vectors = emb(spark, sf).select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    return r6(concepts.map_lemmas(weights, _space(spark, sf), vectors, "doc_id", 10), "score")


@query(f"WITH {SPACE}, x AS (SELECT unnest(v) v, generate_subscripts(v, 1) pos FROM e), m AS (SELECT list(a ORDER BY pos) AS m FROM (SELECT pos, avg(v) AS a FROM x GROUP BY pos)), s AS (SELECT idx, word, list_cosine_similarity(v, m) AS s FROM c, m) SELECT CAST(row_number() OVER (ORDER BY s DESC, idx) AS INT) AS rank, word, round(s, 6) + 0.0 AS score FROM s ORDER BY rank LIMIT 30")
def relevant_concepts(spark, sf):
    return r6(concepts.relevant(_space(spark, sf), emb(spark, sf), 30).select("rank", "word", "score"), "score")


@query()
def concept_projection(spark, sf):
    return r6(concepts.project(_space(spark, sf), emb(spark, sf), 5), "projection")


# --- Gaussian fits -----------------------------------------------------------------------------------------
def _tail(x, half):
    """Chi-square tail of 2 * half degrees in SQL, from the Poisson sum."""
    return f"list_sum([exp(k * ln(greatest({x}, 1e-300) / 2) - lgamma(k + 1) - {x} / 2) for k in range({half})])"


def _normal(p):
    """The normal quantile in SQL, by the same rational forms as stats.inverse_normal."""
    horner = lambda c, x: f"({c[0]!r})" if len(c) == 1 else f"({horner(c[:-1], x)} * {x} + ({c[-1]!r}))"
    low = f"least({p}, 1 - ({p}))"
    q, t = f"(0.5 - {low})", f"sqrt(-2 * ln({low}))"
    middle, tail = f"{q} * {horner(MIDDLE[0], f'({q} * {q})')} / {horner(MIDDLE[1], f'({q} * {q})')}", f"-({horner(TAIL[0], t)}) / {horner(TAIL[1], t)}"
    return f"(CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END) * (CASE WHEN {low} < 0.02425 THEN {tail} ELSE {middle} END)"


@query(f"WITH {EM}, u AS (SELECT unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) x, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(x) m, count(*) n FROM u GROUP BY pos), r AS (SELECT max(n) AS n, sqrt(sum(m * m)) AS resultant, max(n) * count(*) * sum(m * m) AS stat FROM m) SELECT n, round(resultant, 6) AS resultant, round(stat, 4) AS rayleigh, round({_tail('stat', 32)}, 6) + 0.0 AS p FROM r")
def rayleigh_test(spark, sf):
    return r6(gaussian.rayleigh(emb(spark, sf)), "resultant", "p").withColumn("rayleigh", F.round("rayleigh", 4))


@query(f"""WITH {EM}, u AS (SELECT vec_id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) x, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(x) m, count(*) n FROM u GROUP BY pos), r AS (SELECT max(n) AS n, sqrt(sum(m * m)) AS resultant, max(n) * count(*) * sum(m * m) AS stat, count(*) AS d FROM m),
p AS (SELECT list_cosine_similarity(a.v, b.v) AS c, acos(greatest(-1, least(1, list_cosine_similarity(a.v, b.v)))) AS t FROM e a JOIN e b ON a.vec_id < b.vec_id), s AS (SELECT avg(c) AS mean_cosine, var_pop(c) AS var_cosine, avg(t) AS mean_angle, stddev_pop(t) AS std_angle FROM p)
SELECT n, CAST(d AS INT) AS d, round(mean_cosine, 6) + 0.0 AS mean_cosine, round(var_cosine, 6) AS var_cosine, round(mean_angle, 6) AS mean_angle, round(std_angle, 6) AS std_angle, round(resultant, 6) AS resultant, round(stat, 4) AS rayleigh, round({_tail('stat', 32)}, 6) + 0.0 AS p FROM r, s""")
def cosine_report(spark, sf):
    out = gaussian.cosine_report(emb(spark, sf), "vec_id").drop("first", "first10").withColumn("rayleigh", F.round("rayleigh", 4))
    return r6(out, "mean_cosine", "var_cosine", "mean_angle", "std_angle", "resultant", "p")


@query()
def cosine_spectrum(spark, sf):
    return r6(gaussian.cosine_spectrum(emb(spark, sf)), "eigenvalue", "ratio", "cumulative")


@query(f"""WITH {EM}, x AS (SELECT vec_id, unnest(v[1:4]) v, generate_subscripts(v[1:4], 1) pos FROM e), z AS (SELECT vec_id, pos, (v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos) AS z FROM x), r AS (SELECT pos, z, row_number() OVER (PARTITION BY pos ORDER BY z, vec_id) AS rn, count(*) OVER (PARTITION BY pos) AS n FROM z),
p AS (SELECT *, 0.01 + 0.98 * (rn - 1) / greatest(n - 1, 1) AS p FROM r) SELECT CAST(pos - 1 AS INT) AS component, rn, round(z, 6) + 0.0 AS observed, round({_normal('p')}, 6) + 0.0 AS theoretical FROM p""")
def component_qq(spark, sf):
    return r6(gaussian.component_pairs(emb(spark, sf), "vec_id", 4), "observed", "theoretical")


@query()
def principal_component_qq(spark, sf):
    return r6(gaussian.component_pairs(emb(spark, sf), "vec_id", 4, principal=True), "observed", "theoretical")


@query(f"""WITH {EM}, x AS (SELECT vec_id, unnest(v) v, generate_subscripts(v, 1) pos FROM e), m AS (SELECT pos, avg(v) m, var_samp(v) s FROM x GROUP BY pos), d AS (SELECT vec_id, round(sum((v - m) ** 2 / s), 9) AS d2 FROM x JOIN m USING (pos) GROUP BY vec_id), r AS (SELECT d2, row_number() OVER (ORDER BY d2, vec_id) AS rn, count(*) OVER () AS n FROM d),
p AS (SELECT *, 0.01 + 0.98 * (rn - 1) / greatest(n - 1, 1) AS p FROM r), t AS (SELECT rn, d2, list_reduce(list_prepend(struct_pack(a := CAST(0 AS DOUBLE), b := CAST(400 AS DOUBLE)), [struct_pack(a := CAST(1 - p AS DOUBLE), b := CAST(0 AS DOUBLE)) for i in range(60)]),
 lambda s, i: CASE WHEN {_tail('((s.a + s.b) / 2)', 32)} > i.a THEN struct_pack(a := (s.a + s.b) / 2, b := s.b) ELSE struct_pack(a := s.a, b := (s.a + s.b) / 2) END) AS s FROM p)
SELECT rn, round(d2, 6) AS observed, round((s.a + s.b) / 2, 6) AS theoretical FROM t""")
def diagonal_qq(spark, sf):
    """Squared distances under the variances alone, beside chi-square quantiles."""
    d = gaussian.diagonal_distances(emb(spark, sf), "vec_id").withColumn("d2", F.round("d2", 9))
    return r6(gaussian.chi2_pairs(d, "vec_id", 64), "observed", "theoretical")


@query()
def mahalanobis_qq(spark, sf):
    return r6(gaussian.chi2_pairs(gaussian.mahalanobis(emb(spark, sf), "vec_id"), "vec_id", 64), "observed", "theoretical")


@query()
def gaussianity(spark, sf):
    """Gaussianity record under the robust covariance for three levels."""
    out = gaussian.gaussianity(emb(spark, sf), "vec_id", alphas=(0.01, 0.05, 0.1))
    return r6(out, "mean_d2", "std_d2", "expected_std", "representativeness", "threshold", "share", "first10")


SQL["qq_pairs"] = f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p AS (SELECT *, 0.01 + 0.98 * (rn - 1) / greatest(n - 1, 1) AS p FROM r)
SELECT rn, value AS observed, round({_normal('p')}, 6) + 0.0 AS theoretical FROM p"""


SQL["poisson_bootstrap_ci"] = f"""WITH {DIR}, r AS (SELECT movie_id, year, s, rep, {_U} AS u FROM p, range(0, 100) t(rep)), w AS (SELECT *, {' + '.join(f'CAST(u > {s!r} AS INT)' for s in _STEPS)} AS w FROM r),
m AS (SELECT year, rep, sum(w * s) / sum(w) AS m FROM w GROUP BY ALL) SELECT year, round(quantile_cont(m, 0.5), 6) + 0.0 AS median, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m GROUP BY year"""
SQL["whitened_spread"] = "SELECT CAST(i AS INT) AS pos, CAST(1 AS DOUBLE) AS variance FROM range(64) t(i)"  # whitened components have variance 1


# --- pooling of token vectors: 40 vectors in a row are a sequence ----------------------------------------------
@query(f"""WITH {EM}, s AS (SELECT vec_id // 40 AS seq, vec_id % 40 AS pos, v FROM e), n AS (SELECT seq, max(pos) + 1 AS n FROM s GROUP BY seq), w AS (SELECT seq, unnest(range(0, CAST(least(greatest(ceil((n - 16) / 6.0), 0), ceil(n / 6.0) - 1) AS INT) + 1)) AS w FROM n),
x AS (SELECT w.seq, w.w, unnest(s.v) v, generate_subscripts(s.v, 1) pos FROM w JOIN s ON s.seq = w.seq AND s.pos >= w.w * 6 AND s.pos < w.w * 6 + 16), m AS (SELECT seq, w, pos, avg(v) m FROM x GROUP BY ALL), l AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY seq, w)) AS l FROM m),
f AS (SELECT seq, pos, avg(m / l) AS f, count(*) AS windows FROM l GROUP BY ALL) SELECT seq, windows, CAST(pos - 1 AS INT) AS pos, round(f, 6) + 0.0 AS raw, round(f / sqrt(sum(f * f) OVER (PARTITION BY seq)), 6) + 0.0 AS x FROM f""")
def late_chunks(spark, sf):
    t = emb(spark, sf).select(F.floor(F.col("vec_id") / 40).alias("seq"), (F.col("vec_id") % 40).alias("pos"), "embedding")
    out = pooling.late_chunks(t, "seq", "pos", 16, 6).select("seq", "windows", F.posexplode(F.arrays_zip("raw", "embedding")).alias("pos", "c"))
    return r6(out.select("seq", "windows", "pos", F.col("c.raw").alias("raw"), F.col("c.embedding").alias("x")), "raw", "x")


# --- classifier --------------------------------------------------------------------------------------------
@query()
def genre_classifier(spark, sf):
    """Held-out scores of the labels, each row with its label and its label modulo 3."""
    e = emb(spark, sf).withColumn("labels", F.array(F.concat(F.lit("g"), "label"), F.concat(F.lit("m"), F.col("label") % 3)))
    return r6(classify.evaluate(e, "vec_id", "labels"), "subset_accuracy", "micro_f1")


# --- best ancestors: customers and suppliers below nations below regions -----------------------------------------
GRAPH = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _graph(spark, sf):
    edge = lambda name, a, x, b, y: read(spark, sf, name).select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    return edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))


@query(f"""WITH RECURSIVE {GRAPH}, w AS (SELECT 'w' || c_custkey AS word, 'c' || c_custkey AS node, 0 AS rank FROM customer UNION ALL SELECT 'w' || s_suppkey, 's' || s_suppkey, 1 FROM supplier),
up AS (SELECT word, node, rank, 0 AS steps FROM w UNION ALL SELECT up.word, e.parent, up.rank, up.steps + 1 FROM up JOIN e ON e.child = up.node), stop AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey < 2),
g AS (SELECT DISTINCT node FROM (SELECT child AS node FROM e WHERE parent NOT IN (SELECT child FROM e)) WHERE node NOT IN (SELECT node FROM stop))
SELECT word, min(struct_pack(rank := rank, steps := steps, a := up.node)).a AS ancestor FROM up JOIN g USING (node) GROUP BY word""")
def best_ancestors(spark, sf):
    """Each word's first meaning is a customer, its second a supplier; nations of two regions are too general."""
    words = read(spark, sf, "customer").select(F.concat(F.lit("w"), "c_custkey").alias("word"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit(0).alias("rank"))
    words = words.unionByName(read(spark, sf, "supplier").select(F.concat(F.lit("w"), "s_suppkey").alias("word"), F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1).alias("rank")))
    stop = read(spark, sf, "nation").where("n_regionkey < 2").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return taxonomy.best_ancestor(words, _graph(spark, sf), 1, stop).select("word", "ancestor")


@query("""WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents), w AS (SELECT word, count(*) AS n FROM t WHERE regexp_full_match(word, '[a-z]{3,}') AND NOT ends_with(word, 'ing') GROUP BY word HAVING count(*) >= 20),
s AS (SELECT word, n FROM w WHERE word NOT IN ('the', 'and')) SELECT CAST(row_number() OVER (ORDER BY n DESC, word) AS INT) AS rank, word, n FROM s ORDER BY rank LIMIT 100""")
def concept_vocabulary(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return taxonomy.vocabulary(words, "n", 20, spark.createDataFrame([("the",), ("and",)], "word string"), ["ing"], 100)

