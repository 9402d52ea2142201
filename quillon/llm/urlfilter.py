"""URL filter: a blocked Bloom filter of listed URLs passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bloom import Blocked, might_hold
from quillon.llm.common import ascii_lower, table

# The rules of the query, (host and path, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
# Hosts of the query's listing; all their URLs and subdomains are listed.
LISTED_HOSTS = ["adult-x.example.net", "ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com", "spam-farm.example.org"]
#: Single URLs of the query's listing, by rule: list-<i modulo 997>.example.org/page/<i>, so many of them.
LISTED_URLS = 20_000


def url_parts(url):
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://([^?#]*)", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/]*", 0)
    return ascii_lower(host), F.regexp_replace(rest, r"\A[^/]*", "")


def canonical(host, path):
    """The form in which URLs are listed: the host without a usual port and a dot at its end, and the path without the
    slashes at its end."""
    return F.concat(F.regexp_replace(host, r"\.?(:(80|443))?$", ""), F.rtrim(path, F.lit("/")))


def _label_counts(hosts: DataFrame, column: str) -> list[int]:
    """How many labels the hosts have: a small set of numbers, as a host has 253 characters at most."""
    return sorted(r[0] for r in hosts.select(F.size(F.split(column, r"\.")).alias("n")).distinct().collect())


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col="page_id", url_col="url", hosts: DataFrame | None = None) -> DataFrame:
    """Verdict of each URL: id, host, path, rule, verdict, listed.

    rules: rule string (host and path such as `net/es/`), verdict. listed: canonical URLs (column url);
    hosts: hosts all of whose URLs and subdomains are listed (column host).
    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
    wins, of equally long ones that with the longer host, then the larger string; a rule given twice has the smaller
    verdict; otherwise listed URLs are blocked and the rest allowed. All keys by which a URL could be hit
    (its host's suffixes of as many labels as rules have with the path prefixes of the lengths that rules have, its
    canonical form and its host's suffixes of as many labels as listed hosts have) are looked up in one blocked Bloom
    filter; only keys that pass it are shuffled, to an exact join that removes the false ones. So a very long URL has
    no more keys than others. The lists' path lengths and label counts are small sets; the filter's size is bounded
    whatever the list's.

    A null URL, or one without ://, has an empty host and path: no rule fits it and it is listed only if
    the empty string is. Rows with the same id are judged one by one. Empty tables give no rows; an empty
    list blocks nothing. Null rules, listed URLs and hosts are ignored. Other columns are not read.
    """
    spark = pages.sparkSession
    rules = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    keys = rules.select(F.concat(F.lit("r:"), "rule").alias("key"), "rule", "verdict").unionByName(
        listed.where("url IS NOT NULL").select(F.concat(F.lit("u:"), "url").alias("key")).distinct(), allowMissingColumns=True)
    if hosts is not None:
        keys = keys.unionByName(hosts.where("host IS NOT NULL").select(F.concat(F.lit("h:"), "host").alias("key")).distinct(), allowMissingColumns=True)
    rule_labels = _label_counts(rules.select(F.regexp_extract("rule", r"\A[^/]*", 0).alias("host")), "host")
    host_labels = _label_counts(hosts.where("host IS NOT NULL"), "host") if hosts is not None else []
    lengths = [r[0] for r in rules.select(F.length(F.regexp_replace("rule", r"\A[^/]*", "")).alias("n")).distinct().collect()]
    probe = might_hold(spark, Blocked.build(keys.select(F.xxhash64("key").alias("h")), "h"))

    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = url_parts(url)
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    suffixes = lambda counts: [F.substring_index("host", ".", -n) for n in counts]
    asked_keys = [F.concat(F.lit("r:"), x, F.expr(f"substring(path, 1, {int(n)})")) for x in suffixes(rule_labels) for n in lengths]
    asked_keys += [F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))), *(F.concat(F.lit("h:"), x) for x in suffixes(host_labels))]
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(F.array(*asked_keys))).alias("key"))
    hits = asked.where(probe(F.xxhash64("key"))).join(keys, "key")
    found = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("host"), "rule", "verdict"))).alias("best"),
        F.coalesce(F.bool_or(F.col("rule").isNull()), F.lit(False)).alias("listed"))
    method = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    found = found.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), "listed")
    return rows.join(found, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    hosts = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    urls = spark.range(LISTED_URLS).select(F.concat(F.lit("list-"), F.col("id") % 997, F.lit(".example.org/page/"), "id").alias("url"))
    return filter_urls(pages, rules, urls, hosts=hosts)


SQL = {
    "op2_url_filter": rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(rest, '^[^/]*', '') AS path FROM a),
r(rule, verdict) AS (VALUES {', '.join(f"('{r}', '{v}')" for r, v in RULES)}),
s AS (SELECT *, substr(rule, 1, instr(rule, '/') - 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM r),
f AS (SELECT b.page_id, max(struct_pack(n := length(s.rule), h := instr(s.rule, '/'), rule := s.rule, verdict := s.verdict)) AS best FROM b JOIN s ON (b.host = s.rh OR ends_with(b.host, '.' || s.rh)) AND starts_with(b.path, s.rp) GROUP BY b.page_id),
l AS (SELECT 'list-' || (i % 997) || '.example.org/page/' || i AS url FROM range({LISTED_URLS}) t(i)), h(host) AS (VALUES {', '.join(f"('{h}')" for h in LISTED_HOSTS)}),
x AS (SELECT b.*, (regexp_replace(b.host, '\.?(:(80|443))?$', '') || rtrim(b.path, '/')) IN (SELECT url FROM l) OR EXISTS (SELECT 1 FROM h WHERE b.host = h.host OR ends_with(b.host, '.' || h.host)) AS listed FROM b)
SELECT x.page_id, x.host, x.path, f.best.rule AS rule, coalesce(f.best.verdict, CASE WHEN x.listed THEN 'block' ELSE 'allow' END) AS verdict, x.listed FROM x LEFT JOIN f USING (page_id)"""
}
