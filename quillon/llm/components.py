"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stash, unstash


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (columns u, v); component is the smallest node reached.

    Minima are aggregated with map-side combination and joined back, so a node with many links is only many
    narrow rows. Null ends and loops are ignored. Raises if the steps do not settle.
    """
    u, v = F.col("u"), F.col("v")
    known = links.count()
    edges = stash(links.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "stars", known)
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, stash(small.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "stars", 2 * known)
        unstash(last)
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            out = edges.select(u.alias("node"), v.alias("component")).unionByName(edges.select(v.alias("node"), v.alias("component")).distinct())
            out.kept = edges  # the table behind it, to be deleted by whoever reads the result last
            return out
        before, known = now, now[0]
    raise RuntimeError("components did not settle")
