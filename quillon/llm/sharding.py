"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a shard has a weight, a node above it the sum of its shards' weights. A
document descends from the root: at each node every child draws -ln(u) / weight, with u in (0, 1) from a hash of the
document's id and the child's name, and the least draw wins, so a child wins in proportion to its weight. A draw
depends on nothing but the id, the child and the child's weight. So when a weight changes, only draws of the nodes
above it change: documents move into (or out of) those subtrees alone, and all others stay where they are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import stash, table

SHARDS = 16
RACK, REGION = 4, 8  # shards of a rack and of a region in the query's tree
MAX_SHARDS = 100_000  # a tree stands in the plan

Tree = Sequence[tuple[str, str, int, float]]


def even_tree(n: int, base: int = SHARDS) -> Tree:
    """(region, rack, shard, weight) of shards 0 to n - 1, all of weight 1. The first `base` fill racks of RACK and
    regions of REGION shards. Each later one is a region of its own: no other subtree's weight changes when it comes,
    so it takes documents only into itself."""
    name = lambda s: (f"r{s // REGION}", f"k{s // RACK}") if s < base else (f"g{s}", f"h{s}")
    return [(*name(s), s, 1.0) for s in range(n)]


def _children(tree: Tree) -> str:
    """For each inner node (0 is the root) its children as JSON: name k, number i (a leaf's: its shard), weight w."""
    leaves = [x for x in tree if x[3] is not None and x[3] > 0]
    if not leaves or len(leaves) > MAX_SHARDS:
        raise ValueError(f"a tree has 1 to {MAX_SHARDS} shards with a weight")
    if len({x[2] for x in leaves}) < len(leaves):
        raise ValueError("a shard stands twice in the tree")
    number, below = {"": 0}, {0: {}}
    for region, rack, shard, weight in leaves:
        path = ["", f"{region}", f"{region}/{rack}"]
        for up, down in zip(path, path[1:]):
            if down not in number:
                number[down] = len(number)
                below[number[down]] = {}
            child = below[number[up]].setdefault(down, {"k": down, "i": number[down], "w": 0.0})
            child["w"] += weight
        below[number[path[-1]]][shard] = {"k": f"{path[-1]}/{shard}", "i": shard, "w": weight}
    return json.dumps([list(below[i].values()) for i in range(len(below))])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key; null is drawn as the empty string. A shard without a weight above 0 gets nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    nodes = F.from_json(F.lit(_children(tree)), "array<array<struct<k:string,i:int,w:double>>>")

    def draw(child):
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), child["k"])), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
        return F.struct((-F.ln(u) / child["w"]).alias("x"), child["i"].alias("i"))

    at = F.lit(0)
    for _ in range(3):
        at = F.array_min(F.transform(F.get(nodes, at), draw))["i"]
    return at


def numbered(rows: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """The rows with `slot`: their place in their shard in the given order (nulls first), from 0 without gaps.

    Rows are dealt to ranges of shard and order, so a shard is spread over as many tasks as its share asks for; the
    rows' places as read come last, so that even rows equal in the order are. Each range numbers its own rows; one row
    for each range and shard in it says how many come before. No two rows of the result share a slot of a shard."""
    keys = [F.col(shard), *(F.col(c).asc_nulls_first() for c in order), F.col("__read")]
    dealt = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__read")
    dealt = stash(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()), "slots")
    runs = dealt.groupBy(F.col("__range").alias("__r"), F.col(shard).alias("__s")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__s").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("__r", "__s", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    out = dealt.join(F.broadcast(runs), (F.col("__range") == F.col("__r")) & (F.col(shard) == F.col("__s")))  # ranges + shards rows at most
    return out.withColumn("slot", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__r", "__s", "__shift")


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shard and place in it: id, size (UTF-8 bytes of the text and 1), text_crc32, shard, slot and,
    with a second tree, grown_shard (its shard there).

    The id and the tree decide alone, so equal ids share a shard, equal texts need not. Slots follow the ids (nulls
    first), then sizes and checksums; rows equal in all three take slots in any order. A null text has no bytes (size
    1, checksum 0); a null id is drawn as the empty string. An empty table gives no rows; other columns are not read.
    Only ids, sizes and checksums are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(F.col(id_col), tree).alias("shard"))
    out = numbered(rows, "shard", ["id", "size", "text_crc32"])
    after = [shard_of(F.col("id"), grown).alias("grown_shard")] if grown is not None else []
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", *after)


def write_shards(docs: DataFrame, tree: Tree, folder: str, id_col: str = "doc_id") -> None:
    """Writes whole documents to <folder>/region=../rack=../shard=../ as Parquet. A shard's rows are dealt to tasks by
    shard and a hash of the id, so no task holds a shard; a column of the documents named like a level is an error."""
    levels = {"region", "rack", "shard"} & set(docs.columns)
    if levels:
        raise ValueError(f"documents have columns {sorted(levels)}")
    place = F.from_json(F.lit(json.dumps({str(s): [str(r), str(k)] for r, k, s, _ in tree})), "map<string,array<string>>")
    rows = docs.withColumn("shard", shard_of(F.col(id_col), tree)).withColumn("__place", F.element_at(place, F.col("shard").cast("string")))
    rows = rows.withColumns({"region": F.col("__place")[0], "rack": F.col("__place")[1]}).drop("__place")
    rows.repartition(F.col("shard"), F.pmod(F.xxhash64(id_col), F.lit(64))).write.partitionBy("region", "rack", "shard").parquet(folder)


def op13_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"), even_tree(SHARDS), even_tree(SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _descent(n: int, name: str) -> str:
    """SQL of the descent through even_tree(n): tables <name>1 to <name>3, the last with doc_id and shard."""
    levels: list[dict] = [{}, {}, {}]
    for region, rack, shard, _ in even_tree(n):
        for level, up, down, label in ((0, "", region, region), (1, region, f"{region}/{rack}", f"{region}/{rack}"), (2, f"{region}/{rack}", shard, f"{region}/{rack}/{shard}")):
            levels[level].setdefault((up, down, label), []).append(shard)
    out, before = [], "(SELECT doc_id, '' AS node FROM documents)"
    for level, kids in enumerate(levels):
        rows = ", ".join(f"('{up}', '{down}', '{label}', {len(w)})" for (up, down, label), w in kids.items())
        u = "(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/' || label), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
        out.append(f"{name}{level + 1} AS (SELECT doc_id, arg_min(down, -ln({u}) / w) AS node FROM {before} t JOIN (VALUES {rows}) k(up, down, label, w) ON t.node = k.up GROUP BY doc_id)")
        before = f"{name}{level + 1}"
    return ", ".join(out)


SQL = {
    "op13_sharding": rf"""
WITH c(tab) AS (SELECT list(v ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(b))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
x AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, c),
{_descent(SHARDS, "a")}, {_descent(SHARDS + 1, "b")}
SELECT x.doc_id, size, text_crc32, 'key' AS law, CAST(a3.node AS INT) AS shard, row_number() OVER (PARTITION BY a3.node ORDER BY x.doc_id) - 1 AS slot, CAST(b3.node AS INT) AS grown_shard
FROM x JOIN a3 USING (doc_id) JOIN b3 USING (doc_id)"""
}
