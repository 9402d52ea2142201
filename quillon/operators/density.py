"""Density clustering of vectors by cosine distance: core distances, the spanning tree of mutual reachability, and the
condensed tree with stabilities.

Definitions. The core distance of a row is the distance to its k-th nearest other row (to the farthest where there are
fewer). The reach of two rows is the largest of their distance and their core distances. The hierarchy is that of the
spanning tree of least total reach: at each level all edges of that reach join at once. A group of at least `least` rows
is a cluster; when clusters meet they end and a larger one begins, groups below `least` fall into the cluster they meet.
A row's density is 1 / reach at which it leaves its cluster (reaches below 1e-9 count as 1e-9); a cluster's stability is
the sum over its rows of that density less the one at which the cluster begins. A cluster stays if it is at least as
stable as the best choice below it; the one that never ends (the whole) does not count. Rows of no such cluster are noise.

Rows of equal unit vectors are one point with a weight, so no number of copies makes ties or a crowd. Distances come from
scans of blocks (blocks.py). The tree grows by rounds in which each component adds its least edge outwards; rows keep a few
edges, so that a round scans only rows whose edges are used up and which may have their component's least one. The edges
are then worked off in ascending stretches of at most PIECE edges: in each the connected parts are solved apart, one at
a time in a task, and every part becomes one node of the next stretch.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.kept import drop, keep, release_shuffles
from quillon.functions.vectors import doubles, unit
from quillon.operators.blocks import Blocks, Nearest, Outside, build, points, scan, with_column

PIECE = 500_000
NEAR = 8  # edges outwards that a row keeps of a scan
FLOOR = 1e-9
GENERATIONS = 24  # bits of a cluster's number that count its ancestors along one point
NO = -1


def told(u):
    """A key for a vector; where two vectors share one, points are numbered instead."""
    return F.xxhash64(u)


def distinct_points(df: DataFrame, id_col: str, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; points: key, u, weight) of the rows that have a vector. The points are kept until they are indexed."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.transform(unit(doubles(vector)), lambda x: F.round(x, 12) + 0.0).alias("u"))
    single = keep(rows.groupBy("u").agg(F.count("*").cast("double").alias("weight")).withColumns({"key": told(F.col("u")), "number": F.monotonically_increasing_id()}), "points")
    release_shuffles(df.sparkSession)
    if single.groupBy("key").count().where("count > 1").limit(1).count():  # rows find their points by whole vectors
        keyed = single.select(F.col("number").alias("key"), "u", "weight")
        rows = rows.join(keyed.select(F.col("u").alias("v"), "key"), F.col("u") == F.col("v")).select("id", "key")
        return rows, keyed
    keyed = single.select("key", "u", "weight")
    keyed.kept_at = single.kept_at
    return rows.select("id", told(F.col("u")).alias("key")), keyed


def _indexed(single: DataFrame) -> Blocks:
    """The points in blocks; the points themselves go where rows need only their keys."""
    index = build(single, "key", "u", {"weight": F.col("weight")})
    if hasattr(single, "kept_at"):
        drop(single)
    return index


def _back(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """id and columns of every row, from a table key, columns of the points."""
    return rows.join(found.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("id", *columns)


class Cores(Nearest):
    """Kernel: the least distance within which k other rows stand, copies counted: p, core."""

    SCHEMA = "p long, core double"

    def __init__(self, k: int):
        super().__init__(k, same=True, payload="weight")

    def finish(self) -> pa.RecordBatch:
        # the count of rows at each found point's distance or nearer; the row's own copies come first, at distance 0
        enough = (self.block.weight - 1)[:, None] + self.w.cumsum(1) >= self.k
        last = np.maximum(np.isfinite(self.c).sum(1) - 1, 0)  # the farthest, where there are fewer rows
        at = np.where(enough.any(1), enough.argmax(1), last)
        core = 1 - self.c[np.arange(len(at)), at]
        core = np.where((self.block.weight > self.k) | ~np.isfinite(core), 0.0, np.round(np.maximum(core, 0), 12))
        return pa.RecordBatch.from_arrays([pa.array(self.block.p), pa.array(core)], names=["p", "core"])


def _cores(index: Blocks, k: int) -> DataFrame:
    return scan(index, index, Cores(k), Cores.SCHEMA)


def core_distances(df: DataFrame, id_col: str, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(id, core) of every row that has a vector; repeated ids are rows of their own. An empty table gives no rows."""
    rows, single = distinct_points(df, id_col, vector)
    index = _indexed(single)
    found = points(index).join(_cores(index, k).withColumnRenamed("p", "q"), F.col("p") == F.col("q")).select(F.col("id").alias("key"), "core")
    return _back(rows, found, ["core"]).withColumnRenamed("id", id_col)


def _joined(up: DataFrame) -> DataFrame:
    """c, root for the table c, up of components that each point to another one (pairs may point to each other)."""
    back = up.select(F.col("c").alias("b"), F.col("up").alias("back"))
    now = up.join(back, F.col("up") == F.col("b"), "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up"))
    now = keep(now, "tree-roots")
    while True:
        higher = now.select(F.col("c").alias("b"), F.col("up").alias("higher"))
        then = keep(now.join(higher, F.col("up") == F.col("b")).select("c", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")), "tree-roots")
        drop(now)
        if not then.where("moved").limit(1).count():
            return then.select("c", F.col("up").alias("root"))
        now, at = then.drop("moved"), then.kept_at
        now.kept_at = at


def _outside(index: Blocks, rows: DataFrame, all_: bool) -> DataFrame:
    """Outside's table for the rows p, core, comp, need (every p) whose need is not 0."""
    marked = with_column(index, rows, "core", "comp", "need")
    table = keep(marked.table, "tree-blocks")  # tasks read it over and over
    marked.table, marked.extra = table, {e: t for e, t in marked.extra.items() if e in ("core", "comp", "need")}
    some = marked if all_ else copy(marked)
    if not all_:
        some.table = table.where(F.array_max("need") > 0)
    release_shuffles(index.table.sparkSession)
    out = keep(scan(some, marked, Outside(NEAR), Outside.SCHEMA), "tree-reaches")
    drop(table)
    release_shuffles(index.table.sparkSession)
    return out


def spanning_tree(index: Blocks, cores: DataFrame) -> DataFrame:
    """(a, b, reach): the edges of the least spanning tree of mutual reachability over the points' numbers, a < b.

    Each row keeps the NEAR least edges to other components that a scan found, and the reach of the last of them, below
    which nothing else lies outside. Edges inside a component go. A row is scanned again only when it has no edge left and
    that reach is not above the least edge which its component has already."""
    comp, edges = keep(cores.select("p", "core", F.col("p").alias("comp")), "tree-components"), []
    cells = bounds = None
    for _ in range(64):
        if comp.select("comp").distinct().limit(2).count() < 2:
            break
        if cells is None:
            need, all_ = comp.withColumn("need", F.lit(1).cast("long")), True
        else:
            ends = comp.select(F.col("p").alias("e"), F.col("comp").alias("now"))
            mine = cells.select("p", "reach", "q").join(ends, F.col("p") == F.col("e")).select("p", F.col("now").alias("comp"), "reach", "q")
            left = keep(mine.join(ends, F.col("q") == F.col("e")).where("comp <> now").select("p", "comp", "reach", "q", F.col("now").alias("other")), "tree-cells")
            drop(cells)
            cells = left
            known = cells.groupBy("comp").agg(F.min("reach").alias("has")).withColumnRenamed("comp", "of")
            none = comp.join(cells.select(F.col("p").alias("c")).distinct(), F.col("p") == F.col("c"), "left_anti").select("p", "comp")
            none = none.join(bounds.withColumnRenamed("p", "b"), F.col("p") == F.col("b")).join(known, F.col("comp") == F.col("of"), "left").where("bound < double('infinity') AND (has IS NULL OR bound <= has)")
            asked = keep(none.select(F.col("p").alias("n")), "tree-asked")
            need, all_ = comp.join(asked, F.col("p") == F.col("n"), "left").select("p", "core", "comp", F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("need")), False
        if all_ or asked.limit(1).count():
            found = _outside(index, need, all_)
            heads = found.where("rank = 0").select("p", "bound")
            found_cells = found.select("p", "comp", "reach", "q", "other")
            if all_:
                cells, bounds = keep(found_cells, "tree-cells"), keep(heads, "tree-bounds")
            else:
                old = cells, bounds
                cells = keep(cells.unionByName(found_cells), "tree-cells")
                bounds = keep(bounds.join(asked, F.col("p") == F.col("n"), "left_anti").unionByName(heads), "tree-bounds")
                drop(*old)
            drop(found)
        a, b = F.least("p", "q"), F.greatest("p", "q")
        least = keep(cells.groupBy("comp").agg(F.min(F.struct("reach", a.alias("a"), b.alias("b"), "other")).alias("e")).select("comp", "e.*"), "tree-steps")
        if not all_:
            drop(asked)
        edges.append(least.select("a", "b", "reach").distinct())
        roots = _joined(least.select(F.col("comp").alias("c"), F.col("other").alias("up")))
        then = keep(comp.join(roots, F.col("comp") == F.col("c")).select("p", "core", F.col("root").alias("comp")), "tree-components")
        drop(comp)
        comp = then
    drop(comp, *(x for x in (cells, bounds) if x is not None))
    out = edges[0] if edges else cores.sparkSession.createDataFrame([], "a long, b long, reach double")
    for e in edges[1:]:
        out = out.unionByName(e)
    out = keep(out, "tree")
    if out.count() != max(index.rows - 1, 0):
        raise RuntimeError("the spanning tree has a cycle")
    return out


def tree_weight(df: DataFrame, id_col: str, k: int = 5, vector: str = "embedding") -> DataFrame:
    """n (edges, those between copies too) and total (their reach) of the spanning tree of all rows that have a vector."""
    _, single = distinct_points(df, id_col, vector)
    index = _indexed(single)
    cores = keep(_cores(index, k), "cores")
    within = points(index, "weight").join(cores.withColumnRenamed("p", "q"), F.col("p") == F.col("q")).agg(F.coalesce(F.sum(F.col("weight") - 1), F.lit(0.0)).alias("m"), F.coalesce(F.sum((F.col("weight") - 1) * F.col("core")), F.lit(0.0)).alias("w"))
    between = spanning_tree(index, cores).agg(F.count("*").alias("n"), F.coalesce(F.sum("reach"), F.lit(0.0)).alias("total"))
    return between.join(within).select((F.col("n") + F.col("m")).cast("long").alias("n"), (F.col("total") + F.col("w")).alias("total"))


def _parts(edges: DataFrame) -> DataFrame:
    """(node, part) of the nodes of a forest's edges a, b: each node takes the least part beside it, and parts follow their
    own part, until nothing moves."""
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "parts-edges")
    now = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("part")), "parts")
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("part").alias("near"))
        low = now.join(near, F.col("node") == F.col("a")).select("node", "part", F.least("part", "near").alias("low"))
        step = low.select(F.col("node").alias("m"), F.col("low").alias("of"))
        then = keep(low.join(step, F.col("low") == F.col("m")).select("node", F.col("of").alias("part"), (F.col("of") != F.col("part")).alias("moved")), "parts")
        if not then.where("moved").limit(1).count():
            return then.drop("moved")
        now = then.drop("moved")


STATE = ["size", "cluster", "gone", "below"]  # rows; open cluster or NO; sum of densities of rows that left it; best choice below it
SOLVED = "kind string, node long, of long, size double, cluster long, gone double, below double, parent long, stability double, stays boolean"


def _solve(least: int):
    """Works off one connected part of a stretch: edges a, b, reach and the states of its nodes."""

    def run(states: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = states["node"].to_numpy()
        place = {x: i for i, x in enumerate(nodes)}
        state = [list(x) for x in zip(*(states[c].tolist() for c in STATE))]
        up, members, out = list(range(len(nodes))), [[i] for i in range(len(nodes))], []

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def home(group, cluster):
            for i in members[group]:
                if i >= 0:
                    out.append(("home", nodes[i], cluster) + (None,) * 7)
            members[group] = []

        edges = edges.sort_values(["reach", "a", "b"])
        a, b, reach = ([place[x] for x in edges["a"]], [place[x] for x in edges["b"]], edges["reach"].to_numpy())
        k = 0
        while k < len(reach):
            end = int(np.searchsorted(reach, reach[k], "right"))
            density, touched = 1 / max(reach[k], FLOOR), {}
            for x, y in zip(a[k:end], b[k:end]):
                x, y = sorted((root(x), root(y)), key=lambda i: nodes[i])
                up[y] = x
                touched[x] = touched.pop(x, {x}) | touched.pop(y, {y})
            for top, groups in touched.items():
                size = sum(state[g][0] for g in groups)
                big = sorted((g for g in groups if state[g][1] != NO), key=lambda g: state[g][1])
                small = [g for g in groups if state[g][1] == NO]
                loose = sum(state[g][0] for g in small)
                cluster, gone, below = NO, 0.0, 0.0
                if len(big) == 1:
                    _, cluster, gone, below = state[big[0]]
                    gone += loose * density
                elif big or size >= least:
                    generation = max((state[g][1] & ((1 << GENERATIONS) - 1) for g in big), default=-1) + 1
                    cluster, gone = int(nodes[top]) << GENERATIONS | generation, size * density
                    for g in big:
                        n, old, left, under = state[g]
                        stability = left - n * density
                        below += max(stability, under)
                        out.append(("cluster", old, None, n, None, None, None, cluster, stability, bool(stability >= under)))
                mine = [i for g in groups for i in members[g]]
                for g in groups:
                    if g != top:
                        members[g] = []
                if cluster != NO:
                    for g in small:
                        members[g] = members[g] if g == top else members[g]
                    members[top] = mine
                    home(top, cluster)
                else:
                    members[top] = mine
                state[top] = [size, cluster, gone, below]
            k = end
        for i in range(len(nodes)):
            r = root(i)
            if r == i:
                out.append(("state", nodes[i], None, *state[i], None, None, None))
            out.append(("node", nodes[i], nodes[r]) + (None,) * 7)
        return pd.DataFrame(out, columns=["kind", "node", "of", "size", "cluster", "gone", "below", "parent", "stability", "stays"])

    return run


def condensed(edges: DataFrame, weights: DataFrame, least: int, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(home: p, cluster it falls into; clusters: cluster, parent, rows, stability, stays) from a spanning tree (a, b,
    reach) and the points' weights and core distances (p, weight, core). The whole is not among the clusters. Points
    without a cluster have no home."""
    alone = F.col("weight") >= least  # copies enough for a cluster by themselves
    own = F.when(alone, F.shiftleft(F.col("p"), GENERATIONS)).otherwise(F.lit(NO))
    states = weights.select(F.col("p").alias("node"), F.col("weight").alias("size"), own.alias("cluster"), F.when(alone, F.col("weight") / F.greatest("core", F.lit(FLOOR))).otherwise(0.0).alias("gone"), F.lit(0.0).alias("below"))
    states = keep(states, "tree-states")
    homes = [weights.where(alone).select("p", F.shiftleft(F.col("p"), GENERATIONS).alias("cluster"))]
    open_ = keep(weights.where(~alone).select("p", F.col("p").alias("node")), "tree-open")
    clusters, total = [], edges.count()
    cuts = sorted(set(edges.agg(F.percentile_approx("reach", [i / -(-total // piece) for i in range(1, -(-total // piece))], 100_000)).first()[0])) if total > piece else []
    for low, high in zip([-1.0, *cuts], [*cuts, float("inf")]):
        mapped = edges.where((F.col("reach") > low) & (F.col("reach") <= high))
        if low >= 0:
            known = lambda end: now.select(F.col("p").alias(f"p_{end}"), F.col("node").alias(f"n_{end}"))
            mapped = mapped.join(known("a"), F.col("a") == F.col("p_a")).join(known("b"), F.col("b") == F.col("p_b")).select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), "reach")
        mapped = keep(mapped, "tree-stretch")
        if not cuts:
            parts = states.select("node", F.lit(0).cast("long").alias("part"))  # one stretch: PIECE edges at most
        else:
            parts = _parts(mapped)
        dealt = states.join(parts.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).drop("m")
        lines = mapped.join(parts, F.col("a") == F.col("node")).select(F.col("part").alias("of_part"), "a", "b", "reach")
        solver = _solve(least)
        solved = dealt.groupBy("part").cogroup(lines.groupBy("of_part")).applyInPandas(solver, SOLVED)
        solved = keep(solved, "tree-solved")
        clusters.append(solved.where("kind = 'cluster'").select(F.col("node").alias("cluster"), "parent", F.col("size").alias("rows"), "stability", "stays"))
        placed = solved.where("kind = 'home'").select(F.col("node").alias("m"), F.col("of").alias("home"))
        homes.append(open_.join(placed, F.col("node") == F.col("m")).select("p", F.col("home").alias("cluster")))
        if high == float("inf"):
            break
        moved = solved.where("kind = 'node'").select(F.col("node").alias("m"), F.col("of").alias("to"))
        open_ = keep(open_.join(placed.select("m"), F.col("node") == F.col("m"), "left_anti").join(moved, F.col("node") == F.col("m"), "left").select("p", F.coalesce("to", "node").alias("node")), "tree-open")
        base = states.select(F.col("node").alias("p"), F.col("node")) if low < 0 else now
        now = keep(base.join(moved, F.col("node") == F.col("m"), "left").select("p", F.coalesce("to", "node").alias("node")), "tree-nodes")
        untouched = states.join(moved.select("m"), F.col("node") == F.col("m"), "left_anti")
        states = keep(untouched.unionByName(solved.where("kind = 'state'").select("node", *STATE)), "tree-states")
    out = homes[0]
    for h in homes[1:]:
        out = out.unionByName(h)
    every = clusters[0]
    for c in clusters[1:]:
        every = every.unionByName(c)
    return keep(out, "tree-homes"), keep(every, "tree-clusters")


def _topmost(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the highest cluster that stays among a cluster and those above it; null if none does."""
    known = clusters.select(F.col("cluster").alias("k"))
    now = clusters.join(known, F.col("parent") == F.col("k"), "left").select("cluster", F.col("k").alias("up"), F.when(F.col("stays"), F.col("cluster")).alias("chosen"))
    now = keep(now, "tree-chosen")
    while now.where("up IS NOT NULL").limit(1).count():
        above = now.select(F.col("cluster").alias("k"), F.col("up").alias("higher"), F.col("chosen").alias("better"))
        then = now.join(above, F.col("up") == F.col("k"), "left").select("cluster", F.col("higher").alias("up"), F.coalesce("better", "chosen").alias("chosen"))
        now = keep(then, "tree-chosen")
    return now.select("cluster", "chosen")


def density_clusters(df: DataFrame, id_col: str, least: int = 10, k: int = 5, vector: str = "embedding", piece: int = PIECE) -> DataFrame:
    """(id, cluster, stability): a cluster is named by its smallest id; rows of none have null. Rows without a vector are
    left out, repeated ids are rows of their own, copies of a vector share a cluster. An empty table gives no rows."""
    if least < 2 or k < 1:
        raise ValueError("a cluster has at least two rows, and k is at least 1")
    rows, single = distinct_points(df, id_col, vector)
    index = _indexed(single)
    cores = keep(_cores(index, k), "cores")
    edges = spanning_tree(index, cores)
    weights = points(index, "weight").select("p", "id", "weight").join(cores.select(F.col("p").alias("q"), "core"), F.col("p") == F.col("q")).drop("q")
    home, clusters = condensed(edges, weights, least, piece)
    chosen = _topmost(clusters).where("chosen IS NOT NULL").join(clusters.select(F.col("cluster").alias("x"), "stability"), F.col("chosen") == F.col("x")).select(F.col("cluster").alias("y"), "chosen", "stability")
    mine = home.join(chosen, F.col("cluster") == F.col("y")).select(F.col("p").alias("z"), "chosen", "stability")
    named = weights.join(mine, F.col("p") == F.col("z"), "left").select(F.col("id").alias("key"), "chosen", "stability")
    out = keep(_back(rows, named, ["chosen", "stability"]), "density")
    names = out.where("chosen IS NOT NULL").groupBy(F.col("chosen").alias("c")).agg(F.min("id").alias("cluster"))
    return out.join(names, F.col("chosen") == F.col("c"), "left").select(F.col("id").alias(id_col), "cluster", "stability")
