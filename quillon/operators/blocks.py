"""A metric index: unit vectors in blocks of bounded size with a centre and a radius, and scans of blocks by blocks.

Rows are dealt to a few pivots by angle and packed in that order, a block a row of the table. A scan brings every left
block together with the right blocks, one at a time. Left blocks that stand together are held by one task, up to HELD
bytes; each task reads the right blocks itself from where the table is kept (a Cartesian product of left groups with the
table), so that no copy of them is shuffled or written, however many groups there are. By the triangle inequality on
angles a right block whose nearest possible vector is farther than all rows still care for is passed over, exactly. Rows
are never paired outside a matrix product, and a scan hands on what its kernel makes of a left block alone. Kernels that
look for few near rows take products of single floats first; what these cannot rule out is worked out in double floats.
"""

from __future__ import annotations

from collections.abc import Mapping
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.kept import drop, keep, release_shuffles
from quillon.functions.vectors import doubles, unit

ROWS, BYTES = 4096, 4 << 20  # of a block, at most
HELD = 48 << 20  # bytes of left blocks that a task holds at most
PIVOTS = 256
SLACK = 1e-9  # of cosines, against rounding
TILE = 512  # rows of a left block that are multiplied at once


class Blocks:
    """table: block (dense numbers), p (dense row numbers from 0), ids, x (float64, row by row), centre, radius, low, high (of `by`) and
    the extra columns as arrays; rows, width, count (blocks): of the whole; kind: of the ids; groups: i,
    g, left_low, left_high of each block's group 0, 1, ... and its bounds."""

    def __init__(self, table: DataFrame, rows: int, width: int, count: int, kind: str, extra: Mapping[str, str], groups: DataFrame):
        self.table, self.rows, self.width, self.count, self.kind, self.extra, self.groups = table, rows, width, count, kind, dict(extra), groups


class View:
    """A block inside a task."""

    def __init__(self, row: dict, width: int, extra):
        self.number = row["block"]
        self.p, self.ids = np.asarray(row["p"], np.int64), row["ids"]
        self.q = self.ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(self.ids.type) and not self.ids.null_count else self.p
        self.x = np.frombuffer(row["x"]).reshape(len(self.p), width)
        self.centre, self.radius = np.frombuffer(row["centre"]), row["radius"]
        self.low, self.high, self.own = row["low"], row["high"], True  # own: is the left block itself
        for name in extra:
            setattr(self, name, np.asarray(row[name]))

    @cached_property
    def single(self) -> np.ndarray:
        return self.x.astype(np.float32)


def build(df: DataFrame, id_col: str, vector: str = "embedding", extra: Mapping[str, Column] | None = None, by: str | None = None, stretches: int = 1) -> Blocks:
    """Packs the rows that have a vector. extra: more columns, long or double without nulls; `by` names one of them whose
    bounds a block keeps, and rows are parted by it into about so many stretches before angles count. A zero vector has
    cosine 0 with all; a block that has one is never passed over."""
    spark, extra = df.sparkSession, dict(extra or {})
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), unit(doubles(vector)).alias("u"), *(c.alias(n) for n, c in extra.items()))
    if not hasattr(df, "kept_at"):
        rows = keep(rows, "index-rows")  # the passes below read it, not what it comes from
    kind = rows.schema["id"].dataType.simpleString()
    types = {n: rows.schema[n].dataType.simpleString().replace("bigint", "long") for n in extra}
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("u")), F.lit(0))).first()
    most = max(64, min(ROWS, BYTES // (8 * max(width, 1))))
    parallel = 2 * int(spark.sparkContext.defaultParallelism**0.5) + 1
    count = max(1, -(-n // most), min(-(-n // 64), parallel))
    few = rows.orderBy(F.xxhash64("u"), "id").select("u").limit(min(PIVOTS, int(n**0.5) + 1)).collect()  # a bounded number of vectors
    pivots = spark.sparkContext.broadcast(np.array([r[0] for r in few]).reshape(len(few), width))

    def placed(batches):
        for b in batches:
            x = b.column("u").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if x.shape[1] != width and b.num_rows:
                raise ValueError("vectors of different lengths")
            c = x @ pivots.value.T if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.argmax(1).astype(np.int32)), pa.array(c.max(1))], names=[*b.schema.names, "pivot", "c"])

    fields = "".join(f", `{x}` {t}" for x, t in types.items())
    spots = rows.mapInArrow(placed, f"id {kind}, u array<double>{fields}, pivot int, c double")
    cuts = sorted(set(rows.agg(F.percentile_approx(by, [k / stretches for k in range(1, stretches)])).first()[0] or [])) if by and stretches > 1 else []
    stretch = sum((F.col(by) >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    order = ["stretch", "pivot", F.desc("c"), "id", "u"]
    dealt = spots.withColumn("stretch", stretch).repartitionByRange(count, *order).sortWithinPartitions(*order).drop("stretch", "pivot", "c")

    def pack(part: dict) -> pa.RecordBatch:
        x = np.array(part["u"]).reshape(len(part["u"]), width)
        centre = x.sum(0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 0 else centre
        zero = (x * x).sum(1) == 0
        radius = np.pi if size == 0 or zero.any() else float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        bounds = [float(f(part[by])) if by else 0.0 for f in (min, max)]
        one = lambda v, t: pa.array([v], t)
        cols = [one(part["block"], pa.int64()), one(list(range(len(x))), pa.list_(pa.int64())), one(part["id"], pa.list_(part["of"])), one(x.tobytes(), pa.binary()), one(centre.tobytes(), pa.binary()), one(radius, pa.float64()), one(bounds[0], pa.float64()), one(bounds[1], pa.float64())]
        cols += [one(part[e], pa.list_(pa.float64() if types[e] == "double" else pa.int64())) for e in types]
        return pa.RecordBatch.from_arrays(cols, names=["block", "p", "ids", "x", "centre", "radius", "low", "high", *types])

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict = {"id": [], "u": [], **{e: [] for e in types}}
        for b in batches:
            held["of"] = b.schema.field("id").type
            for a in range(0, b.num_rows, most):
                for c in ("id", "u", *types):
                    held[c] += b.column(c).slice(a, most).to_pylist()
                while len(held["id"]) >= most:
                    yield pack({**{c: held[c][:most] for c in ("id", "u", *types)}, "block": number, "of": held["of"]})
                    number += 1
                    for c in ("id", "u", *types):
                        held[c] = held[c][most:]
        if held["id"]:
            yield pack({**held, "block": number})

    schema = f"block long, p array<long>, ids array<{kind}>, x binary, centre binary, radius double, low double, high double{''.join(f', `{e}` array<{t}>' for e, t in types.items())}"
    kept = keep(dealt.mapInArrow(packed, schema), "blocks")
    if hasattr(rows, "kept_at"):
        drop(rows)
    del dealt, spots
    release_shuffles(spark)
    order = W.orderBy("block")  # one narrow row a block
    known = keep(kept.select("block", "low", "high", F.size("p").alias("k")).select(F.col("block").alias("b"), (F.row_number().over(order) - 1).cast("long").alias("number"), F.coalesce(F.sum("k").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.col("low").alias("left_low"), F.col("high").alias("left_high")), "block-starts")
    starts = F.broadcast(known.select("b", "number", "start"))
    table = kept.join(starts, F.col("block") == F.col("b")).withColumn("block", F.col("number")).withColumn("p", F.transform("p", lambda i: i + F.col("start"))).drop("b", "number", "start")
    table.kept_at = kept.kept_at
    total = known.count()
    most = max(1, min(HELD // max(8 * width * -(-n // max(total, 1)), 1), -(-total // (2 * spark.sparkContext.defaultParallelism))))
    groups = known.select(F.col("number").alias("i"), F.floor(F.col("number") / most).cast("int").alias("g"), "left_low", "left_high")
    return Blocks(table, n, width, total, kind, types, groups)


def points(blocks: Blocks, *columns: str) -> DataFrame:
    """p, id and extra columns, a row for each packed row."""
    zipped = F.explode(F.arrays_zip("p", "ids", *columns)).alias("x")
    return blocks.table.select(zipped).select("x.p", F.col("x.ids").alias("id"), *(F.col(f"x.{c}").alias(c) for c in columns))


def with_column(blocks: Blocks, values: DataFrame, *names: str) -> Blocks:
    """The blocks with more extra columns, from a table p, names that has every p."""
    kinds = {n: values.schema[n].dataType.simpleString().replace("bigint", "long") for n in names}
    placed = blocks.table.select("block", F.posexplode("p").alias("pos", "p")).join(values.select(F.col("p").alias("q"), *names), F.col("p") == F.col("q"))
    lists = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("cells")).select(F.col("block").alias("b"), *(F.col("cells")[n].alias(n) for n in names))
    table = blocks.table.drop(*names).join(lists, F.col("block") == F.col("b")).drop("b")
    return Blocks(table, blocks.rows, blocks.width, blocks.count, blocks.kind, {**blocks.extra, **kinds}, blocks.groups)


def nearest_possible(a: View, b: View) -> float:
    """No vector of one block has a larger cosine with one of the other."""
    between = np.arccos(np.clip(a.centre @ b.centre, -1, 1)) - a.radius - b.radius
    return float(np.cos(max(between, 0.0)))


def cosines(a: View, b: View) -> np.ndarray:
    """Of all rows; the same product whichever side a block stands on, so that a pair has one cosine."""
    return np.round(a.x @ b.x.T if a.number <= b.number else (b.x @ a.x.T).T, 12)


def exact(a: View, b: View, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of pairs of rows, each pair by itself, so that it has one cosine from either side."""
    return np.round(np.einsum("ij,ij->i", a.x[i], b.x[j]), 12)


def near(a: View, b: View, rows: np.ndarray, columns: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row of a, row of b, cosine) of the pairs of these rows and columns whose cosine is at least what its row asks for;
    None if there may be more than `most`. A cosine of single floats is off by less than `slack`."""
    slack = (a.x.shape[1] + 4) * 1.3e-7
    floor, found, n = (least - slack).astype(np.float32), [], 0
    whole = len(rows) == len(a.x), len(columns) == len(b.x)
    x, y = a.single if whole[0] else a.single[rows], b.single if whole[1] else b.single[columns]
    for at in range(0, len(rows), TILE):
        c, low = x[at : at + TILE] @ y.T, floor[at : at + TILE]
        hit = np.flatnonzero(c.max(1) >= low)
        i, j = np.nonzero(c[hit] >= low[hit, None])
        found.append((hit[i] + at, j))
        n += len(i)
        if n > most:
            return None
    i, j = (np.concatenate(x) for x in zip(*found))
    i, j, least = rows[i], columns[j], least[i]
    c = exact(a, b, i, j)
    real = c >= least
    return i[real], j[real], c[real]


def scan(left: Blocks, right: Blocks, kernel, schema: str, meet: Column | None = None, once: bool = False) -> DataFrame:
    """What a kernel finds for each left block's rows over the right blocks (schema, from its finish()).

    A kernel has begin(block), least(block): the smallest cosine that still matters to any row against that block (None:
    the block does not matter), meet(block) and finish(); each left block has a copy of its own. meet: a condition on
    left_low, left_high, right_low, right_high by which pairs of blocks are left out. once: of two different blocks only
    one meets the other; block.own tells whether the right block is the left one."""
    width, same, names = left.width, left is right, ["block", "p", "ids", "x", "centre", "radius", "low", "high"]
    both = [e for e in left.extra if e in right.extra]
    count = left.groups.agg(F.coalesce(F.max("g"), F.lit(0))).first()[0] + 1
    mine = left.table.join(F.broadcast(left.groups.select("i", "g")), F.col("block") == F.col("i"))  # two numbers a block
    mine = mine.withColumn("ids", F.array().cast(f"array<{right.kind}>"))  # a left row is known by its p alone
    mine = mine.repartitionById(count, "g").select(*(F.col(c).alias(f"left_{c}") for c in (*names, *both)))
    rest = right.table.select(*(F.col(c).alias(f"right_{c}") for c in (*names, *both))).coalesce(1)  # each group reads it through
    wanted = F.lit(True) if meet is None else meet
    if once:
        apart = F.col("right_block") - F.col("left_block")
        wanted = wanted & ((apart == 0) | ((apart > 0) == (F.pmod(apart, F.lit(2)) == 1)))
    pairs = rest.join(mine.hint("shuffle_replicate_nl"), wanted)

    def run(batches):
        def block_of(batch, k: int, side: str) -> View:
            column = lambda c: batch.column(f"{side}_{c}")
            row = {c: column(c)[k].as_py() for c in names if c not in ("p", "ids")}
            row |= {c: column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("p", *both)}
            row["ids"] = column("ids").slice(k, 1).flatten()
            if side == "left":  # what is held must not hold its whole batch
                row |= {c: row[c].copy() for c in ("p", *both)} | {"ids": pa.array([], row["ids"].type)}
            return View(row, width, both)

        held, block = {}, None
        for batch in batches:
            lefts, rights = (batch.column(f"{side}_block").to_pylist() for side in ("left", "right"))
            for k, (i, j) in enumerate(zip(lefts, rights)):
                if block is None or block.number != j:
                    block = block_of(batch, k, "right")
                if i not in held:
                    held[i] = (view := block_of(batch, k, "left")), copy(kernel)
                    held[i][1].begin(view)
                view, one = held[i]
                block.own = i == j and same
                least = one.least(block)
                if least is None or nearest_possible(view, block) < least - SLACK:
                    continue
                one.meet(block)
        yield from (one.finish() for _, one in held.values())

    return pairs.mapInArrow(run, schema)


class Nearest:
    """Kernel: the k largest cosines of each row, ties by q; the row itself left out if same is set. Gives p, found:
    array<struct<q long, cosine double, <payload>>>, where q is the right row's id if ids are numbers, else its p."""

    def __init__(self, k: int, same: bool, payload: str | None = None):
        self.k, self.same, self.payload = k, same, payload

    def schema(self) -> str:
        return "p long, found array<struct<q:long,cosine:double" + (f",{self.payload}:double" if self.payload else "") + ">>"

    def begin(self, block: View) -> None:
        self.block = block
        n = len(block.p)
        self.c, self.q, self.w = np.full((n, self.k), -np.inf), np.zeros((n, self.k), np.int64), np.zeros((n, self.k))

    def least(self, block: View) -> float:
        return float(self.c[:, -1].min())

    def meet(self, block: View) -> None:
        worst = self.c[:, -1]
        few = near(self.block, block, np.arange(len(worst)), np.arange(len(block.p)), worst, 16 * self.k * len(worst)) if np.isfinite(worst).all() else None
        i, j, c = few or self._best(block)
        if self.same and self.block.number == block.number:
            i, j, c = (x[i != j] for x in (i, j, c))
        rows = np.unique(i)
        if not len(rows):
            return
        old = lambda x: x[rows].ravel()
        i, c, q = np.r_[np.repeat(rows, self.k), i], np.r_[old(self.c), c], np.r_[old(self.q), block.q[j]]
        w = np.r_[old(self.w), getattr(block, self.payload)[j] if self.payload else np.zeros(len(j))]
        order = np.lexsort((q, -c, i))
        starts = np.searchsorted(i[order], rows)
        order = order[starts[:, None] + np.arange(self.k)]  # each row has k old cells at least
        self.c[rows], self.q[rows], self.w[rows] = c[order], q[order], w[order]

    def _best(self, block: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of that block alone (k + 1 with the row itself), ties by q."""
        k, found = self.k + int(self.same), []
        every, m = cosines(self.block, block), len(block.p)
        for at in range(0, len(every), TILE):
            c = every[at : at + TILE]
            if m > k:
                part = np.argpartition(-c, k - 1, axis=1)[:, :k]
                edge = np.take_along_axis(c, part, 1).min(1)
                crowded = np.flatnonzero((c >= edge[:, None]).sum(1) > k)
                if len(crowded):  # rows with ties at the edge: the smaller numbers stay
                    by_q = np.argsort(block.q, kind="stable")
                    part[crowded] = by_q[np.argsort(-c[crowded][:, by_q], axis=1, kind="stable")[:, :k]]
            else:
                part = np.broadcast_to(np.arange(m), (len(c), m))
            found.append((np.repeat(np.arange(at, at + len(c)), part.shape[1]), part.ravel(), np.take_along_axis(c, part, 1).ravel()))
        return tuple(np.concatenate(x) for x in zip(*found))

    def finish(self) -> pa.RecordBatch:
        real = np.isfinite(self.c)
        counts = real.sum(1)
        cells = [pa.array(self.q[real]), pa.array(self.c[real])] + ([pa.array(self.w[real].astype(float))] if self.payload else [])
        rows = pa.StructArray.from_arrays(cells, names=["q", "cosine", *([self.payload] if self.payload else [])])
        return pa.RecordBatch.from_arrays([pa.array(self.block.p), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), rows)], names=["p", "found"])


class Earlier:
    """Kernel: the largest cosine of each row with a row whose `t` is smaller: p, cosine (rows without one are left out)."""

    SCHEMA = "p long, cosine double"

    def begin(self, block: View) -> None:
        self.block, self.best = block, np.full(len(block.p), -np.inf)

    def least(self, block: View) -> float | None:
        late = self.block.t > block.low
        return float(self.best[late].min()) if late.any() else None

    def meet(self, block: View) -> None:
        late = np.flatnonzero(self.block.t > block.low)
        c = cosines(self.block, block)[late]
        if block.high >= self.block.t[late].min():
            c = np.where(block.t[None, :] < self.block.t[late][:, None], c, -np.inf)
        self.best[late] = np.maximum(self.best[late], c.max(1))

    def finish(self) -> pa.RecordBatch:
        real = np.isfinite(self.best)
        return pa.RecordBatch.from_arrays([pa.array(self.block.p[real]), pa.array(self.best[real])], names=["p", "cosine"])


class Outside:
    """Kernel for spanning trees: for each row whose `need` is not 0 the k least (reach, q) over rows of other components,
    where the reach of two rows is the largest of their distance 1 - cosine and their core distances. Columns core, comp and
    need must be there. bound: no further row of another component is nearer (infinite where there is none)."""

    SCHEMA = "p long, comp long, rank int, reach double, q long, other long, bound double"
    NONE = np.iinfo(np.int64).max

    def __init__(self, k: int):
        self.k = k

    def begin(self, block: View) -> None:
        n = len(block.p)
        self.block, self.reach = block, np.full((n, self.k), np.inf)
        self.q, self.other = np.full((n, self.k), self.NONE), np.zeros((n, self.k), np.int64)
        self.rows = np.flatnonzero(block.need)
        comps, counts = np.unique(block.comp[self.rows], return_counts=True)
        self.main, self.one = (comps[counts.argmax()] if len(comps) else self.NONE), len(comps) <= 1

    def least(self, block: View) -> float | None:
        if not len(self.rows) or (self.one and (block.comp == self.main).all()):
            return None
        worst = self.reach[self.rows, -1].max()
        if block.core.min() > worst:
            return None
        return -np.inf if np.isinf(worst) else 1 - worst

    def meet(self, block: View) -> None:
        mine = self.block.comp[self.rows] == self.main  # the component that most rows are of does not meet itself
        for rows, columns in ((self.rows[mine], block.comp != self.main), (self.rows[~mine], np.ones(len(block.p), bool))):
            for at in range(0, len(rows), TILE):
                some = rows[at : at + TILE]
                worst = self.reach[some, -1]
                self._meet(block, some, np.flatnonzero(columns & (block.core <= worst.max())), worst)

    def _meet(self, block: View, rows: np.ndarray, columns: np.ndarray, worst: np.ndarray) -> None:
        if not len(columns):
            return
        few = near(self.block, block, rows, columns, 1 - worst - 2e-12, 32 * self.k * len(rows)) if np.isfinite(worst).all() else None
        if few:
            i, j, c = few
        else:  # the k least of these columns alone, and what ties with them
            r = np.maximum(np.maximum(1 - self.block.x[rows] @ block.x[columns].T, block.core[columns]), self.block.core[rows, None])
            r[self.block.comp[rows, None] == block.comp[columns]] = np.inf
            edge = np.partition(r, self.k - 1, axis=1)[:, self.k - 1] if len(columns) > self.k else np.full(len(rows), np.inf)
            i, j = np.nonzero((r <= edge[:, None] + SLACK) & np.isfinite(r))
            i, j = rows[i], columns[j]
            c = exact(self.block, block, i, j)
        r = np.maximum(np.maximum(1 - c, block.core[j]), self.block.core[i])
        real = (self.block.comp[i] != block.comp[j]) & (r <= self.reach[i, -1])
        i, j, r = i[real], j[real], r[real]
        if not len(i):
            return
        rows = np.unique(i)
        old = lambda x: x[rows].ravel()
        i, r, q, other = np.r_[np.repeat(rows, self.k), i], np.r_[old(self.reach), r], np.r_[old(self.q), block.p[j]], np.r_[old(self.other), block.comp[j]]
        order = np.lexsort((q, r, i))
        order = order[np.searchsorted(i[order], rows)[:, None] + np.arange(self.k)]  # each row has k old cells at least
        self.reach[rows], self.q[rows], self.other[rows] = r[order], q[order], other[order]

    def finish(self) -> pa.RecordBatch:
        real = np.isfinite(self.reach)
        i, rank = np.nonzero(real)
        cols = [self.block.p[i], self.block.comp[i], rank.astype(np.int32), self.reach[real], self.q[real], self.other[real], self.reach[i, -1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["p", "comp", "rank", "reach", "q", "other", "bound"])
