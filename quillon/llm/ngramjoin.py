"""Set-similarity join on word shingles with prefix filters under several global token orders.

1. Features. One scan gives each document's set size and 128-bit set signature, and a count sketch of all
   shingles. Documents of equal sets are one class.
2. Orders. Three global orders put shingles that are frequent in the sketch last and order the rest by
   differently seeded hashes. Linked sets share a shingle in their prefixes under each order.
3. Prefix shingles that only one document has cannot be shared: once/twice Bloom filters of each order,
   built over the prefixes of all documents, drop them before anything is shuffled.
4. Postings of the first order are narrow rows (shingle, class number, length, position). Those of shingles
   that one class alone has are dropped exactly, and those without a partner that meets the length and
   position bounds.
5. First round: a sample of the shingles (all those of short documents), in tiles of at most TILE members,
   gives each member at most two candidates a shingle. A candidate must meet the bounds, share prefix bits under
   the other orders and keep its difference bound on parity bitmaps of the whole sets, whose size follows the
   sets'. Candidates are verified on the whole sets; links make components.
6. Further rounds take the shingles that several components have. Members of one component are never
   compared again, and a tile that one component fills is not paired with itself. A member has at most so many
   candidates of other components a shingle, one each way at first, as links make few components of many; shingles
   where one had more are looked at again with four times as many allowed, until none has. So no link between components is lost, and a group of copies gives rows in proportion.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bloom import Blocked, OnceTwice, might_hold
from quillon.llm.common import lean, release, slices, stash, table, text_bytes, unstash
from quillon.llm.components import components
from quillon.llm.kernels import mix, ragged, shingles

WIDTH, ORDERS, TILE = 5, 3, 1024
FIRST_SHARE, FIRST_SHORT = 8, 64  # the first round takes one shingle of so many; all of sets so small
PARTNERS = 1  # later and earlier candidates of other components that a member may have a shingle in the second round; most meet in many shingles
SKETCH, FILTER_BITS, FILTER_K = 1 << 20, 27, 2
HOT = 8  # a shingle is frequent from so many times the sketch's mean on
SEEDS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
PARITY, FINE = 256, 1 << 16  # least bits of a coarse parity bitmap, most of a fine one


def sets_of(batches):
    """(ids, rows, sets) of Arrow batches of (id, text); sets come as sorted hashes."""
    for b in batches:
        data, off = text_bytes(b.column(1))
        for a, z in slices(off):
            yield b.column(0).slice(a, z - a), list(shingles(data[off[a] : off[z]], off[a : z + 1] - off[a], WIDTH))


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def orders(s: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
    """The prefix of a set under each order, in that order: n - ceil(0.8 n) + 1 shingles."""
    n = len(s)
    size = n - (4 * n + 4) // 5 + 1
    rate = sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    level = np.where(rate >= HOT, np.log2(np.maximum(rate, 1)) + 1, 0).astype(np.uint64) << np.uint64(58) if n and rate.max() >= HOT else np.uint64(0)
    return [s[_lowest((mix(s ^ seed) >> np.uint64(6)) | level, size)] for seed in SEEDS[:ORDERS]]


def _lowest(key: np.ndarray, size: int) -> np.ndarray:
    at = np.argpartition(key, size - 1)[:size] if size < len(key) else np.arange(len(key))
    return at[np.argsort(key[at])]


def _bitmap(tokens: np.ndarray, bits: int) -> bytes:
    at = ((tokens * SEEDS[0]) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) > 0).tobytes()


def _parity(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(coarse, fine) parity bitmaps of a set: from 0.6 and 4 bits a shingle on. One folded by XOR is a smaller one."""
    n = len(s)
    coarse = max(PARITY, 1 << int(0.6 * n).bit_length())
    bits = max(coarse, min(FINE, 1 << (4 * n - 1).bit_length()))
    at = ((s * SEEDS[0]) >> np.uint64(32)).astype(np.int64) & (bits - 1)
    fine = np.packbits(np.bincount(at, minlength=bits) & 1)
    return np.bitwise_xor.reduce(fine.reshape(-1, coarse // 8)), fine.tobytes()


def _differ(data: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of the rows x and y differ, the longer one folded to the other's size. data: all
    bitmaps as 8-byte words, off: their bounds."""
    size = np.diff(off)
    width, out = np.minimum(size[x], size[y]), np.zeros(len(x), np.int64)
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        for k in range(0, len(some), max(1, (1 << 20) // w)):
            at = some[k : k + max(1, (1 << 20) // w)]
            out[at] = np.bitwise_count(_folded(data, off, size, x[at], w) ^ _folded(data, off, size, y[at], w)).sum(1, dtype=np.int64)
    return out


def _folded(data, off, size, at, width):
    out = data[off[at][:, None] + np.arange(width)]
    for k in range(width, int(size[at].max()), width):
        some = np.flatnonzero(size[at] > k)
        out[some] ^= data[(off[at[some]] + k)[:, None] + np.arange(width)]
    return out


def _words8(column) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_bytes(column)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64), (off - off[0]) >> 3


def _scan(docs, id_col, text_col):
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _features(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n int, sig binary, part int, counts binary"
    step = SKETCH // 16

    def run(batches):
        sketch, kind_ = np.zeros(SKETCH, np.uint32), None
        for ids, sets in sets_of(batches):
            kind_ = ids.type
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            sketch += np.bincount((flat & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=["id", "n", "sig", "part", "counts"])
        if kind_ is not None:
            parts = [zlib.compress(sketch[i * step : (i + 1) * step], 1) for i in range(16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(16, kind_), pa.nulls(16, pa.int32()), pa.nulls(16, pa.binary()), pa.array(range(16), pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "sig", "part", "counts"])

    return stash(rows.mapInArrow(lean(run), schema), "sets")


def _sketch(features: DataFrame) -> np.ndarray:
    """Counts of all tasks together, as multiples of their mean (2**20 numbers at any input size)."""

    def fold(batches):
        now, total = None, None
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
                if part != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])
                now, total = part, counts if part != now else total + counts
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    got = features.where("part IS NOT NULL").select("part", "counts").repartition(16, "part").sortWithinPartitions("part").mapInArrow(lean(fold), "part int, counts binary").toArrow()
    out, step = np.zeros(SKETCH), SKETCH // 16
    for part, counts in zip(got["part"].to_pylist(), got["counts"].to_pylist()):
        out[part * step : (part + 1) * step] = np.frombuffer(counts, np.int64)
    return (out / max(out.mean(), 1.0)).astype(np.float32)


def _prefixes(rows: DataFrame, classes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """One row a class: its number c, sig, rep, n, the first order's prefix shingles that another document may have with their
    positions, and the bitmaps that the pair filters use."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(sketch)
    filters = OnceTwice(FILTER_BITS, FILTER_K)

    def build(batches):
        states = [filters.start() for _ in range(ORDERS)]
        for _, sets in sets_of(batches):
            found = [orders(s, shared.value) for s in sets if len(s)]
            for k in range(ORDERS if found else 0):
                filters.add(states[k], np.concatenate([f[k] for f in found]))
        for k, state in enumerate(states):
            for b in filters.rows(state):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *b.columns], names=["o", "part", "once", "twice"])

    partials = stash(rows.mapInArrow(lean(build), "o int, part int, once binary, twice binary"), "prefix-filters")
    twice = spark.sparkContext.broadcast([filters.merge(partials.where(F.col("o") == k).drop("o")) for k in range(ORDERS)])
    unstash(partials)
    release()

    def run(batches):
        for _, sets in sets_of(batches):
            out = []
            for s in sets:
                if not len(s):
                    continue
                found = orders(s, shared.value)
                may = [filters.hits(twice.value[k], found[k]) for k in range(ORDERS)]
                if all(m.any() for m in may):
                    at = np.flatnonzero(may[0])
                    coarse, fine = _parity(s)
                    bits = b"".join(_bitmap(found[k][may[k]], 128) for k in range(1, ORDERS)) + coarse.tobytes()
                    out.append((signature(s), len(s), found[0][at].view(np.int64), at.astype(np.int32), bits, fine))
            if out:
                sig, n, tokens, at, bits, fine = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())], names=["sig", "n", "tokens", "at", "bits", "fine"])

    found = rows.mapInArrow(lean(run), "sig binary, n int, tokens array<long>, at array<int>, bits binary, fine binary").dropDuplicates(["sig"])
    found = found.join(classes, "sig").withColumn("c", F.monotonically_increasing_id())  # fixed once it is written
    out = stash(found, "prefixes")
    shared.unpersist()
    twice.unpersist()
    return out


def _bounded(n, pos, x, y) -> np.ndarray:
    """May the sets x and y, whose shared shingle stands at these positions, be similar by length and position?"""
    nx, ny = n[x], n[y]
    return (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (9 * np.minimum(nx - pos[x], ny - pos[y]) >= 4 * (nx + ny))


def _pairs(first: np.ndarray, size: np.ndarray, most: int = 100_000):
    """All pairs (x < y) of rows within units, in parts; first, size: where each unit's rows are."""
    at = ragged(first, size)
    later = np.repeat(first + size, size) - at - 1
    for a, b in _runs(later, most):
        yield np.repeat(at[a:b], later[a:b]), ragged(at[a:b] + 1, later[a:b])


def _by_unit(batches, keys: list[str], emit):
    """emit(table, starts of its units) of batches sorted by `keys`; no unit is parted."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = np.stack([t[c].to_numpy() for c in keys], 1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        rest = t.slice(int(starts[-1]))
        if len(starts) > 1:
            yield from emit(t.slice(0, int(starts[-1])), starts[:-1])
    if rest is not None and rest.num_rows:
        yield from emit(rest, np.array([0]))


def _postings(prefixes: DataFrame) -> DataFrame:
    """The postings (token, c, n, pos, and m, the members of its group) of shingles that several classes have, without
    those that have no partner by length and position; in groups of more than TILE members all stay."""
    p = prefixes.select("c", "n", F.explode(F.arrays_zip("tokens", "at")).alias("p")).select("c", "n", F.col("p.tokens").alias("token"), F.col("p.at").alias("pos"))
    groups = p.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    p = p.join(groups, "token").select("token", F.expr(f"IF(m > {TILE}, pmod(xxhash64(c), CAST(ceil(m / {TILE}) AS INT)), 0)").alias("salt"), "c", "n", "pos", "m")

    def emit(t, starts):
        n, pos = (t[x].to_numpy().astype(np.int64) for x in ("n", "pos"))
        some = t["m"].to_numpy() > TILE
        size = np.where(some[starts], 0, np.diff(np.r_[starts, t.num_rows]))
        for x, y in _pairs(starts, size):
            ok = _bounded(n, pos, x, y)
            some[x[ok]] = some[y[ok]] = True
        yield from t.select(["token", "c", "n", "pos", "m"]).filter(pa.array(some)).combine_chunks().to_batches()

    dealt = p.repartition("token", "salt").sortWithinPartitions("token", "salt")  # large groups are spread
    return stash(dealt.mapInArrow(lean(lambda batches: _by_unit(batches, ["token", "salt"], emit)), "token long, c long, n int, pos int, m long"), "postings")


def _live(prefixes: DataFrame, postings: DataFrame) -> DataFrame:
    """The classes that have postings, without their shingles. A Bloom filter of their numbers picks them
    where they are; a false hit only keeps a class that nothing refers to."""
    probe = might_hold(prefixes.sparkSession, Blocked.build(postings.select(F.xxhash64("c").alias("h")).distinct(), "h"))
    return stash(prefixes.drop("tokens", "at").where(probe(F.xxhash64("c"))), "live")


def _first_units(postings: DataFrame) -> DataFrame:
    """The first round's units: a sample of the shingles, each member in one tile only."""
    p = postings.drop("m").where((F.col("n") < FIRST_SHORT) | (F.expr(f"pmod(xxhash64(token), {FIRST_SHARE})") == 0))
    tiles = p.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token", F.ceil(F.col("m") / TILE).alias("tiles"))
    lo = F.expr("pmod(xxhash64(c, token), tiles)")
    return p.join(tiles, "token").select("token", lo.alias("lo"), lo.alias("hi"), "c", "n", "pos", F.col("c").alias("comp"))


def _later_units(postings: DataFrame, comps: DataFrame, large_groups: bool) -> DataFrame:
    """Units of the shingles that several components have. Small groups are one unit. In others, a component of
    more than TILE members has tiles of its own, the rest share tiles; each pair of tiles is a unit, but for those of
    one component. comps: c, comp of the classes that are linked; others are components of their own. large_groups: are
    there groups of more than TILE members?"""
    p = postings.drop("m").join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    parts = p.groupBy("token", "comp").agg(F.count("*").alias("k"))
    groups = parts.groupBy("token").agg(F.sum("k").alias("m"), F.count("*").alias("parts"), F.sum(F.when(F.col("k") <= TILE, F.col("k")).otherwise(0)).alias("rest")).where("parts > 1")
    usual = p.join(groups.where(F.col("m") <= TILE).select("token"), "token").select("token", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "c", "n", "pos", "comp")
    if not large_groups:
        return usual
    large = parts.join(groups.where(F.col("m") > TILE).select("token", "rest"), "token")
    count = F.ceil(F.when(F.col("k") > TILE, F.col("k")).otherwise(F.col("rest")) / TILE)
    large = large.select("token", "comp", F.when(F.col("k") > TILE, F.col("comp")).alias("own"), count.alias("tiles"))
    # a tile is a number that follows from its owner and its place; equal numbers by chance would only join two tiles
    every = large.select("token", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("i")).distinct()
    every = every.groupBy("token").agg(F.collect_list(F.struct("own", F.xxhash64(F.coalesce("own", F.lit(-1)), "i").alias("tile"))).alias("all"))  # m / TILE entries
    mine = F.xxhash64(F.coalesce("own", F.lit(-1)), F.expr("pmod(xxhash64(c), tiles)")).alias("mine")
    dealt = p.join(large, ["token", "comp"]).select("token", "c", "n", "pos", "comp", "own", mine).join(every, "token")
    dealt = dealt.withColumn("other", F.explode(F.expr("transform(filter(all, t -> own IS NULL OR NOT t.own <=> own), t -> t.tile)")))
    return usual.unionByName(dealt.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "c", "n", "pos", "comp"))


def _candidates(units: DataFrame, live: DataFrame, partners: int | None = None) -> DataFrame:
    """Pairs a < b that pass all filters. Without `partners` each member gets at most two; else at most that many
    later and as many earlier members of other components, and a shingle where there are more is a row (-1, token)."""

    def emit(t, starts):
        size = np.diff(np.r_[starts, t.num_rows])
        raw, off = text_bytes(t["bits"])
        fixed = 16 * (ORDERS - 1)
        heads = raw[off[:-1, None] + np.arange(fixed)].view(np.uint64).reshape(t.num_rows, -1)
        rest = ragged(off[:-1] + fixed, np.diff(off) - fixed)
        words, bounds = raw[rest].view(np.uint64), np.r_[0, np.cumsum(np.diff(off) - fixed)] >> 3
        c, n, pos, comp = (t[x].to_numpy().astype(np.int64) for x in ("c", "n", "pos", "comp"))
        token = t["token"].to_numpy()
        seen = [np.zeros((0, 2), np.int64)]
        for x, y in _pairs(starts, size):
            ok = _bounded(n, pos, x, y) & (comp[x] != comp[y])
            x, y = x[ok], y[ok]
            for k in range(ORDERS - 1):
                ok = (heads[x, 2 * k : 2 * k + 2] & heads[y, 2 * k : 2 * k + 2]).any(1)
                x, y = x[ok], y[ok]
            ok = 9 * _differ(words, bounds, x, y) <= n[x] + n[y]
            x, y = x[ok], y[ok]
            if len(x):
                # x is in order; rows of a unit stand in order of c, so units agree on whom a member meets first
                by_y = np.lexsort((x, y))
                ahead, back = _place(x), np.zeros(len(x), np.int64)
                back[by_y] = _place(y[by_y])
                if partners is None:
                    last = np.r_[x[1:] != x[:-1], True]
                    pick = last | (back == 0)
                else:
                    pick = (ahead < partners) | (back < partners)
                    full = np.unique(token[x[~pick]])
                    seen.append(np.stack([np.full(len(full), -1), full], 1))
                x, y = x[pick], y[pick]
            pairs = np.sort(np.stack([c[x], c[y]], 1), 1)
            seen.append(np.unique(pairs, axis=0))
        pairs = np.unique(np.concatenate(seen), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = ["token", "lo", "hi"]
    dealt = units.join(live.select("c", "bits"), "c").select(*keys, "c", "n", "pos", "comp", "bits").repartition(*keys).sortWithinPartitions(*keys, "c")
    return stash(dealt.mapInArrow(lean(lambda batches: _by_unit(batches, keys, emit)), "a long, b long").distinct(), "candidates")


def _place(x: np.ndarray) -> np.ndarray:
    """The place of each entry among its equals, which stand together."""
    if not len(x):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))


def _finer(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """The candidates whose difference bound also holds on the fine parity bitmaps."""

    def check(batches):
        for b in batches:
            (xs, x_at), (ys, y_at) = _words8(b.column("x")), _words8(b.column("y"))
            n, m = b.column("n").to_numpy().astype(np.int64), b.num_rows
            differ = _differ(np.r_[xs, ys], np.r_[x_at, y_at[1:] + x_at[-1]], np.arange(m), np.arange(m) + m) if m else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(9 * differ <= n))

    pairs = candidates.join(live.select(F.col("c").alias("a"), F.col("n").alias("k"), F.col("fine").alias("x")), "a")
    pairs = pairs.join(live.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("fine").alias("y")), "b")
    return pairs.select("a", "b", (F.col("k") + F.col("m")).alias("n"), "x", "y").mapInArrow(lean(check), "a long, b long")


def _runs(counts: np.ndarray, most: int):
    total, a = np.r_[0, np.cumsum(counts)], 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def _links(candidates: DataFrame, prefixes: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates whose whole sets are similar, as (u, v) of class representatives."""
    some = candidates.select(F.col("a").alias("c")).unionByName(candidates.select(F.col("b").alias("c"))).distinct()
    reps = stash(prefixes.select("c", "sig", "rep").join(some, "c").where("rep IS NOT NULL").select("c", "sig", F.col("rep").alias("id")), "verified")

    maybe = rows.sparkSession.sparkContext.broadcast(Blocked.build(reps.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches):
        some = (b.filter(pa.array(maybe.value.hits(b.column(2).to_numpy()))) for b in batches)
        for _, sets in sets_of(b for b in some if b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "whole"])

    found = rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(lean(run), "sig binary, whole binary").dropDuplicates(["sig"])
    whole = stash(found.join(reps.select("c", "sig"), "sig").select("c", "whole"), "whole-sets")
    maybe.unpersist()

    def check(batches):
        for b in batches:
            (xs, x_at), (ys, y_at) = (text_bytes(b.column(i)) for i in (2, 3))
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                both = np.sort(np.frombuffer(xs[x_at[i] : x_at[i + 1]].tobytes() + ys[y_at[i] : y_at[i + 1]].tobytes(), np.uint64))
                ok[i] = 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    pairs = candidates.join(whole.select(F.col("c").alias("a"), F.col("whole").alias("x")), "a").join(whole.select(F.col("c").alias("b"), F.col("whole").alias("y")), "b")
    good = pairs.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long")
    good = good.join(reps.select(F.col("c").alias("a"), F.col("id").alias("u")), "a").join(reps.select(F.col("c").alias("b"), F.col("id").alias("v")), "b")
    out = stash(good.select("u", "v"), "links")
    unstash(whole, reps)
    return out


def jaccard_components(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Components of documents that share at least 80 of 100 of their distinct five-word shingles.

    Result, one row per input row: id, n_shingles, component_id (smallest id reached by links, its own
    included). Words are runs without white space, A-Z lower-cased; with fewer than five words the whole
    sequence is the one shingle; a text without words, or null, has an empty set, is linked with nothing
    and is its own component. Rows with the same id are one node. A null id is linked with nothing, its
    component is null unless its set equals others'. An empty table gives no rows. Other columns are not
    read. Sets are compared by 64-bit hashes of their shingles.
    """
    rows = _scan(docs, id_col, text_col)
    features = _features(rows)
    docs_ = features.where("part IS NULL").select("id", "n", "sig")
    classes = stash(docs_.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep")), "classes")
    prefixes = _prefixes(rows, classes, _sketch(features))
    postings = _postings(prefixes)
    live = _live(prefixes, postings)
    unstash(prefixes)
    found = _candidates(_first_units(postings), live)
    fine = stash(_finer(found, live), "fine")
    tested = fine.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(fine.groupBy("a").agg(F.max("b").alias("b")))
    tested = [stash(tested.distinct(), "tested", 2 * fine.count())]  # two pairs a document at most
    unstash(found, fine)
    links = [_links(tested[0], live, rows)]
    near = components(links[0])
    partners, left, large_groups = PARTNERS, True, postings.where(F.col("m") > TILE).limit(1).count() > 0
    while left:
        comps = near.join(live.select(F.col("rep").alias("component"), F.col("c").alias("comp")), "component").select("node", "comp")
        comps = comps.join(live.select(F.col("rep").alias("node"), "c"), "node").select("c", "comp")
        found = _candidates(_later_units(postings, comps, large_groups), live, partners)
        rest = found.where("a >= 0")
        for pairs in tested:
            rest = rest.join(pairs, ["a", "b"], "left_anti")
        tested.append(stash(_finer(rest, live), "tested"))
        full = found.where("a < 0").select(F.col("b").alias("token"))
        left = full.limit(1).count()
        if left:  # only shingles where members had more partners are looked at again
            postings, old = stash(postings.join(full, "token", "left_semi"), "postings"), postings
            unstash(old)
        unstash(found)
        if tested[-1].limit(1).count():
            links.append(_links(tested[-1], live, rows))
            old, near = near, components(reduce(DataFrame.unionByName, links))
            unstash(old.kept)
        partners *= 4
    unstash(postings, *tested, *links)
    top = classes.join(near, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    unstash(live)
    full = docs_.where("n > 0").join(top, "sig").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = docs_.where("n = 0").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(none)


def op7_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT u AS doc_id, u AS other FROM l UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other),
m AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
}
