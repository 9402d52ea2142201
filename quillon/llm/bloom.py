"""Bloom filters over 64-bit hashes: a blocked one built by bit_or, and a pair for once and twice seen.

All sizes are parameters with upper bounds, so what is broadcast does not grow with the data; beyond the
capacity a filter only lets more false hits through, which the exact step behind it removes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean

MAX_BLOCKS = 1 << 18  # 512 bits each: 16 MB
WORDS = 8


class Blocked:
    """Blocked Bloom filter: a hash picks one block of 512 bits and one bit in each of its 8 words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(keys: int, most: int = MAX_BLOCKS) -> int:
        """Blocks, a power of two: 16 bits a key up to `most` blocks."""
        return min(most, max(16, 1 << int(max(keys, 1) * 16 // 512).bit_length()))

    @classmethod
    def build(cls, keys: DataFrame, column: str, most: int = MAX_BLOCKS) -> Blocked:
        """From the hashes (long) in a column; the executors join the masks of each block by bit_or."""
        blocks = cls.size(keys.count(), most)
        masks = [F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(`{column}`, {20 + 5 * i}) & 63 AS INT)))").alias(f"w{i}") for i in range(WORDS)]
        rows = keys.where(F.col(column).isNotNull()).groupBy(F.expr(f"`{column}` & {blocks - 1}").alias("block")).agg(*masks).toArrow()
        bits = np.zeros((blocks, WORDS), np.int64)
        bits[rows["block"].to_numpy()] = np.stack([rows[f"w{i}"].to_numpy() for i in range(WORDS)], axis=1) if rows.num_rows else 0
        return cls(bits.view(np.uint64))

    def hits(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64).view(np.uint64)
        block, found = (h & np.uint64(len(self.bits) - 1)).astype(np.int64), np.ones(len(h), bool)
        for i in range(WORDS):
            found &= (self.bits[block, i] >> ((h >> np.uint64(20 + 5 * i)) & np.uint64(63))) & np.uint64(1) == 1
        return found


def might_hold(spark, filter_: Blocked):
    """A column function: may the hash be in the filter? The filter is broadcast; its size is bounded."""
    shared = spark.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.hits(h.fillna(0).to_numpy())) & h.notna()

    return probe


def possible_rows(rows: DataFrame, key: str, keys: DataFrame, most: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key may be among `keys` (same column): an exact join must follow. Nulls in key stay."""
    tagged = keys.select(F.xxhash64(key).alias("h"))
    probe = might_hold(rows.sparkSession, Blocked.build(tagged, "h", most))
    return rows.where(probe(F.xxhash64(key)))


def drop_rows(rows: DataFrame, key: str, keys: DataFrame, most: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose key is not among `keys` (same column); only rows that may be are shuffled. Nulls stay."""
    probe = might_hold(rows.sparkSession, Blocked.build(keys.select(F.xxhash64(key).alias("h")), "h", most))
    marked = rows.withColumn("__maybe", probe(F.xxhash64(key)))
    some = marked.where("__maybe").join(keys.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")
    return marked.where("NOT __maybe").unionByName(some).drop("__maybe")


CHUNK = 1 << 17  # bytes of packed bits in a row of partial filters


def mark(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits at sorted distinct places."""
    if len(at):
        byte, bit = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
        starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bits[byte[starts]] |= np.bitwise_or.reduceat(bit, starts)


class OnceTwice:
    """Two Bloom filters of 2**log2 bits: bits set at least once, and bits set at least twice."""

    SCHEMA = "part int, once binary, twice binary"

    def __init__(self, log2: int, k: int):
        self.log2, self.k = log2, k

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        h = h.view(np.uint64)
        odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
        return [((h ^ (h >> np.uint64(31))) * np.uint64(odd[i]) >> np.uint64(64 - self.log2)).astype(np.int64) for i in range(self.k)]

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((1 << self.log2) // 8, np.uint8), np.zeros((1 << self.log2) // 8, np.uint8)

    def add(self, state: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> None:
        """Adds hashes, each once for every document that has it: a hash that comes again is a repeat."""
        once, twice = state
        for at in self.places(h):
            at = np.sort(at)
            again = at[1:] == at[:-1]
            fresh = at[np.r_[True, ~again]] if len(at) else at
            mark(twice, np.unique(at[1:][again]))
            mark(twice, fresh[(once[fresh >> 3] >> (fresh & 7).astype(np.uint8)) & 1 == 1])
            mark(once, fresh)

    def rows(self, state: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """One task's filters, in compressed parts; empty parts are left out."""
        once, twice = state
        step = min(CHUNK, len(once))
        for part in range(len(once) // step):
            one, two = (x[part * step : (part + 1) * step] for x in (once, twice))
            if one.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(one, 1)], pa.binary()), pa.array([zlib.compress(two, 1)], pa.binary())], names=["part", "once", "twice"])

    def merge(self, partials: DataFrame) -> np.ndarray:
        """The packed twice-seen bits of all tasks together; collected, 2**log2 / 8 bytes at most."""

        def fold(batches):
            now, once, twice = None, None, None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["part", "twice"])
            for b in batches:
                for part, one, two in zip(*(b.column(i).to_pylist() for i in range(3))):
                    one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (one, two))
                    if part != now:
                        if now is not None:
                            yield row()
                        now, once, twice = part, one.copy(), two.copy()
                    else:
                        twice |= two | (once & one)
                        once |= one
            if now is not None:
                yield row()

        step = min(CHUNK, (1 << self.log2) // 8)
        bits = np.zeros((1 << self.log2) // 8, np.uint8)
        parts = max(1, min(64, len(bits) // step))
        merged = partials.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(fold), "part int, twice binary").toArrow()
        for part, two in zip(merged["part"].to_pylist(), merged["twice"].to_pylist()):
            bits[part * step : (part + 1) * step] = np.frombuffer(two, np.uint8)
        return bits

    def hits(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which hashes may have been seen twice."""
        found = np.ones(len(h), bool)
        for at in self.places(h):
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found
