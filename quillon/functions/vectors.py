"""Column builders for dense vectors (array<float>), all in double precision, and grouped vector sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Numbers that a task holds at most before it hands its sums on.
FLUSH = 1 << 22


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; the zero vector stays as it is."""
    n = norm(a)
    once = F.array(F.when(n == 0, F.lit(1.0)).otherwise(n))  # inside the inner lambda it would be worked out for each component
    return F.transform(once, lambda m: F.transform(a, lambda x: x / m))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector has cosine 0 with everything; null with null."""
    n = norm(a) * norm(b)
    return 1.0 - dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def long_form(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(doubles(vector)).alias("pos", "x"))


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str = "embedding", normalise: bool = False) -> DataFrame:
    """Component-wise sums by keys: keys, n (rows), own (the sum of the rows' squared norms), total (array<double>).

    Tasks add up their rows first and hand on one array a key (and flush beyond FLUSH numbers, however many keys they
    meet), so what is shuffled follows the keys, not the rows. normalise: of unit vectors; a zero vector stays zero and
    adds nothing to own. Null vectors are left out; vectors of different lengths are an error;
    no vectors give no rows."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join(x for x in (fields, "n long, own double, x array<double>") if x)

    def partial(batches):
        number: dict = {}
        n = own = total = None
        types: list = []

        def flush():
            m = len(number)
            cols = list(zip(*number)) if keys else []
            cells = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * total.shape[1], pa.int32()), pa.array(total[:m].ravel()))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(n[:m]), pa.array(own[:m]), cells], names=[*keys, "n", "own", "x"])

        for b in batches:
            if not b.num_rows:
                continue
            types = types or [b.schema.field(i).type for i in range(len(keys))]
            lists = b.column(len(keys))
            d = len(lists[0])
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) != d * len(lists) or (total is not None and total.shape[1] != d):
                raise ValueError("vectors of different lengths")
            x = x.reshape(len(lists), d)
            if normalise:
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size == 0, 1, size)
            if total is None:
                n, own, total = np.zeros(16, np.int64), np.zeros(16), np.zeros((16, d))
            found = zip(*(b.column(i).to_pylist() for i in range(len(keys)))) if keys else iter([()] * len(lists))
            code = np.fromiter((number.setdefault(k, len(number)) for k in found), np.int64, len(lists))
            while len(number) > len(n):
                n, own, total = np.r_[n, n * 0], np.r_[own, own * 0], np.r_[total, total * 0]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            at = code[order][first]
            n[at] += np.diff(np.r_[first, len(code)])
            own[at] += np.add.reduceat((x * x).sum(1)[order], first)
            total[at] += np.add.reduceat(x[order], first, axis=0)
            if len(number) * d > FLUSH:
                yield flush()
                number.clear()
                n[:], own[:], total[:] = 0, 0, 0
        if number:
            yield flush()

    parts = df.where(F.col(vector).isNotNull()).select(*keys, doubles(vector).alias("x")).mapInArrow(partial, schema)
    by_pos = parts.select(*keys, "n", "own", F.posexplode("x").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"), F.sum("own").alias("own"))
    grouped = by_pos.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("cells"), F.max("n").alias("n"), F.max("own").alias("own"))
    return grouped.where("n IS NOT NULL").select(*keys, "n", "own", F.transform("cells", lambda c: c["s"]).alias("total"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str = "embedding", out: str = "centroid") -> DataFrame:
    """Component-wise mean by keys with the group's size `n`."""
    return vector_sums(df, keys, vector).select(*keys, "n", F.transform("total", lambda x: x / F.col("n")).alias(out))


def unit_sums(df: DataFrame, keys: Sequence[str], vector: str = "embedding", out: str = "total") -> DataFrame:
    """Sum of unit vectors by keys with `n` and `own`, the number of vectors that are not zero: the sum of cosines of a
    group's ordered pairs is |total|^2 - own, as a zero vector has cosine 0 even with itself."""
    s = vector_sums(df, keys, vector, normalise=True)
    return s.select(*keys, "n", F.round("own").alias("own"), F.col("total").alias(out))


def gram(df: DataFrame, key: str | None = None, vector: str = "embedding", normalise: bool = False) -> DataFrame:
    """n, sums and Gram matrix (row-major) of each key: one d x d block a task and key, then a sum by matrix row.

    Columns: key (string), n, s array<double>, g array<double>. Whatever the rows, tasks hand on d*d numbers a key.
    """
    source = df.select((F.col(key).cast("string") if key else F.lit("")).alias("key"), doubles(vector).alias("v"))

    def partial(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.array(b.column(0).to_pylist(), object)
            x = np.array(b.column(1).to_pylist(), np.float64)
            if normalise:
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size == 0, 1, size)
            for k in set(keys):
                part = x[keys == k]
                n, s, g = sums.get(k, (0, 0, 0))
                sums[k] = (n + len(part), s + part.sum(0), g + part.T @ part)
        for k, (n, s, g) in sums.items():  # row -1 has the sums, the others a row of the matrix each
            rows = [s, *g]
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k] * m), pa.array(range(-1, m - 1), pa.int32()), pa.array([n] * m, pa.int64()), pa.array([r.tolist() for r in rows])], names=["key", "row", "n", "x"])

    parts = source.mapInArrow(partial, "key string, row int, n long, x array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    add = F.expr("aggregate(collect_list(x), CAST(array() AS array<double>), (a, b) -> IF(size(a) = 0, b, zip_with(a, b, (p, q) -> p + q)))").alias("x")
    # rows are added up in two steps, so a task holds a 64th of all tasks' rows at a time, not whole matrices
    some = parts.groupBy("key", "row", "salt").agg(F.sum("n").alias("n"), add).groupBy("key", "row").agg(F.sum("n").alias("n"), add)
    cells = F.array_sort(F.collect_list(F.struct("row", "x")))
    whole = some.groupBy("key").agg(F.max("n").alias("n"), cells.alias("rows"))
    return whole.select("key", "n", F.col("rows")[0]["x"].alias("s"), F.flatten(F.transform(F.slice("rows", 2, F.size("rows") - 1), lambda r: r["x"])).alias("g"))
