"""A data source for .npy matrices: the header is read once, ranges of rows are the partitions.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("path", vectors).option("ids", names).load()

Files may lie wherever pyarrow's file systems reach. Only as much as the ranges hold is read, some thousand rows at a time.
"""

from __future__ import annotations

import ast

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

STEP = 4 << 20  # bytes read at once


class Matrix:
    """A .npy file of one or two dimensions in C order: dtype, shape, and its rows."""

    def __init__(self, path: str):
        self.path = path
        with self.open() as f:
            if f.read(6) != b"\x93NUMPY":
                raise ValueError(f"{path} is no .npy file")
            major = f.read(2)[0]
            size = int.from_bytes(f.read(2 if major == 1 else 4), "little")
            head = ast.literal_eval(f.read(size).decode("latin1"))
            self.begin = f.tell()
        self.dtype, self.shape = np.dtype(head["descr"]), head["shape"]
        if self.dtype.hasobject or head["fortran_order"] and len(self.shape) > 1 or not 1 <= len(self.shape) <= 2:
            raise ValueError(f"{path}: only plain matrices and lists in row order are read")
        self.width = self.shape[1] if len(self.shape) == 2 else 1

    def open(self):
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system.open_input_file(path)

    def rows(self, first: int, last: int) -> np.ndarray:
        size = self.dtype.itemsize * self.width
        with self.open() as f:
            f.seek(self.begin + first * size)
            return np.frombuffer(f.read((last - first) * size), self.dtype).reshape(-1, self.width)


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class NpySource(DataSource):
    """Columns: id (string; the row's number where no ids are given) and embedding (array<float>, or array<double> for
    numbers of 8 bytes). Options: path, ids (a .npy list of the same length, of text or numbers), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        wide = Matrix(self.options["path"]).dtype.itemsize > 4
        return f"id string, embedding array<{'double' if wide else 'float'}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ids = options["path"], options.get("ids")
        matrix = Matrix(self.path)
        if self.ids and (n := Matrix(self.ids).shape[0]) != matrix.shape[0]:
            raise ValueError(f"{matrix.shape[0]} vectors for {n} ids")
        self.n = matrix.shape[0]
        self.each = int(options.get("rows") or max(1, (64 << 20) // max(1, matrix.dtype.itemsize * matrix.width)))

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.each, self.n)) for a in range(0, self.n, self.each)] or [Rows(0, 0)]

    def read(self, partition: Rows):
        matrix, names = Matrix(self.path), Matrix(self.ids) if self.ids else None
        step = max(1, STEP // max(1, matrix.dtype.itemsize * matrix.width))
        kind = np.float64 if matrix.dtype.itemsize > 4 else np.float32
        for a in range(partition.first, partition.last, step):
            z = min(a + step, partition.last)
            x = np.ascontiguousarray(matrix.rows(a, z), kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * matrix.width, pa.int32()), pa.array(x.ravel()))
            ids = names.rows(a, z)[:, 0].astype(str) if names else np.arange(a, z).astype(str)
            yield pa.RecordBatch.from_arrays([pa.array(ids.tolist(), pa.string()), lists], names=["id", "embedding"])
