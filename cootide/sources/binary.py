"""Binary tensors: a header and one array per mode, then the values; read in parallel by ranges of nonzeros.

Layout (fixed by the format, native byte order, no padding): int32 magic 0; uint64 bytes of an index; uint64 bytes of a
value; number of modes, dims and number of nonzeros as indices; all indices of mode 0, of mode 1, ...; all values.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cootide.core import MAX_MODES, SparseTensor, TensorError

HEAD = struct.Struct("=iQQ")
NONZEROS_PER_TASK = 4_000_000
BATCH = 1 << 16


@dataclass
class Header:
    index_bytes: int
    value_bytes: int
    dims: list[int]
    nnz: int
    start: int  # of the first index array

    @property
    def index_type(self) -> np.dtype:
        return np.dtype(f"u{self.index_bytes}")

    @property
    def value_type(self) -> np.dtype:
        return np.dtype(f"f{self.value_bytes}")


def read_header(path: str, max_modes: int = MAX_MODES) -> Header:
    """The checked header of a file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEAD.size)
        if len(head) < HEAD.size:
            raise TensorError(f"{path} is too short for a binary tensor")
        magic, ib, vb = HEAD.unpack(head)
        if magic != 0 or ib not in (4, 8) or vb not in (4, 8):
            raise TensorError(f"{path} is no binary tensor")
        one = lambda n: np.frombuffer(f.read(ib * n), np.dtype(f"u{ib}"))
        n = int(one(1)[0])
        if not 1 <= n <= max_modes:
            raise TensorError(f"{path} has {n} modes; 1 to {max_modes} are supported")
        dims, nnz = [int(d) for d in one(n)], int(one(1)[0])
        out = Header(ib, vb, dims, nnz, f.tell())
    if size != out.start + nnz * (n * ib + vb):
        raise TensorError(f"{path} has {size} bytes, not what its header says")
    return out


class NonzeroRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BinaryTensorReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[NonzeroRange]:
        nnz = read_header(self.path).nnz
        return [NonzeroRange(a, min(nnz, a + self.per_task)) for a in range(0, nnz, self.per_task)] or [NonzeroRange(0, 0)]

    def read(self, partition: NonzeroRange) -> Iterator[pa.RecordBatch]:
        h = read_header(self.path)
        names = [*[f"i{m}" for m in range(len(h.dims))], "val"]
        values_at = h.start + h.nnz * h.index_bytes * len(h.dims)
        with open(self.path, "rb") as f:
            for a in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                columns = []
                for m in range(len(h.dims)):
                    f.seek(h.start + (m * h.nnz + a) * h.index_bytes)
                    columns.append(pa.array(np.fromfile(f, h.index_type, n).astype(np.int64)))
                f.seek(values_at + a * h.value_bytes)
                columns.append(pa.array(np.fromfile(f, h.value_type, n).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(columns, names)


class BinaryTensorSource(DataSource):
    """``spark.read.format("binary_tensor").load(path)`` once registered; option ``nonzerosPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "binary_tensor"

    def schema(self) -> StructType:
        n = len(read_header(self.options["path"]).dims)
        return StructType([*[StructField(f"i{m}", LongType()) for m in range(n)], StructField("val", DoubleType())])

    def reader(self, schema: StructType) -> BinaryTensorReader:
        return BinaryTensorReader(self.options["path"], int(self.options.get("nonzerosPerTask", NONZEROS_PER_TASK)))


def read_binary(spark: SparkSession, path: str, *, nonzeros_per_task: int = NONZEROS_PER_TASK) -> SparseTensor:
    """Read a file that every executor can open at ``path``; dims come from its header, indices are 0-based."""
    h = read_header(path)
    spark.dataSource.register(BinaryTensorSource)
    df = spark.read.format("binary_tensor").option("nonzerosPerTask", str(nonzeros_per_task)).load(path)
    return SparseTensor(df, h.dims)


def _widths(tensor: SparseTensor) -> tuple[int, int, int]:
    """(nnz, index bytes, value bytes): 4-byte indices if nnz and dims allow, 4-byte values if every value is exact."""
    exact = (F.col("val").cast("float").cast("double") == F.col("val")) | F.isnan("val")
    r = tensor.df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(exact).alias("exact")).first()
    narrow = r["n"] < 1 << 32 and max(tensor.dims) <= (1 << 32) - 1
    return r["n"], 4 if narrow else 8, 4 if r["exact"] in (True, None) else 8


def write_binary(tensor: SparseTensor, path: str) -> None:
    """One file in coordinate order. Rows stream through the driver by partition and go to their places in the file, so
    neither side holds the tensor; beyond one file's size use Parquet."""
    nnz, ib, vb = _widths(tensor)
    h = Header(ib, vb, tensor.dims, nnz, 0)
    with open(path, "wb") as f:
        f.write(HEAD.pack(0, ib, vb))
        np.array([tensor.nmodes, *tensor.dims, nnz], h.index_type).tofile(f)
        start = f.tell()
        f.truncate(start + nnz * (ib * tensor.nmodes + vb))
        at, held = 0, []

        def flush() -> None:
            nonlocal at
            for m in range(tensor.nmodes):
                f.seek(start + (m * nnz + at) * ib)
                np.array([r[m] for r in held], np.int64).astype(h.index_type).tofile(f)
            f.seek(start + nnz * ib * tensor.nmodes + at * vb)
            np.array([r[-1] for r in held], np.float64).astype(h.value_type).tofile(f)
            at += len(held)
            held.clear()

        for r in tensor.sorted(0).toLocalIterator(prefetchPartitions=True):
            held.append(tuple(r))
            if len(held) == BATCH:
                flush()
        flush()


def write_binary_parts(tensor: SparseTensor, folder: str) -> DataFrame:
    """One binary file per partition in a folder that all executors reach under this path, each written by its task.

    Gives path and nnz of the files that hold nonzeros. Within a file nonzeros stand as the partition has them; a task
    holds its own partition. A task that runs again writes its file again.
    """
    _, ib, vb = _widths(tensor)
    dims, names, head = list(tensor.dims), [*tensor.modes, "val"], HEAD.pack(0, ib, vb)

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.bin"
        h = Header(ib, vb, dims, t.num_rows, 0)
        with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            f.write(head)
            np.array([len(dims), *dims, t.num_rows], h.index_type).tofile(f)
            for c in names[:-1]:
                t[c].to_numpy().astype(h.index_type).tofile(f)
            t["val"].to_numpy().astype(h.value_type).tofile(f)
        os.replace(f.name, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([t.num_rows])], ["path", "nnz"])

    files = tensor.df.select(*names).mapInArrow(run, "path string, nnz bigint").collect()  # a row per partition
    return tensor.df.sparkSession.createDataFrame(sorted(map(tuple, files)), "path string, nnz bigint")


def binary_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Nonzeros of several binary files with equal modes."""
    out = None
    for p in paths:
        x = read_binary(spark, p).df
        out = x if out is None else out.unionByName(x)
    return out
