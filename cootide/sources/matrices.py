"""Text forms of matrices, vectors, sparse matrices, partitions, permutations, index maps, graphs and hypergraphs.

Single files are written by the driver from ordered streams of rows, to any place the Hadoop file system reaches; nothing
is collected whole, not even a line: the words of a hot row arrive in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cootide.core import SparseTensor, TensorError
from cootide.operators import graphs, structure

CHUNK = 1 << 20
LARGE_GAP = 1 << 10  # lines


class _Sink:
    """Text in chunks to a Hadoop output stream."""

    def __init__(self, out):
        self.out, self.held, self.size = out, [], 0

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write("".join(self.held).encode())
        self.held, self.size = [], 0


@contextmanager
def text_sink(spark: SparkSession, path: str) -> Iterator:
    """Something to write text to: a local file, or where the path has a scheme a file of that file system."""
    if "://" not in path:
        with open(path, "w") as f:
            yield f
        return
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    sink = _Sink(out)
    try:
        yield sink
        sink.flush()
    finally:
        out.close()


def _write(rows: DataFrame, column: str, path: str, head: list[str] = ()) -> None:
    with text_sink(rows.sparkSession, path) as f:
        for line in head:
            f.write(line + "\n")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write(r[column] + "\n")


def _blank_lines(f, n: int) -> None:
    while n > 0:
        f.write("\n" * min(n, CHUNK))
        n -= CHUNK


def _joined(words: DataFrame, order: list[str], keys: list[str], word: Column, numbered: bool) -> DataFrame:
    """first, last, text: words in the order of ``order``, those of a batch as one text, with the first and last values of
    ``keys`` there. Words of equal keys share a line; with ``numbered`` the only key is the number of the line.

    Words are made after the sort, which so moves numbers only. A gap of many lines begins a new text.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(i).to_numpy() for i in range(len(keys))])
            step = np.diff(k, axis=1)
            gap = np.concatenate([[0], step[0] if numbered else (step != 0).any(axis=0)]).astype(np.int64)
            cuts = np.flatnonzero(gap > LARGE_GAP)
            gap[cuts] = 0
            text = pc.binary_join_element_wise(pc.binary_repeat("\n", pa.array(gap)), b.column(len(keys)), "")
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), text[a:z]), "")
                yield pa.RecordBatch.from_arrays([pa.array([k[:, a].tolist()]), pa.array([k[:, z - 1].tolist()]), whole], ["first", "last", "text"])

    laid = words.orderBy(*order).select(*[F.col(c).cast("long") for c in keys], word.alias("word"))
    return laid.mapInArrow(run, "first array<bigint>, last array<bigint>, text string")


def _write_words(words: DataFrame, line: str, word: Column, lines: int, path: str, head: list[str] = (), starts: DataFrame | None = None, tail: DataFrame | None = None) -> None:
    """Lines 0 .. lines-1 of words (``line``, at, and what ``word`` takes) in order of ``at``, lines without words empty;
    ``starts`` (``line``, word) come first in their lines; ``tail`` (at, word) follows, a word a line."""
    each, order = words.withColumn("line", F.col(line)), ["line", "at"]
    if starts is not None:
        each = each.withColumn("part", F.lit(1)).unionByName(starts.select(F.col(line).alias("line"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.col("word").alias("start")), allowMissingColumns=True)
        word, order = F.coalesce("start", word), ["line", "part", "at"]
    with text_sink(words.sparkSession, path) as f:
        for h in head:
            f.write(h + "\n")
        now = 0
        for r in _joined(each, order, ["line"], word, True).toLocalIterator(prefetchPartitions=True):
            _blank_lines(f, r["first"][0] - now)
            f.write(r["text"])
            now = r["last"][0]
        _blank_lines(f, lines - now)
        for r in tail.orderBy("at").toLocalIterator(prefetchPartitions=True) if tail is not None else ():
            f.write(r["word"] + "\n")


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """i, line: every value with sign and eight decimals in exponent form, each followed by a blank."""
    return matrix.select("i", F.array_join(F.transform("row", lambda v: F.concat(F.format_string("%+.8e", v), F.lit(" "))), "").alias("line"))


def write_matrix(matrix: DataFrame, path: str, rows: int, rank: int) -> None:
    """Rows 0 .. rows-1, absent ones as zeros."""
    every = matrix.sparkSession.range(rows).withColumnRenamed("id", "i").join(matrix, "i", "left")
    full = every.select("i", F.coalesce("row", F.array_repeat(F.lit(0.0), rank)).alias("row"))
    _write(matrix_lines(full).orderBy("i"), "line", path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, row of a matrix file."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], [float(v) for v in x[0].split()]))
    return spark.createDataFrame(lines, "i bigint, row array<double>")


def write_vector(spark: SparkSession, values, path: str) -> None:
    with text_sink(spark, path) as f:
        for v in values:
            f.write(f"{float(v):e}\n")


def _entry(col: str) -> Column:
    return F.concat(F.col(col).cast("string"), F.lit(" "), F.format_string("%.6f", "val"), F.lit(" "))


def write_csr(tensor: SparseTensor, mode: int, path: str) -> None:
    """The unfolding of a mode: per row its 0-based column and value pairs, empty rows as empty lines."""
    x = tensor.unfold(mode, wide="decimal")
    _write_words(x.withColumnRenamed("col", "at"), "row", _entry("at"), tensor.dims[mode], path)


def write_fiber_matrix(tensor: SparseTensor, mode: int, path: str) -> None:
    """The fibers of a mode as rows: per fiber the pairs of index along the longest other mode and value.

    Nonzeros in fiber order need no numbers of fibers: a line ends where the fiber does.
    """
    order = [f"i{m}" for m in structure.fiber_order(tensor.dims, mode)]
    last = None
    with text_sink(tensor.df.sparkSession, path) as f:
        for r in _joined(tensor.df, order, order[:-1], _entry(order[-1]), False).toLocalIterator(prefetchPartitions=True):
            if last is not None and r["first"] != last:
                f.write("\n")
            f.write(r["text"])
            last = r["last"]
        if last is not None:
            f.write("\n")


def write_part_files(df: DataFrame, folder: str) -> None:
    """Nonzeros with a whole number ``part``, 1-based, as text files in ``folder``/part=N/, one folder per part."""
    modes = [c for c in df.columns if c[0] == "i" and c[1:].isdigit()]
    line = F.concat_ws(" ", *[(F.col(c) + 1).cast("string") for c in modes], F.col("val").cast("string"))
    df.select("part", line.alias("value")).write.mode("overwrite").partitionBy("part").text(folder)


def read_part_files(spark: SparkSession, folder: str, nmodes: int) -> DataFrame:
    """Nonzeros with their part of the files that ``write_part_files`` wrote."""
    p = F.split("value", " ")
    return spark.read.text(folder).select(*[(p[m].cast("long") - 1).alias(f"i{m}") for m in range(nmodes)], p[nmodes].cast("double").alias("val"), F.col("part").cast("long").alias("part"))


def read_parts(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """vtx, part: one part number per line."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], int(x[0])))
    out = spark.createDataFrame(lines, "vtx bigint, part bigint")
    if expected is not None and (n := out.count()) < expected:
        raise TensorError(f"{path} holds {n} parts, {expected} are needed")
    return out


def write_parts(parts: DataFrame, path: str) -> None:
    _write(parts.orderBy("vtx").select(F.col("part").cast("string").alias("line")), "line", path)


def write_permutation(perm: DataFrame, path: str) -> None:
    """0-based new index of every old one, one per line."""
    _write(perm.orderBy("old").select(F.col("new").cast("string").alias("line")), "line", path)


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1], int(x[0])))
    return spark.createDataFrame(lines, "old bigint, new bigint")


def write_map(index_map: DataFrame, path: str) -> None:
    """1-based old index of every new one, one per line."""
    _write(index_map.orderBy("new").select((F.col("old") + 1).cast("string").alias("line")), "line", path)


def write_graph(tensor: SparseTensor, path: str, vertex_weights: bool = False) -> None:
    """Adjacency form: vertices, edges and a format code, then a line of neighbours and weights per vertex."""
    edges = graphs.partite_edges(tensor)
    n = sum(tensor.dims)
    head = f"{n} {edges.count() // 2} 0{int(vertex_weights)}1" + (" 1" if vertex_weights else "")
    starts = graphs.vertex_weights(tensor).select("v", F.concat(F.col("w").cast("string"), F.lit(" ")).alias("word")) if vertex_weights else None
    _write_words(graphs.graph_words(edges), "v", F.col("word"), n, path, [head], starts)


def write_hypergraph(pins: DataFrame, n_hedges: int, n_vertices: int, path: str, vertex_weights: DataFrame | None = None, hedge_weights: DataFrame | None = None) -> None:
    """Hyperedges, vertices and, with weights, a format code (1 for hyperedges (hedge, w), 10 for vertices (v, w), 11 for
    both); a line of pins per hyperedge, after its weight; then the vertex weights."""
    code = 10 * (vertex_weights is not None) + (hedge_weights is not None)
    head = f"{n_hedges} {n_vertices}" + (f" {code}" if code else "")
    starts = hedge_weights.select("hedge", F.concat(F.col("w").cast("string"), F.lit(" ")).alias("word")) if hedge_weights is not None else None
    tail = vertex_weights.select(F.col("v").alias("at"), F.col("w").cast("string").alias("word")) if vertex_weights is not None else None
    _write_words(graphs.hypergraph_words(pins), "hedge", F.col("word"), n_hedges, path, [head], starts, tail)
