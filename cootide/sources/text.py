"""Text tensors: one nonzero per line, indices then value, apart by blanks or tabs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cootide.core import MAX_MODES, SparseTensor, TensorError
from cootide.operators import lenient

SUFFIXES = {".tns": "text", ".coo": "text", ".bin": "binary"}


def format_of(path: str) -> str:
    """text or binary by the name's ending; any other ending is taken for text."""
    return SUFFIXES.get(os.path.splitext(path.rstrip("/"))[1].lower(), "text")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: without empty lines and lines that start with ``#``."""
    return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"\r\z", "")).alias("line")).where((F.length("line") > 0) & ~F.col("line").startswith("#"))


def read_text(spark: SparkSession, path: str, *, max_modes: int = MAX_MODES) -> SparseTensor:
    """Read a text tensor strictly; a line that is no nonzero raises when rows are read.

    The number of modes is that of the first data line. Every mode counts from 1 unless its smallest index is 0. Values
    written twice stay two nonzeros. ``cootide.operators.lenient`` reads files with bad lines.
    """
    lines = data_lines(spark, path)
    first = lines.first()
    if first is None:
        raise TensorError(f"{path} holds no nonzeros")
    n = len(first["line"].split()) - 1
    if not 1 <= n <= max_modes:
        raise TensorError(f"{path} has {n} modes; 1 to {max_modes} are supported")
    parts = F.split(F.trim(F.translate("line", "\t", " ")), " +")
    x = lines.select(parts.alias("p"))
    wrong = F.raise_error(F.concat(F.lit("no nonzero: "), F.array_join("p", " ")))

    def number(c: Column, kind: str) -> Column:
        return F.coalesce(c.try_cast(kind), F.when(F.size("p") >= 0, wrong).cast(kind))

    x = x.select(*[F.when(F.size("p") == n + 1, number(F.col("p")[m], "bigint")).otherwise(wrong.cast("bigint")).alias(f"i{m}") for m in range(n)], number(F.col("p")[n], "double").alias("val"))
    ends = x.agg(*[F.min(f"i{m}").alias(f"a{m}") for m in range(n)], *[F.max(f"i{m}").alias(f"b{m}") for m in range(n)]).first()
    base = [min(1, ends[f"a{m}"]) for m in range(n)]
    if min(base) < 0:
        raise TensorError(f"{path} holds a negative index")
    df = x.select(*[(F.col(f"i{m}") - base[m]).alias(f"i{m}") for m in range(n)], "val")
    return SparseTensor(df, [ends[f"b{m}"] - base[m] + 1 for m in range(n)])


def read_lenient(spark: SparkSession, path: str, nmodes: int, dims: list[int], index_base: int = 1) -> tuple[SparseTensor, DataFrame]:
    """(tensor of the lines that load, lines set apart with reason and edits) of a text file of known shape."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.lit(0).alias("file_id"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw_line"))
    files = spark.createDataFrame([(0, nmodes, index_base, dims)], "file_id int, nmodes int, index_base int, dims array<bigint>")
    parsed = lenient.parse_lines(lines, files)
    good = parsed.where("reason IS NULL").select(*[F.col("indices")[m].alias(f"i{m}") for m in range(nmodes)], F.col("value").alias("val"))
    return SparseTensor(good, list(dims)), parsed.where("reason IS NOT NULL").select("line_no", "reason", "cost", "edits")


def text_lines(tensor: SparseTensor, *, base: int = 1, six_decimals: bool = False) -> DataFrame:
    """value: one line per nonzero; values with all digits, or with six decimals."""
    val = F.format_string("%.6f", "val") if six_decimals else F.col("val").cast("string")
    return tensor.df.select(F.concat_ws(" ", *[(F.col(c) + base).cast("string") for c in tensor.modes], val).alias("value"))


def write_text(tensor: SparseTensor, path: str, *, base: int = 1, six_decimals: bool = False, single_file: bool = False) -> None:
    """A folder of text parts, or one file in coordinate order written by the driver from a stream of rows."""
    lines = text_lines(tensor, base=base, six_decimals=six_decimals)
    if not single_file:
        lines.write.mode("overwrite").text(path)
        return
    with open(path, "w") as f:
        for r in text_lines(tensor.with_df(tensor.sorted(0)), base=base, six_decimals=six_decimals).toLocalIterator(prefetchPartitions=True):
            f.write(r["value"] + "\n")


def read(spark: SparkSession, path: str, **options) -> SparseTensor:
    """Read a text or binary tensor by its name's ending."""
    from . import binary

    return binary.read_binary(spark, path, **options) if format_of(path) == "binary" else read_text(spark, path, **options)


def write(tensor: SparseTensor, path: str, **options) -> None:
    from . import binary

    binary.write_binary(tensor, path) if format_of(path) == "binary" else write_text(tensor, path, **options)
