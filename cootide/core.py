"""Sparse tensors as DataFrames: one BIGINT column per mode and a DOUBLE value."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cootide.functions import radix, ranking
from cootide.session import materialize

MAX_MODES = 8


class TensorError(ValueError):
    """Input that is no tensor, or an operation that does not apply to it."""


@dataclass
class SparseTensor:
    """Columns ``i0`` .. ``i{N-1}`` and ``val`` of ``df``, and the dims, every index below its dim.

    Duplicated coordinates are kept until ``sum_duplicates``. Operations are lazy and return DataFrames or tensors;
    scalars (``nnz``, ``normsq``, ...) run one aggregation.
    """

    df: DataFrame
    dims: list[int]
    names: list[str] = field(default_factory=list)
    maps: dict[int, DataFrame] = field(default_factory=dict)

    # -- construction ---------------------------------------------------------------------------------------------

    @classmethod
    def from_dataframe(cls, df: DataFrame, mode_cols: list[str], value_col: str, dims: list[int] | None = None, *, max_modes: int = MAX_MODES) -> SparseTensor:
        """Take 0-based integer columns as modes. Without ``dims`` one aggregation infers them as largest index + 1.

        A null or negative index, or a null value, raises when rows are read: a tensor has none. Other columns are
        not read. An empty frame needs ``dims``.
        """
        if not 1 <= len(mode_cols) <= max_modes:
            raise TensorError(f"{len(mode_cols)} modes; 1 to {max_modes} are supported")
        bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) for c in mode_cols]) | F.col(value_col).isNull()
        guard = F.when(bad, F.raise_error(F.lit("null or negative index, or null value"))).otherwise(F.col(value_col).cast("double"))
        out = df.select(*[F.col(c).cast("long").alias(f"i{m}") for m, c in enumerate(mode_cols)], guard.cast("double").alias("val"))
        if dims is None:
            row = out.agg(*[F.max(f"i{m}").alias(f"d{m}") for m in range(len(mode_cols))], F.sum("val")).first()
            if row["d0"] is None:
                raise TensorError("no nonzeros and no dims")
            dims = [row[f"d{m}"] + 1 for m in range(len(mode_cols))]
        return cls(out, [int(d) for d in dims], list(mode_cols))

    @classmethod
    def from_arrays(cls, spark: SparkSession, subs, vals, base: int = 0, dims: list[int] | None = None) -> SparseTensor:
        """Take an (nnz, modes) integer array and values held by the driver; base 1 for 1-based indices."""
        subs, vals = np.asarray(subs, dtype=np.int64) - base, np.asarray(vals, dtype=np.float64)
        if subs.ndim != 2 or len(subs) != len(vals):
            raise TensorError("indices must be (nnz, modes) with one value per row")
        n = subs.shape[1]
        schema = ", ".join(f"i{m} bigint" for m in range(n)) + ", val double"
        df = spark.createDataFrame([(*map(int, s), float(v)) for s, v in zip(subs, vals)], schema)
        return cls.from_dataframe(df, [f"i{m}" for m in range(n)], "val", dims)

    @property
    def nmodes(self) -> int:
        return len(self.dims)

    @property
    def modes(self) -> list[str]:
        return [f"i{m}" for m in range(self.nmodes)]

    def with_df(self, df: DataFrame, dims: list[int] | None = None) -> SparseTensor:
        return SparseTensor(df.select(*self.modes, "val"), list(dims or self.dims), list(self.names))

    def materialize(self) -> SparseTensor:
        """Written once as Parquet: every later pass reads that."""
        return SparseTensor(materialize(self.df), list(self.dims), list(self.names), self.maps)

    def dim(self, mode: int) -> int:
        return self.dims[mode]

    # -- scalars --------------------------------------------------------------------------------------------------

    def nnz(self) -> int:
        return self.df.count()

    def normsq(self) -> float:
        return float(self.df.agg(F.sum(F.col("val") * F.col("val"))).first()[0] or 0.0)

    def norm(self) -> float:
        return math.sqrt(self.normsq())

    def density(self) -> float:
        return density(self.nnz(), self.dims)

    # -- rows -----------------------------------------------------------------------------------------------------

    def slices(self, mode: int) -> DataFrame:
        """Distinct indices of a mode with their number of nonzeros: i, nnz."""
        return self.df.groupBy(F.col(f"i{mode}").alias("i")).agg(F.count(F.lit(1)).alias("nnz"))

    def histogram(self, mode: int) -> DataFrame:
        """Number of nonzeros of every index of a mode, 0 for empty ones: i, nnz."""
        every = self.df.sparkSession.range(self.dims[mode]).withColumnRenamed("id", "i")
        return every.join(self.slices(mode), "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))

    def sum_duplicates(self) -> SparseTensor:
        """Nonzeros of equal coordinates become one whose value is their sum."""
        return self.with_df(self.df.groupBy(*self.modes).agg(F.sum("val").alias("val")))

    def count_duplicates(self) -> int:
        """How many nonzeros ``sum_duplicates`` would remove."""
        r = self.df.groupBy(*self.modes).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1)).first()
        return int(r[0] or 0)

    def index_map(self, mode: int) -> DataFrame:
        """new, old: the used indices of a mode numbered densely in ascending order."""
        ids = ranking.dense_ids(self.df.select(F.col(f"i{mode}").alias("old")), "old", "new")
        return ids.select("new", "old")

    def compact(self) -> SparseTensor:
        """Without empty slices: every mode renumbered densely, order kept; ``maps`` holds new -> old per mode."""
        df, dims, maps = self.df, [], {}
        for m, c in enumerate(self.modes):
            ids = self.index_map(m)
            n = ids.count()
            dims.append(n)
            if n == self.dims[m]:
                continue
            maps[m] = ids
            df = df.join(ids.select(F.col("old").alias(c), F.col("new").alias("_new")), c).drop(c).withColumnRenamed("_new", c)
        out = self.with_df(df, dims)
        out.maps = maps
        return out

    def empty_slices(self) -> int:
        """Number of indices without nonzeros, over all modes."""
        used = self.df.agg(*[F.count_distinct(c).alias(c) for c in self.modes]).first()
        return sum(d - used[c] for d, c in zip(self.dims, self.modes))

    def check(self) -> tuple[int, int, SparseTensor]:
        """(duplicates removed, empty slices removed, the tensor without them); duplicates go first."""
        return self.count_duplicates(), self.empty_slices(), self.sum_duplicates().compact()

    def restrict(self, mode: int, start: int, end: int) -> SparseTensor:
        """Slices start <= i < end of a mode, shifted to start at 0; the range reaches the scan as a filter."""
        c = f"i{mode}"
        dims = [end - start if m == mode else d for m, d in enumerate(self.dims)]
        return self.with_df(self.df.where((F.col(c) >= start) & (F.col(c) < end)).withColumn(c, F.col(c) - start), dims)

    def sorted(self, mode: int = 0, order: list[int] | None = None) -> DataFrame:
        """Nonzeros sorted by all modes, ``mode`` first and the others after it in circular order, or by ``order``."""
        order = order or [(mode + k) % self.nmodes for k in range(self.nmodes)]
        return self.df.orderBy(*[f"i{m}" for m in order])

    def sorted_within(self, tile: Column | str, mode: int = 0, partitions: int | None = None) -> DataFrame:
        """Nonzeros with ``tile``, each tile whole in one partition and sorted there by tile and then as ``sorted``."""
        x = self.df.withColumn("tile", F.col(tile) if isinstance(tile, str) else tile)
        n = partitions or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return x.repartition(n, "tile").sortWithinPartitions("tile", *[f"i{(mode + k) % self.nmodes}" for k in range(self.nmodes)])

    def extreme_slice(self, mode: int, largest: bool = True) -> tuple[int, int] | None:
        """(index, nonzeros) of the slice with most, or fewest, nonzeros, the first of equals; None without nonzeros.

        Slices without nonzeros count for the fewest.
        """
        x = self.slices(mode) if largest else self.histogram(mode)
        first = F.max_by if largest else F.min_by
        r = x.agg(first("i", F.struct("nnz", (-F.col("i") if largest else F.col("i")).alias("at"))).alias("i"), (F.max if largest else F.min)("nnz").alias("nnz")).first()
        return None if r["i"] is None else (r["i"], r["nnz"])

    def clustered(self, mode: int, partitions: int | None = None) -> SparseTensor:
        """Partitioned by a mode and sorted within, for repeated work on that mode."""
        n = partitions or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [(mode + k) % self.nmodes for k in range(self.nmodes)]
        return self.with_df(self.df.repartition(n, f"i{mode}").sortWithinPartitions(*[f"i{m}" for m in order]))

    # -- unfolding ------------------------------------------------------------------------------------------------

    def unfold(self, mode: int, wide: str = "struct") -> DataFrame:
        """row, col, val of the matricised tensor: col codes the other modes, the last varying fastest.

        Where such codes exceed 64 bits, col is the struct of the other modes, which sorts and joins like the code, or
        with ``wide="decimal"`` the code as a decimal number of up to 38 digits.
        """
        rest = [m for m in range(self.nmodes) if m != mode]
        names, sizes = [f"i{m}" for m in rest], [self.dims[m] for m in rest]
        col = radix.encode(names, sizes) if radix.fits(sizes) else F.struct(*names) if wide == "struct" else radix.encode_decimal(names, sizes)
        return self.df.select(F.col(f"i{mode}").alias("row"), col.alias("col"), "val")

    def row_pointers(self, mode: int) -> DataFrame:
        """row, nnz, start of every row of the unfolding, empty ones included."""
        return ranking.running_sum(self.histogram(mode).withColumnRenamed("i", "row"), ["row"], "nnz", "start")


def density(nnz: int, dims: list[int]) -> float:
    """nnz / product of dims, as a product of roots so that large dims do not overflow."""
    return math.prod(nnz ** (1 / len(dims)) / d for d in dims) if nnz else 0.0


def index_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the dense rank of a column of any ordered type as a 0-based index; rows with a null there are dropped."""
    return df.join(ranking.dense_ids(df, column, name), column)


def rebase(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shift integer columns to start at 0 by their smallest value."""
    least = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) - F.lit(least[c]).cast("long") for c in columns})


def affine_row(index: Column, mode: int, rank: int) -> Column:
    """Small integer factor values by rule, the same in any SQL engine: ((7 i + 5 r + 3 mode) mod 11) - 5."""
    return F.array(*[(F.pmod(7 * index + 5 * r + 3 * mode, F.lit(11)) - 5).cast("double") for r in range(rank)])


def affine_factor(spark: SparkSession, dim: int, mode: int, rank: int) -> DataFrame:
    """i, row of a whole factor matrix by that rule."""
    return spark.range(dim).select(F.col("id").alias("i"), affine_row(F.col("id"), mode, rank).alias("row"))
