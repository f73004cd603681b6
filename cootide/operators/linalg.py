"""Tall matrices (i, row) as DataFrames and their rank-sized companions as NumPy arrays on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def gram(matrix: DataFrame, rank: int) -> np.ndarray:
    """A^T A: each task sums its part, so R x R numbers per task reach the final sum, whatever the number of rows."""

    def parts(batches):
        total = np.zeros((rank, rank))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, rank)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([v]) for v in total.ravel()]], ["k", *[f"g{n}" for n in range(rank * rank)]])

    schema = "k bigint, " + ", ".join(f"g{n} double" for n in range(rank * rank))
    sums = matrix.select("row").mapInArrow(parts, schema).groupBy("k").agg(*[F.sum(f"g{n}").alias(f"g{n}") for n in range(rank * rank)]).first()
    return np.array(sums[1:]).reshape(rank, rank) if sums else np.zeros((rank, rank))


def gram_entries(matrix: DataFrame, rank: int) -> DataFrame:
    """r, s, v of the upper triangle of A^T A, in generated code; for small ranks."""
    pairs = [(r, s) for r in range(rank) for s in range(r, rank)]
    sums = matrix.agg(*[F.sum(F.col("row")[r] * F.col("row")[s]).alias(f"g{r}_{s}") for r, s in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.col(f"g{r}_{s}").alias("v")) for r, s in pairs])).alias("e")).select("e.*")


def hadamard(grams: list[np.ndarray], skip: int | None = None, reg: float = 0.0) -> np.ndarray:
    """Elementwise product of all Gram matrices but one, plus ``reg`` on the diagonal."""
    out = np.ones_like(grams[0])
    for m, g in enumerate(grams):
        if m != skip:
            out = out * g
    return out + reg * np.eye(len(out))


def normal_inverse(h: np.ndarray) -> np.ndarray:
    """The matrix that solves the normal equations from the right: the inverse, or for one that is not positive
    definite the minimum-norm pseudo-inverse with machine precision as cutoff."""
    try:
        np.linalg.cholesky(h)
        return np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(h, rcond=np.finfo(float).eps, hermitian=True)


def solve_normals(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of X with X H = rows."""
    try:
        low = np.linalg.cholesky(h)
        return np.linalg.solve(low.T, np.linalg.solve(low, rows.T)).T
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(h.T, rows.T, rcond=np.finfo(float).eps)[0].T


def solve_rows(matrix: DataFrame, h: np.ndarray) -> DataFrame:
    """i, row of X with X H = matrix for a tall matrix (i, row), solved batch by batch as in ``solve_normals``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = solve_normals(h, np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(h), dtype=np.int32), pa.array(x.ravel()))], ["i", "row"])

    return matrix.select("i", "row").mapInArrow(run, "i bigint, row array<double>")


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower triangular L with L L^T = A; raises LinAlgError if A is not positive definite."""
    return np.linalg.cholesky(a)


def symmetric_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix through its Cholesky factor."""
    low = np.linalg.inv(cholesky(a))
    return low.T @ low


def times(matrix: DataFrame, small: np.ndarray) -> DataFrame:
    """i, row of the tall matrix times a small dense one."""

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1) @ small
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, small.shape[1], dtype=np.int32), pa.array(x.ravel()))], ["i", "row"])

    return matrix.select("i", "row").mapInArrow(run, "i bigint, row array<double>")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of the product of long matrices (i, k, v) and (k, j, v)."""
    x = a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def to_long(matrix: DataFrame) -> DataFrame:
    """i, r, v of a matrix (i, row)."""
    return matrix.select("i", F.posexplode("row").alias("r", "v"))


def to_wide(entries: DataFrame) -> DataFrame:
    """i, row of a matrix (i, r, v) in which every row has every r."""
    return entries.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("row"))


def column_norms(matrix: DataFrame, rank: int, kind: str = "2") -> list[float]:
    """Euclidean norms, or for ``max`` the largest signed value, at least 1."""
    if kind == "2":
        row = matrix.agg(*[F.sqrt(F.sum(F.col("row")[r] * F.col("row")[r])) for r in range(rank)]).first()
        return [float(x or 0.0) for x in row]
    row = matrix.agg(*[F.max(F.col("row")[r]) for r in range(rank)]).first()
    return [max(1.0, float(x or 0.0)) for x in row]


def normalize(matrix: DataFrame, rank: int, kind: str = "2") -> tuple[DataFrame, list[float]]:
    """Columns divided by their norms; a zero column stays zero and its norm is given as 0."""
    norms = column_norms(matrix, rank, kind)
    scaled = F.array(*[F.col("row")[r] / F.lit(n if n else 1.0) for r, n in enumerate(norms)])
    return matrix.select("i", scaled.alias("row")), norms
