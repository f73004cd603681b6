"""Canonical polyadic decomposition by alternating least squares.

The driver runs the loop and holds only rank-sized matrices. Factor matrices whose proven size (sum of dims times rank)
is below a limit are kept as NumPy arrays and broadcast to the product kernel, so plans never grow. Larger ones stay
DataFrames: every update is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cootide.core import SparseTensor, TensorError, affine_factor
from cootide.session import materialize, release

from . import kernels, linalg

log = logging.getLogger("cootide.cpd")


@dataclass
class CpdOptions:
    """Stopping rule, regularisation and start of the iteration."""

    tolerance: float = 1e-5
    regularization: float = 0.0
    max_iterations: int = 50
    seed: int = 0
    init: str = "random"  # random | affine
    compact: bool = True  # drop empty slices first
    driver_bytes: int = 256 << 20  # largest total size of factors kept as arrays
    verbosity: int = 1  # 0 none, 1 summary, 2 iterations, 3 modes


@dataclass
class Kruskal:
    """Weights and unit-column factors: X[i, j, ...] is about sum_r weights[r] A0[i, r] A1[j, r] ..."""

    rank: int
    dims: list[int]
    weights: np.ndarray
    factors: list[np.ndarray | DataFrame]
    fit: float
    fits: list[float] = field(default_factory=list)
    maps: dict[int, DataFrame] = field(default_factory=dict)
    seconds: list[float] = field(default_factory=list)  # of every iteration

    def factor_frame(self, spark: SparkSession, mode: int) -> DataFrame:
        """i, row of a factor."""
        f = self.factors[mode]
        return f if isinstance(f, DataFrame) else array_frame(spark, f)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """mode, i, r, value of all factors."""
        out = None
        for m in range(len(self.dims)):
            x = linalg.to_long(self.factor_frame(spark, m)).select(F.lit(m).alias("mode"), "i", "r", F.col("v").alias("value"))
            out = x if out is None else out.unionByName(x)
        return out

    def save(self, spark: SparkSession, stem: str) -> None:
        """Text files ``{stem}lambda.mat`` and ``{stem}mode1.mat`` .. in row order."""
        from cootide.sources import matrices

        matrices.write_vector(spark, self.weights, f"{stem}lambda.mat")
        for m, d in enumerate(self.dims):
            matrices.write_matrix(self.factor_frame(spark, m), f"{stem}mode{m + 1}.mat", d, self.rank)

    def free(self) -> None:
        for f in self.factors:
            if isinstance(f, DataFrame):
                release(f)


def array_frame(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, row) for i, row in enumerate(a.tolist())], "i bigint, row array<double>")


def random_row(index: Column, mode: int, rank: int, seed: int) -> Column:
    """Values uniform in (-3, 3) that depend on (seed, mode, i, r) alone, so on no partitioning."""
    unit = lambda r: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(mode), index, F.lit(r)), 11).cast("double") / float(1 << 53)
    return F.array(*[unit(r) * 6.0 - 3.0 for r in range(rank)])


def start_factor(spark: SparkSession, dim: int, mode: int, rank: int, options: CpdOptions) -> DataFrame:
    if options.init == "affine":
        return affine_factor(spark, dim, mode, rank)
    if options.init == "random":
        return spark.range(dim).select(F.col("id").alias("i"), random_row(F.col("id"), mode, rank, options.seed).alias("row"))
    raise TensorError(f"unknown start {options.init!r}")


def model_normsq(grams: list[np.ndarray], weights: np.ndarray) -> float:
    return float(abs(weights @ linalg.hadamard(grams) @ weights))


def fit_of(normsq: float, model: float, inner: float) -> float:
    """1 - |X - Z| / |X|; a residual that rounds below zero is not rooted."""
    residual = normsq + model - 2 * inner
    return 1 - (math.sqrt(residual) if residual > 0 else residual) / math.sqrt(normsq)


def cpd_als(tensor: SparseTensor, rank: int, options: CpdOptions | None = None, start: list[np.ndarray] | None = None) -> Kruskal:
    """Decompose; stops when the fit is 1 or changes by less than the tolerance, or after the most iterations.

    Per iteration and mode: M = product, A = M H^-1 with H the elementwise product of the other Gram matrices, columns
    normalised (Euclidean in the first iteration, later by the largest signed value but at least 1), Gram of A renewed.
    A tensor without nonzeros cannot be decomposed. ``start`` gives first factors, one array per mode.
    """
    options = options or CpdOptions()
    x = tensor.compact() if options.compact and start is None else tensor
    x = x.materialize()
    normsq = x.normsq()
    if normsq == 0:
        raise TensorError("a tensor without nonzeros has no decomposition")
    small = sum(kernels.factor_bytes(d, rank) for d in x.dims) <= min(options.driver_bytes, memory_bytes(x.df.sparkSession) // 16)
    if options.verbosity:
        log.info("%s", describe(x, rank, options, small))
    run = _on_arrays if small else _on_frames
    out = run(x, rank, options, normsq, start)
    out.maps = x.maps
    release(x.df)
    if options.verbosity:
        log.info("final fit %.6f after %d iterations", out.fit, len(out.fits))
    return out


def memory_bytes(spark: SparkSession) -> int:
    """Memory of an executor, or of the driver in local mode, as configured; 1 GB where it is not."""
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    text = spark.sparkContext.getConf().get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1])
    return int(float(text[:-1]) * (1 << unit)) if unit else int(text)


def describe(x: SparseTensor, rank: int, options: CpdOptions, arrays: bool = True) -> str:
    """Settings of a decomposition and the bytes of its tensor and factors, in lines of NAME=value."""
    from .stats import bytes_text, coordinate_bytes

    nnz = x.nnz()
    return "\n".join([
        f"DIMS={'x'.join(map(str, x.dims))} NNZ={nnz} RANK={rank}",
        f"TOLERANCE={options.tolerance:g} MAX-ITERATIONS={options.max_iterations} REGULARIZATION={options.regularization:g} SEED={options.seed} START={options.init}",
        f"COORD-STORAGE={bytes_text(coordinate_bytes(nnz, x.nmodes))} FACTOR-STORAGE={bytes_text(sum(x.dims) * rank * 8)} FACTORS={'arrays' if arrays else 'frames'}",
    ])


def _stops(fits: list[float], options: CpdOptions) -> bool:
    return fits[-1] == 1.0 or (len(fits) > 1 and abs(fits[-1] - fits[-2]) < options.tolerance)


def _on_arrays(x: SparseTensor, rank: int, options: CpdOptions, normsq: float, start) -> Kruskal:
    spark, n = x.df.sparkSession, x.nmodes
    factors = [np.array(f, dtype=float) for f in start] if start is not None else [kernels.to_numpy(start_factor(spark, d, m, rank, options), d, rank) for m, d in enumerate(x.dims)]
    grams = [f.T @ f for f in factors]
    nonzeros = kernels.packed(x)
    weights, fits, tasks = np.ones(rank), [], nonzeros.rdd.getNumPartitions()
    few = kernels.held(nonzeros, x.dims) if x.nnz() <= kernels.HELD_NONZEROS else None
    shared = {} if few is not None else {m: spark.sparkContext.broadcast(f) for m, f in enumerate(factors)}
    seconds = []
    for it in range(options.max_iterations):
        began = time.time()
        for m in range(n):
            arrays = dict(enumerate(factors))
            product = kernels.held_product(few, x.dims, arrays, m, rank) if few is not None else kernels.product_array(nonzeros, x.dims, shared, m, rank, tasks)
            a = linalg.solve_normals(linalg.hadamard(grams, m, options.regularization), product)
            weights = np.sqrt((a * a).sum(axis=0)) if it == 0 else np.maximum(1.0, a.max(axis=0))
            a /= np.where(weights > 0, weights, 1.0)
            factors[m], grams[m] = a, a.T @ a
            if few is None:
                shared[m].destroy()  # once per update, so memory stays flat
                shared[m] = spark.sparkContext.broadcast(a)
        inner = float((product * factors[n - 1]).sum(axis=0) @ weights)
        fits.append(fit_of(normsq, model_normsq(grams, weights), inner))
        seconds.append(time.time() - began)
        if options.verbosity > 1:
            log.info("its = %3d (%.3fs)  fit = %.5f", it + 1, seconds[-1], fits[-1])
        if _stops(fits, options):
            break
    for b in shared.values():
        b.destroy()
    release(nonzeros)
    for m in range(n):
        norms = np.sqrt((factors[m] ** 2).sum(axis=0))
        factors[m] = factors[m] / np.where(norms > 0, norms, 1.0)
        weights = weights * norms
    return Kruskal(rank, list(x.dims), weights, factors, fits[-1] if fits else 0.0, fits, seconds=seconds)


def _on_frames(x: SparseTensor, rank: int, options: CpdOptions, normsq: float, start) -> Kruskal:
    spark, n = x.df.sparkSession, x.nmodes
    factors: list[DataFrame] = [materialize(array_frame(spark, np.asarray(start[m], float)) if start is not None else start_factor(spark, d, m, rank, options)) for m, d in enumerate(x.dims)]
    grams = [linalg.gram(f, rank) for f in factors]
    weights, fits, seconds = np.ones(rank), [], []
    for it in range(options.max_iterations):
        began = time.time()
        for m in range(n):
            product = materialize(kernels.mttkrp(x, dict(enumerate(factors)), m, rank))
            raw = materialize(linalg.solve_rows(product, linalg.hadamard(grams, m, options.regularization)))
            scaled, norms = linalg.normalize(raw, rank, "2" if it == 0 else "max")
            new = materialize(scaled)
            release(raw), release(factors[m])
            factors[m], weights = new, np.array(norms)
            grams[m] = linalg.gram(new, rank)
            if m < n - 1:
                release(product)
        inner = kernels.inner_product(x, product, factors[n - 1], weights.tolist())
        release(product)
        fits.append(fit_of(normsq, model_normsq(grams, weights), inner))
        seconds.append(time.time() - began)
        if options.verbosity > 1:
            log.info("its = %3d (%.3fs)  fit = %.5f", it + 1, seconds[-1], fits[-1])
        if _stops(fits, options):
            break
    for m in range(n):
        scaled, norms = linalg.normalize(factors[m], rank)
        new = materialize(scaled)
        release(factors[m])
        factors[m], weights = new, weights * np.array(norms)
    return Kruskal(rank, list(x.dims), weights, factors, fits[-1] if fits else 0.0, fits, seconds=seconds)
