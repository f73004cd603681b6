"""Statistics of tensors and their text forms, timers and the benchmark of product plans."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cootide.core import SparseTensor, TensorError, affine_factor, density

from . import kernels, structure


def bytes_text(n: float) -> str:
    """Size with two decimals and a unit, in steps of 1024."""
    for unit in ("B", "KB", "MB", "GB"):
        if n <= 1024:
            return f"{n:.2f}{unit}"
        n /= 1024
    return f"{n:.2f}TB"


def coordinate_bytes(nnz: int, nmodes: int) -> int:
    return nnz * (8 * nmodes + 8)


def stats(tensor: SparseTensor) -> DataFrame:
    """One row: nmodes, nnz, normsq, storage bytes; dims are known to the tensor."""
    x = tensor.df.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0)).alias("normsq"))
    return x.select(F.lit(tensor.nmodes).alias("nmodes"), "nnz", "normsq", (F.col("nnz") * (8 * tensor.nmodes + 8)).alias("coord_bytes"))


def stats_text(tensor: SparseTensor, name: str = "") -> str:
    nnz = tensor.nnz()
    return "\n".join([f"FILE={name}", f"DIMS={'x'.join(map(str, tensor.dims))} NNZ={nnz}", f"DENSITY={density(nnz, tensor.dims):e}", f"COORD-STORAGE={bytes_text(coordinate_bytes(nnz, tensor.nmodes))}"])


def tree_text(tensor: SparseTensor, copies: str = "two") -> str:
    """Mode orders and storage of the compressed copies."""
    lines = []
    for order in structure.tree_orders(tensor.dims, copies):
        s = tree_stats(tensor, order).first()
        lines.append(f"MODE-ORDER={'-'.join(map(str, order))} STORAGE={bytes_text(structure.tree_storage(tensor, order))} TILES={s['tile_dims']} EMPTY={s['empty']} ({s['empty_percent']:.1f}%)")
    return "\n".join(lines)


def tree_stats(tensor: SparseTensor, order: list[int], tiles_per_mode: int = 1, levels: int = 0) -> DataFrame:
    """One row: nmodes, nnz, mode_order, tile_dims, ntiles, empty tiles and their share in percent.

    The bottom ``levels`` levels of the order are cut into ``tiles_per_mode`` tiles each.
    """
    cut = order[len(order) - levels :] if levels else []
    sizes = [tiles_per_mode if m in cut else 1 for m in range(tensor.nmodes)]
    ntiles = math.prod(sizes)
    x = structure.with_tiles(tensor, sizes, cut).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.count(F.lit(1)).alias("used"))
    empty = F.lit(ntiles) - F.col("used")
    return x.select(
        F.lit(tensor.nmodes).alias("nmodes"), "nnz", F.lit("->".join(map(str, order))).alias("mode_order"), F.lit("x".join(map(str, sizes))).alias("tile_dims"),
        F.lit(ntiles).cast("bigint").alias("ntiles"), empty.cast("bigint").alias("empty"), F.round(100.0 * empty / ntiles, 1).alias("empty_percent"),
    )


def imbalance(seconds: list[float]) -> tuple[float, float, float]:
    """(average, most, percent by which the most exceeds the average, of the most) of task times."""
    most, average = max(seconds, default=0.0), sum(seconds) / max(1, len(seconds))
    return average, most, 100.0 * (most - average) / most if most else 0.0


def task_times(df: DataFrame) -> list[float]:
    """Seconds that each task of a plan's last stage spends on its rows, measured in the tasks."""

    def run(batches):
        began = time.perf_counter()
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([time.perf_counter() - began])], ["s"])

    return [r["s"] for r in df.mapInArrow(run, "s double").collect()]


class Timers:
    """Named wall-clock timers."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def time(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> str:
        return "\n".join(f"{name:<20}{s:9.3f}s" for name, s in self.seconds.items())


def sweep(tensor: SparseTensor, plans: list[str], partitions: list[int], rank: int = 10, iterations: int = 5) -> list[tuple[str, int, int, float]]:
    """(plan, partitions, mode, seconds per product) for each number of partitions, the tensor cut into so many."""
    out = []
    for n in partitions:
        cut = tensor.with_df(tensor.df.repartition(n))
        out += [(plan, n, mode, s) for plan, mode, s in bench(cut, plans, rank, iterations)]
    return out


def bench(tensor: SparseTensor, plans: list[str], rank: int = 10, iterations: int = 5, sink: Callable[[str, int, DataFrame], None] | None = None) -> list[tuple[str, int, float]]:
    """(plan, mode, seconds per product), averaged over iterations; ``sink`` may take the products."""
    unknown = [p for p in plans if p not in kernels.PLANS]
    if unknown:
        raise TensorError(f"no such plan: {', '.join(unknown)}")
    spark = tensor.df.sparkSession
    x = tensor.materialize()
    factors = [affine_factor(spark, d, m, rank) for m, d in enumerate(x.dims)]
    out = []
    for plan in plans:
        for mode in range(x.nmodes):
            began = time.perf_counter()
            for _ in range(iterations):
                product = kernels.mttkrp(x, factors, mode, rank, plan=plan)
                product.write.format("noop").mode("overwrite").save()
            out.append((plan, mode, (time.perf_counter() - began) / iterations))
            if sink:
                sink(plan, mode, product)
    return out
