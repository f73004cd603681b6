"""Permutations of modes: (old, new) per mode, their inverses, and relabelling by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cootide.core import SparseTensor, TensorError
from cootide.functions import ranking

from . import graphs, structure


def identity(tensor: SparseTensor, mode: int) -> DataFrame:
    return tensor.df.sparkSession.range(tensor.dims[mode]).select(F.col("id").alias("old"), F.col("id").alias("new"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def random_permutation(tensor: SparseTensor, mode: int, seed: int = 0) -> DataFrame:
    """A uniform permutation that depends on the seed and mode alone."""
    ids = tensor.df.sparkSession.range(tensor.dims[mode]).select(F.col("id").alias("old"), F.xxhash64(F.lit(seed), F.lit(mode), "id").alias("h"))
    return ranking.global_rank(ids, ["h", "old"], "new").select("old", "new")


def by_graph_parts(tensor: SparseTensor, parts: DataFrame) -> dict[int, DataFrame]:
    """Per mode the order of (part, vertex), parts being (v, part) of the graph's vertices."""
    at = graphs.offsets(tensor.dims)
    out = {}
    for m in range(tensor.nmodes):
        mine = parts.where((F.col("v") >= at[m]) & (F.col("v") < at[m + 1])).select((F.col("v") - at[m]).alias("old"), "part")
        out[m] = ranking.global_rank(mine, ["part", "old"], "new").select("old", "new")
    return out


def by_fiber_parts(tensor: SparseTensor, parts: DataFrame, mode: int) -> dict[int, DataFrame]:
    """Per mode the order in which ids are first met when fibers are visited by (part, fiber); unmet ids come last.

    parts: (vtx, part) of the fibers of ``mode``. Within a fiber its nonzeros are visited in ascending index.
    """
    order = structure.fiber_order(tensor.dims, mode)
    names = ["s", *[f"f{k}" for k in range(len(order) - 2)]]
    f = structure.fibers(tensor, mode).join(parts.select(F.col("vtx").alias("fiber"), "part"), "fiber")
    leaf = tensor.df.select(*[F.col(f"i{m}").alias(c) for m, c in zip(order, names)], F.col(f"i{order[-1]}").alias("id"))
    out = {}
    for k, m in enumerate(order):
        if k < len(order) - 1:
            met = f.groupBy(F.col(names[k]).alias("old")).agg(F.min(F.struct("part", "fiber", F.lit(0).cast("long").alias("at"))).alias("first"))
        else:
            met = leaf.join(f.select(*names, "part", "fiber"), names).groupBy(F.col("id").alias("old")).agg(F.min(F.struct("part", "fiber", F.col("id").alias("at"))).alias("first"))
        every = tensor.df.sparkSession.range(tensor.dims[m]).withColumnRenamed("id", "old").join(met, "old", "left")
        flat = every.select("old", F.col("first").isNull().alias("unmet"), "first.part", "first.fiber", "first.at")
        out[m] = ranking.global_rank(flat, ["unmet", "part", "fiber", "at", "old"], "new").select("old", "new")
    return out


def apply(tensor: SparseTensor, perms: dict[int, DataFrame]) -> SparseTensor:
    """Relabel the modes given by (old, new); Spark broadcasts a permutation only below its own threshold."""
    df = tensor.df
    for m, perm in perms.items():
        c = f"i{m}"
        df = df.join(perm.select(F.col("old").alias(c), F.col("new").alias("_new")), c).drop(c).withColumnRenamed("_new", c)
    return tensor.with_df(df)


def apply_rows(matrix: DataFrame, perm: DataFrame) -> DataFrame:
    """Relabel the rows (i, row) of a matrix."""
    return matrix.join(perm.select(F.col("old").alias("i"), "new"), "i").select(F.col("new").alias("i"), "row")


def reorder(tensor: SparseTensor, kind: str, *, seed: int = 0, parts: DataFrame | None = None, mode: int = 0) -> tuple[SparseTensor, dict[int, DataFrame]]:
    """The relabelled tensor and its permutations: kind random, graph or hgraph; the latter two need parts."""
    if kind == "random":
        perms = {m: random_permutation(tensor, m, seed) for m in range(tensor.nmodes)}
    elif kind in ("graph", "hgraph"):
        if parts is None:
            raise TensorError(f"reordering by {kind} needs a partition")
        perms = by_graph_parts(tensor, parts) if kind == "graph" else by_fiber_parts(tensor, parts, mode)
    else:
        raise TensorError(f"unknown reordering {kind!r}")
    return apply(tensor, perms), perms
