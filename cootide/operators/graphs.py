"""Graphs and hypergraphs of a tensor. A vertex of the graph is an index of a mode, numbered after all earlier modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cootide.core import SparseTensor, TensorError
from cootide.functions import ranking

from . import structure


def offsets(dims: list[int]) -> list[int]:
    """First vertex of each mode, and the number of vertices at the end."""
    return [sum(dims[:m]) for m in range(len(dims) + 1)]


def partite_edges(tensor: SparseTensor) -> DataFrame:
    """u, v, w in both directions: how many nonzeros hold both indices, for every pair of modes.

    All pairs of a nonzero come from one pass; equal pairs are combined before the exchange.
    """
    at = offsets(tensor.dims)
    pairs = [F.struct((F.col(f"i{a}") + at[a]).alias("u"), (F.col(f"i{b}") + at[b]).alias("v")) for a in range(tensor.nmodes) for b in range(tensor.nmodes) if a < b]
    once = tensor.df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.u", "p.v").agg(F.count(F.lit(1)).alias("w"))
    return once.select(F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))).alias("e")).select("e.*")


def vertex_weights(tensor: SparseTensor) -> DataFrame:
    """v, mode, i, w: nonzeros of every index of every mode."""
    at = offsets(tensor.dims)
    parts = [tensor.histogram(m).select((F.col("i") + at[m]).alias("v"), F.lit(m).alias("mode"), "i", F.col("nnz").alias("w")) for m in range(tensor.nmodes)]
    return reduce(DataFrame.unionByName, parts)


def degrees(edges: DataFrame) -> DataFrame:
    """u, degree, weight of vertices with edges."""
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))


def nonzero_pins(tensor: SparseTensor) -> DataFrame:
    """hedge, vtx: vertices are nonzeros in coordinate order, hyperedges are the slices of all modes."""
    at = offsets(tensor.dims)
    ids = ranking.global_rank(tensor.df.select(*tensor.modes), tensor.modes, "vtx")
    return ids.select(F.explode(F.array(*[F.col(f"i{m}") + at[m] for m in range(tensor.nmodes)])).alias("hedge"), "vtx")


def fiber_pins(tensor: SparseTensor, mode: int) -> DataFrame:
    """hedge, vtx: vertices are the fibers of a mode in order; a slice, a fiber coordinate and each index along the
    fibers are hyperedges, numbered in the fiber mode order. A fiber is a pin of an index once per nonzero there."""
    order = structure.fiber_order(tensor.dims, mode)
    at = offsets([tensor.dims[m] for m in order])
    names = ["s", *[f"f{k}" for k in range(len(order) - 2)]]
    f = structure.fibers(tensor, mode)
    above = f.select(F.explode(F.array(*[F.col(c) + at[k] for k, c in enumerate(names)])).alias("hedge"), F.col("fiber").alias("vtx"))
    x = tensor.df.select(*[F.col(f"i{m}").alias(c) for m, c in zip(order, names)], F.col(f"i{order[-1]}").alias("leaf"))
    below = x.join(f.select(*names, "fiber"), names).select((F.col("leaf") + at[len(order) - 1]).alias("hedge"), F.col("fiber").alias("vtx"))
    return above.unionByName(below)


def uncut_hyperedges(pins: DataFrame, parts: DataFrame, n_hedges: int) -> DataFrame:
    """hedge of every hyperedge whose pins lie in one part (vtx, part); an empty hyperedge is uncut."""
    every = pins.sparkSession.range(n_hedges).withColumnRenamed("id", "hedge")
    cut = pins.join(parts, "vtx").groupBy("hedge").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("hedge")
    return every.join(cut, "hedge", "left_anti")


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row cut: total weight of edges between different parts (v, part), each edge once."""
    a, b = (parts.select(F.col("v").alias(c), F.col("part").alias(f"p{c}")) for c in ("u", "v"))
    return edges.join(a, "u").join(b, "v").agg(F.floor(F.coalesce(F.sum(F.when(F.col("pu") != F.col("pv"), F.col("w"))), F.lit(0)) / 2).cast("long").alias("cut"))


def partition_vertices(vertices: DataFrame, parts: int, method: str = "hash") -> DataFrame:
    """v, part of vertices (v, w): by hash, by ranges of equal number, or by ranges of equal weight."""
    if method == "hash":
        return vertices.select("v", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("part"))
    if method == "range":
        n = vertices.count()
        return ranking.global_rank(vertices.select("v"), ["v"], "r").select("v", F.floor(F.col("r") * parts / F.lit(max(n, 1))).cast("int").alias("part"))
    if method == "weighted":
        total = vertices.agg(F.sum("w")).first()[0] or 1
        x = ranking.running_sum(vertices.select("v", "w"), ["v"], "w", "before")
        return x.select("v", F.least(F.floor(F.col("before") * parts / F.lit(total)), F.lit(parts - 1)).cast("int").alias("part"))
    raise TensorError(f"unknown partition method {method!r}")


def graph_words(edges: DataFrame) -> DataFrame:
    """v, at, word of the adjacency text form: 1-based neighbour and weight for every edge of a vertex, in order of ``at``."""
    return edges.select(F.col("u").alias("v"), F.col("v").alias("at"), F.concat((F.col("v") + 1).cast("string"), F.lit(" "), F.col("w").cast("string"), F.lit(" ")).alias("word"))


def hypergraph_words(pins: DataFrame) -> DataFrame:
    """hedge, at, word: 1-based pins of every hyperedge, in order of ``at``."""
    return pins.select("hedge", F.col("vtx").alias("at"), F.concat((F.col("vtx") + 1).cast("string"), F.lit(" ")).alias("word"))
