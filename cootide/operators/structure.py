"""Structure of a tensor: mode orders, levels of the compressed fiber tree, fibers, tiles and slabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cootide.core import SparseTensor, TensorError
from cootide.functions import radix, ranking
from cootide.session import materialize, release

# Bytes of an index, of a value and of one tile's header in the storage formula; rows of a slab, and
# fibers and indices of a tile.
INDEX_BYTES, VALUE_BYTES, TILE_BYTES = 8, 8, 200
SLAB_SLICES, TUBE_FIBERS, TILE_INDICES = 32, 1024, 1024


def mode_order(dims: list[int], policy: str = "small_first", mode: int = 0, custom: list[int] | None = None) -> list[int]:
    """Order of modes by a policy: small_first, big_first, in_order_minus_one (``mode`` first, others as they come),
    sorted_minus_one (``mode`` first, others by size) or custom. Equal dims keep the order of modes."""
    modes = list(range(len(dims)))
    small = sorted(modes, key=lambda m: (dims[m], m))
    if policy == "small_first":
        return small
    if policy == "big_first":
        return sorted(modes, key=lambda m: (-dims[m], m))
    if policy == "in_order_minus_one":
        return [mode, *(m for m in modes if m != mode)]
    if policy == "sorted_minus_one":
        return [mode, *(m for m in small if m != mode)]
    if policy == "custom" and custom is not None and sorted(custom) == modes:
        return list(custom)
    raise TensorError(f"unknown mode order {policy!r}")


def inverse_order(order: list[int]) -> list[int]:
    """Depth of each mode in an order."""
    return [order.index(m) for m in range(len(order))]


def fiber_order(dims: list[int], mode: int) -> list[int]:
    """``mode`` first, the others after it in circular order, then the longest of the others moved last."""
    order = [(mode + k) % len(dims) for k in range(len(dims))]
    rest = order[1:]
    longest = max(rest, key=lambda m: dims[m])
    return [order[0], *(m for m in rest if m != longest), longest]


def tree_orders(dims: list[int], copies: str = "two") -> list[list[int]]:
    """Mode orders of the kept copies: one (smallest first), two (that, and one rooted at its last mode) or all."""
    small = mode_order(dims)
    if copies == "one":
        return [small]
    if copies == "two":
        return [small] if len(dims) < 2 else [small, mode_order(dims, "sorted_minus_one", small[-1])]
    if copies == "all":
        return [mode_order(dims, "sorted_minus_one", m) for m in range(len(dims))]
    raise TensorError(f"unknown number of copies {copies!r}")


def level_counts(tensor: SparseTensor, order: list[int]) -> DataFrame:
    """depth, nfibs: distinct prefixes per level of the fiber tree; the leaf level counts nonzeros, repeats included.

    Prefixes are counted from the longest down, each level once, from the written distinct prefixes of the one below it.
    """
    names = [f"i{m}" for m in order]
    counts = []
    below = tensor.df.select(*names[:-1], F.lit(1).cast("long").alias("n")) if len(order) > 1 else None
    if below is None:
        return tensor.df.agg(F.count(F.lit(1)).alias("nfibs")).select(F.lit(0).alias("depth"), "nfibs")
    for d in range(len(order) - 2, -1, -1):
        level = materialize(below.groupBy(*names[: d + 1]).agg(F.sum("n").alias("n")))
        if d < len(order) - 2:
            release(below)
        r = level.agg(F.count(F.lit(1)).alias("nfibs"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz")).first()
        counts.append((d, r["nfibs"]))
        below = level
    release(below)
    return tensor.df.sparkSession.createDataFrame([(len(order) - 1, r["nnz"]), *counts], "depth int, nfibs bigint")


def level_nodes(tensor: SparseTensor, order: list[int], depth: int) -> DataFrame:
    """Nodes of a level: prefix columns p0.., fid, children, fptr (first child) and position, in prefix order.

    Children of a node of the last inner level are its nonzeros.
    """
    if not 0 <= depth < len(order) - 1:
        raise TensorError("the leaf level has no nodes of its own")
    cols = [F.col(f"i{m}").alias(f"p{k}") for k, m in enumerate(order)]
    x = tensor.df.select(*cols)
    names = [f"p{k}" for k in range(depth + 1)]
    if depth < len(order) - 2:
        x = x.select(*names, f"p{depth + 1}").distinct()
    nodes = x.groupBy(*names).agg(F.count(F.lit(1)).alias("children"))
    out = ranking.global_rank(ranking.running_sum(nodes, names, "children", "fptr"), names, "position")
    return out.select(*names, F.col(f"p{depth}").alias("fid"), "children", "fptr", "position")


def tree_bytes(nfibs: list[int], nnz: int, root_is_full: bool, tiles: int = 1) -> int:
    """Bytes of one untiled copy: values and leaf ids, tile headers, pointers of inner levels and their ids; the ids of
    a root without gaps are left out."""
    total = nnz * (INDEX_BYTES + VALUE_BYTES) + tiles * TILE_BYTES
    for depth, n in enumerate(nfibs[:-1]):
        total += (n + 1) * INDEX_BYTES
        if depth or not root_is_full:
            total += n * INDEX_BYTES
    return total


def tree_storage(tensor: SparseTensor, order: list[int]) -> int:
    """Bytes of the compressed form in that mode order."""
    counts = {r["depth"]: r["nfibs"] for r in level_counts(tensor, order).collect()}
    nfibs = [counts[d] for d in range(len(order))]
    return tree_bytes(nfibs, nfibs[-1], nfibs[0] == tensor.dims[order[0]])


def fibers(tensor: SparseTensor, mode: int) -> DataFrame:
    """Fibers of the tensor seen from a mode, in order: s (slice), f0.. (fiber coordinates), nnz, fiber (position).

    The fiber runs along the longest other mode.
    """
    order = fiber_order(tensor.dims, mode)
    cols = [F.col(f"i{order[0]}").alias("s"), *[F.col(f"i{m}").alias(f"f{k}") for k, m in enumerate(order[1:-1])]]
    names = ["s", *[f"f{k}" for k in range(len(order) - 2)]]
    return ranking.global_rank(tensor.df.select(*cols).groupBy(*names).agg(F.count(F.lit(1)).alias("nnz")), names, "fiber")


def fiber_matrix(tensor: SparseTensor, mode: int) -> DataFrame:
    """row, col, val: fibers of ``fibers`` as rows, the longest other mode as columns; fibers are numbered in order."""
    order = fiber_order(tensor.dims, mode)
    names = ["s", *[f"f{k}" for k in range(len(order) - 2)]]
    x = tensor.df.select(*[F.col(f"i{m}").alias(c) for m, c in zip(order, names)], F.col(f"i{order[-1]}").alias("col"), "val")
    return x.join(fibers(tensor, mode).select(*names, F.col("fiber").alias("row")), names).select("row", "col", "val")


def fiber_pointers(tensor: SparseTensor, mode: int) -> DataFrame:
    """fiber, start: the first nonzero of every fiber in the order of the fiber form."""
    return ranking.running_sum(fibers(tensor, mode).select("fiber", "nnz"), ["fiber"], "nnz", "start").select("fiber", "start")


def slice_pointers(tensor: SparseTensor, mode: int) -> DataFrame:
    """s, fibers, start: of every slice, empty ones included, its fibers and the first of them."""
    per = fibers(tensor, mode).groupBy("s").agg(F.count(F.lit(1)).alias("fibers"))
    every = tensor.df.sparkSession.range(tensor.dims[mode]).withColumnRenamed("id", "s").join(per, "s", "left")
    return ranking.running_sum(every.select("s", F.coalesce("fibers", F.lit(0)).alias("fibers")), ["s"], "fibers", "start")


def slab_pointers(tensor: SparseTensor, mode: int, slices: int = SLAB_SLICES) -> DataFrame:
    """slab, fibers, start: of every slab of consecutive slices, empty ones included, its fibers and the first of them."""
    per = fibers(tensor, mode).groupBy(F.floor(F.col("s") / slices).cast("long").alias("slab")).agg(F.count(F.lit(1)).alias("fibers"))
    every = tensor.df.sparkSession.range(-(-tensor.dims[mode] // slices)).withColumnRenamed("id", "slab").join(per, "slab", "left")
    return ranking.running_sum(every.select("slab", F.coalesce("fibers", F.lit(0)).alias("fibers")), ["slab"], "fibers", "start")


def fiber_storage(tensor: SparseTensor, mode: int, slabs: bool = False) -> int:
    """Bytes of the fiber form: leaf ids and values, pointers and ids of fibers, and the pointers of all slices, or with
    ``slabs`` those of the slabs and the slice of every fiber."""
    order = fiber_order(tensor.dims, mode)
    r = tensor.df.groupBy(*[f"i{m}" for m in order[:-1]]).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("nfibs"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz")).first()
    size = r["nnz"] * (INDEX_BYTES + VALUE_BYTES) + (r["nfibs"] + 1) * INDEX_BYTES + r["nfibs"] * INDEX_BYTES
    if slabs:
        return size + (-(-tensor.dims[mode] // SLAB_SLICES) + 1) * INDEX_BYTES + r["nfibs"] * INDEX_BYTES
    return size + (tensor.dims[mode] + 1) * INDEX_BYTES


# -- tiles ----------------------------------------------------------------------------------------------------------


def tile_coordinate(column: Column, dim: int, tiles: int) -> Column:
    """Tile of an index along one mode: tiles of dim div tiles indices, the last takes the rest."""
    size = max(dim // tiles, 1)
    return F.least(F.floor(column / size).cast("long"), F.lit(tiles - 1).cast("long"))


def with_tiles(tensor: SparseTensor, tiles: list[int], modes: list[int] | None = None) -> DataFrame:
    """Nonzeros with their dense tile id; ``modes`` (all by default) are tiled, the others are not cut."""
    modes = list(range(tensor.nmodes)) if modes is None else modes
    cuts = [tiles[m] if m in modes else 1 for m in range(tensor.nmodes)]
    ids = radix.encode([tile_coordinate(F.col(f"i{m}"), d, c) for m, (d, c) in enumerate(zip(tensor.dims, cuts))], cuts)
    return tensor.df.withColumn("tile", ids)


def tile_pointers(tensor: SparseTensor, tiles: list[int]) -> DataFrame:
    """tile, nnz, start of every tile, empty ones included."""
    counts = with_tiles(tensor, tiles).groupBy("tile").agg(F.count(F.lit(1)).alias("nnz"))
    every = tensor.df.sparkSession.range(radix.checked_product(tiles)).withColumnRenamed("id", "tile")
    full = every.join(counts, "tile", "left").select("tile", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return ranking.running_sum(full, ["tile"], "nnz", "start")


def deep_tiles(tensor: SparseTensor, order: list[int], tiles_per_mode: int, levels: int) -> DataFrame:
    """Nonzeros with the tile of the bottom ``levels`` levels of a mode order, each cut into ``tiles_per_mode``."""
    return with_tiles(tensor, [tiles_per_mode] * tensor.nmodes, order[len(order) - levels :])


def slab_tiles(tensor: SparseTensor, order: list[int], slices: int = SLAB_SLICES, fibers_per_tube: int = TUBE_FIBERS, indices_per_tile: int = TILE_INDICES) -> DataFrame:
    """Nonzeros with slab, tube and tile: slabs of consecutive slices; within a slab the used ids of the second and of
    the third mode of ``order`` are ranked, and cut into tubes and tiles of so many ids.

    Ranks are taken over each slab's distinct ids, not over its nonzeros.
    """
    slab = F.floor(F.col(f"i{order[0]}") / slices).cast("long").alias("slab")
    x = tensor.df.select("*", slab)
    for mode, size, name in ((order[1], fibers_per_tube, "tube"), (order[2], indices_per_tile, "tile")):
        w = Window.partitionBy("slab").orderBy(f"i{mode}")
        ids = x.select("slab", f"i{mode}").distinct().select("slab", f"i{mode}", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias(name))
        x = x.join(ids, ["slab", f"i{mode}"])
    return x.select(*tensor.modes, "val", "slab", "tube", "tile")
