"""Load-balanced partitions of index ranges and grids of partitions, with their statistics.

What runs on the driver works on the weights of a mode, up to a size all at once and beyond it block by block, never on
nonzeros.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cootide.core import SparseTensor
from cootide.functions import radix, ranking
from cootide.session import materialize

from . import structure

SMALL_MODE = 1 << 22
KEPT_BLOCKS = 256
MOST_BRANCHES = 128


def simple_bounds(items: int, parts: int) -> list[int]:
    """Bounds of contiguous parts of equal number, the last taking the rest: parts + 1 numbers."""
    per = max(items // parts, 1)
    return [0, *(min(max(per * k, 1), items) for k in range(1, parts)), items]


class Weights:
    """Prefix sums of whole weights over the indices of a mode.

    ``index`` are the indices with a weight, ascending, ``ends[k]`` the weight of all up to the k-th of them. What is asked
    for is found by bisection.
    """

    def __init__(self, dim: int, index: np.ndarray, ends: np.ndarray):
        self.dim, self.index, self.ends = dim, index, ends
        self.total = int(ends[-1]) if len(ends) else 0
        self.most = int(np.diff(ends, prepend=0).max()) if len(ends) else 0

    @classmethod
    def of(cls, weights) -> Weights:
        if isinstance(weights, Weights):
            return weights
        w = np.asarray(weights, dtype=np.int64)
        return cls(len(w), np.flatnonzero(w), np.cumsum(w[w != 0]))

    def _first(self, value: int, side: str) -> tuple[int, int, int] | None:
        """(index, its weight and all before, weight before it) of the first end of at least, or above, ``value``."""
        k = int(np.searchsorted(self.ends, value, side))
        return None if k >= len(self.ends) else (int(self.index[k]), int(self.ends[k]), int(self.ends[k - 1]) if k else 0)

    def below(self, n: int) -> int:
        """Weight of the indices below n."""
        k = int(np.searchsorted(self.index, n, "left"))
        return int(self.ends[k - 1]) if k else 0

    def expect(self, values: list[int]) -> None:
        """Tell which sums will be asked for soon."""

    def within(self, value: int) -> tuple[int, int]:
        """(n, weight): the most indices from the start that weigh at most ``value``, and their weight."""
        met = self._first(value, "right")
        return (met[0], met[2]) if met else (self.dim, self.total)

    def reaching(self, value: int) -> int:
        """The fewest indices from the start that weigh at least ``value``; more than there are if all weigh less."""
        if value <= 0:
            return 0
        met = self._first(value, "left")
        return met[0] + 1 if met else self.dim + 1


class StoredWeights(Weights):
    """``Weights`` in a table of the shared folder: the driver holds one row per block of 65,536 indices, and reads the
    blocks that bisection comes to, KEPT_BLOCKS at most at a time."""

    def __init__(self, dim: int, table: DataFrame):
        self.dim, self.table, self.held = dim, table, {}
        t = table.groupBy("block").agg(F.max("end").alias("end"), F.min("i").alias("first"), F.max("w").alias("most")).orderBy("block").toArrow()
        self.block_ends, self.block_first = t["end"].to_numpy(), t["first"].to_numpy()
        self.total = int(self.block_ends[-1]) if len(self.block_ends) else 0
        self.most = int(t["most"].to_numpy().max()) if len(self.block_ends) else 0

    def _load(self, blocks: list[int]) -> None:
        need = sorted({b for b in blocks if 0 <= b < len(self.block_ends)}.difference(self.held))
        if not need:
            return
        if len(self.held) + len(need) > KEPT_BLOCKS:
            self.held.clear()
        t = self.table.where(F.col("block").isin(need)).select("block", "i", "end").toArrow()
        block = t["block"].to_numpy()
        for b in need:
            mine = block == b
            i, end = t["i"].to_numpy()[mine], t["end"].to_numpy()[mine]
            order = np.argsort(i)
            self.held[b] = (i[order], end[order])

    def expect(self, values: list[int]) -> None:
        at = np.searchsorted(self.block_ends, np.array(values, np.int64), "right")
        self._load([int(b) + k for b in at[:KEPT_BLOCKS // 4] for k in (-1, 0, 1)])

    def _first(self, value: int, side: str) -> tuple[int, int, int] | None:
        b = int(np.searchsorted(self.block_ends, value, side))
        if b >= len(self.block_ends):
            return None
        self._load([b])
        i, end = self.held[b]
        k = int(np.searchsorted(end, value, side))
        return int(i[k]), int(end[k]), int(end[k - 1]) if k else int(self.block_ends[b - 1]) if b else 0

    def below(self, n: int) -> int:
        b = int(np.searchsorted(self.block_first, n, "left")) - 1
        if b < 0:
            return 0
        self._load([b])
        i, end = self.held[b]
        k = int(np.searchsorted(i, n, "left"))
        return int(end[k - 1]) if k else int(self.block_ends[b - 1]) if b else 0


def fits(weights: Weights, parts: int, bottleneck: int) -> list[int] | None:
    """Bounds of parts that weigh at most ``bottleneck`` each, filled greedily; None if they do not hold everything."""
    bounds, done = [0], 0
    weights.expect([bottleneck * (k + 1) for k in range(parts)])
    for _ in range(parts):
        at, done = weights.within(done + bottleneck)
        bounds.append(max(at, bounds[-1]))
        if at >= weights.dim:
            return bounds + [weights.dim] * (parts + 1 - len(bounds))
    return None


def weighted_bounds(weights, parts: int) -> tuple[list[int], int]:
    """(bounds, bottleneck) of the contiguous partition of whole weights with the least heaviest part.

    ``weights`` is an array or ``Weights``.
    """
    w = Weights.of(weights)
    if not w.dim:
        return [0] * (parts + 1), 0
    if w.dim <= parts:
        return [*range(w.dim + 1), *[w.dim] * (parts - w.dim)], w.most
    low, high = max(w.most, -(-w.total // parts)), w.total
    while low < high:
        middle = (low + high) // 2
        if fits(w, parts, middle) is None:
            low = middle + 1
        else:
            high = middle
    return fits(w, parts, low), low


def mode_weights(tensor: SparseTensor, mode: int) -> Weights:
    """Nonzeros of every index of a mode, on the driver for modes of up to SMALL_MODE indices, else in a table of the
    shared folder of which the driver reads what it needs."""
    if tensor.dims[mode] <= SMALL_MODE:
        t = tensor.slices(mode).toArrow().sort_by("i")
        return Weights(tensor.dims[mode], t["i"].to_numpy(), np.cumsum(t["nnz"].to_numpy()))
    x = ranking.running_sum(tensor.slices(mode), ["i"], "nnz", "before", "block")
    x = x.select("block", "i", (F.col("before") + F.col("nnz")).alias("end"), F.col("nnz").alias("w"))
    return StoredWeights(tensor.dims[mode], materialize(x.repartitionByRange("block").sortWithinPartitions("block")))


def tree_partition(tensor: SparseTensor, order: list[int], parts: int) -> tuple[list[int], int]:
    """(bounds, bottleneck) of the roots of a mode order in contiguous parts by the nonzeros below them."""
    return weighted_bounds(mode_weights(tensor, order[0]), parts)


def tile_partition(tensor: SparseTensor, tiles: list[int], parts: int) -> tuple[list[int], int]:
    """(bounds, bottleneck) of the dense tiles, empty ones included, in contiguous parts by their nonzeros."""
    n = radix.checked_product(tiles)
    counts = structure.with_tiles(tensor, tiles).groupBy(F.col("tile").alias("i0")).agg(F.count(F.lit(1)).alias("val"))
    t = counts.select("i0", "val").toArrow().sort_by("i0")  # a row per used tile
    return weighted_bounds(Weights(n, t["i0"].to_numpy(), np.cumsum(t["val"].to_numpy())), parts)


def part_of(column: Column, bounds: list[int]) -> Column:
    """Part of an index by ascending bounds: a tree of comparisons, so an index meets as many as bisection needs; its leaves
    are short lists where bounds are too many for one expression."""
    inner = list(bounds[1:-1])
    leaf = len(inner) // MOST_BRANCHES

    def tree(low: int, high: int) -> Column:
        """How many of the inner bounds are at most the index, all before ``low`` and none from ``high`` on."""
        if high - low <= leaf:
            some = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in inner[low:high]]), lambda b: b <= column)) if high > low else F.lit(0)
            return F.lit(low).cast("long") + some.cast("long")
        middle = (low + high) // 2
        return F.when(column < inner[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(inner))


def layer_bounds(weights, layers: int) -> list[int]:
    """Contiguous layers of about equal weight by one greedy scan.

    A layer ends at the first index at which the weight before it reaches the target. The weight counted as done is that
    before the index or before the one preceding it, whichever is nearer the target; the target of the next layers is an
    equal share of what is then left. Layers that find no end are empty and lie at the end of the mode.
    """
    w = Weights.of(weights)
    bounds, done, target, at = [0], 0, w.total // layers, 1
    w.expect([target * (k + 1) for k in range(layers)])
    while len(bounds) < layers:
        at = max(at, w.reaching(done + target))
        if at >= w.dim:
            break
        here, previous = w.below(at), w.below(at - 1)
        over, under = here - (done + target), (done + target) - previous
        done = previous if 0 <= under < over else here
        bounds.append(at)
        target = (w.total - done) // max(1, layers - len(bounds) + 1)
        at += 1
    return bounds + [w.dim] * (layers + 1 - len(bounds))


def primes_of(n: int) -> list[int]:
    """Prime factors, ascending."""
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1 if p * p <= n or p == 2 else max(1, n - p)
    return out


def grid_dims(dims: list[int], parts: int) -> list[int]:
    """Parts per mode of a grid: prime factors, largest first, each go to the mode whose cut dim exceeds the even
    share (sum of dims / parts) most; the first of equals."""
    grid, target = [1] * len(dims), sum(dims) // parts
    for p in reversed(primes_of(parts)):
        excess = [max(0, d // g - target) for d, g in zip(dims, grid)]
        grid[excess.index(max(excess))] *= p
    return grid


def grid_parts(tensor: SparseTensor, grid: list[int], bounds: dict[int, list[int]] | None = None) -> DataFrame:
    """Nonzeros with the grid cell that owns them: the layer per mode, coded with the last mode fastest."""
    bounds = bounds or {m: layer_bounds(mode_weights(tensor, m), g) for m, g in enumerate(grid)}
    return tensor.df.withColumn("part", radix.encode([part_of(F.col(f"i{m}"), bounds[m]) for m in range(tensor.nmodes)], grid))


def distribute(df: DataFrame, parts: int) -> DataFrame:
    """Rows with a whole number ``part`` in as many Spark partitions, one each."""
    return df.repartitionById(parts, F.col("part").cast("int"))


def coarse_owners(tensor: SparseTensor, parts: int) -> DataFrame:
    """Nonzeros copied to every part that owns one of their slices; slices of each mode are cut by weight."""
    owners = [part_of(F.col(f"i{m}"), layer_bounds(mode_weights(tensor, m), parts)) for m in range(tensor.nmodes)]
    return tensor.df.withColumn("part", F.explode(F.array_distinct(F.array(*owners))))


def fine_parts(numbered: DataFrame, parts: DataFrame) -> DataFrame:
    """Nonzeros with an ``id`` get the part of a partition (id, part)."""
    return numbered.join(parts, "id")


def part_stats(df: DataFrame) -> DataFrame:
    """part, nnz and the distinct indices per mode of nonzeros with a part."""
    return _distinct_per_part(df, [c for c in df.columns if c[0] == "i" and c[1:].isdigit()])


def _distinct_per_part(df: DataFrame, columns: list[str]) -> DataFrame:
    """part, nnz and per column the distinct values: (part, column, value) is made distinct first, then counted, so that
    a row is not copied per column through the exchange of a whole part."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("long").alias("v")) for k, c in enumerate(columns)])).alias("e")
    met = df.select("part", pairs).groupBy("part", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    counts = [F.count_if(F.col("k") == k).alias(f"n_{c.removeprefix('_')}") for k, c in enumerate(columns)]
    return met.groupBy("part").agg(F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("nnz"), *counts)


def balance(df: DataFrame) -> DataFrame:
    """parts, lightest, heaviest, average and imbalance in percent of the heaviest."""
    per = df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    x = per.agg(F.count(F.lit(1)).alias("parts"), F.min("n").alias("lightest"), F.max("n").alias("heaviest"), F.avg("n").alias("average"))
    return x.withColumn("imbalance", 100 * (F.col("heaviest") - F.col("average")) / F.col("heaviest"))


def _used(df: DataFrame, modes: list[str]) -> DataFrame:
    """mode, i, part: which parts use which rows of the factors."""
    each = F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("mode"), F.col(c).alias("i")) for c in modes])).alias("e")
    return df.select(each, "part").select("e.mode", "e.i", "part").distinct()


def communication_volume(df: DataFrame, modes: list[str], layers: dict[int, int] | None = None) -> DataFrame:
    """part, volume: factor rows a part needs from others. The owner of a row is the smallest part that uses it.

    With ``layers`` (mode -> number of layers of a grid) rows of modes in more than one layer count twice: they are
    sent and received within a layer, and the others are not sent back.
    """
    used = _used(df, modes)
    owner = used.groupBy("mode", "i").agg(F.min("part").alias("owner"))
    times = F.lit(1)
    for m, n in (layers or {}).items():
        if n > 1:
            times = F.when(F.col("mode") == m, 2).otherwise(times)
    foreign = F.when(F.col("part") != F.col("owner"), times).otherwise(0)
    return used.join(owner, ["mode", "i"]).groupBy("part").agg(F.sum(foreign.cast("long")).alias("volume"))


def claim_rows(df: DataFrame, modes: list[str], parts: int, rounds: int = 8) -> DataFrame:
    """mode, i, owner: every used factor row gets an owner among the parts that use it, so that few rows travel and owned
    rows are balanced.

    A row used by one part is that part's. The others are claimed in rounds: each round offers an equal share of each
    mode's contested rows to the user of the row that owns fewest rows so far, ties by a hash of row and part; the last
    takes what is left. Only the rows owned per part and mode are on the driver. Which rows are offered in a round
    depends on a hash of the row alone, so the result depends on no partitioning.
    """
    used = materialize(_used(df, modes).withColumn("turn", F.pmod(F.xxhash64("mode", "i"), F.lit(rounds)).cast("int")))
    users = materialize(used.groupBy("mode", "i", "turn").agg(F.count(F.lit(1)).alias("users"), F.min("part").alias("owner")))
    out = [materialize(users.where("users = 1").select("mode", "i", "owner"))]
    contested = users.where("users > 1").select("mode", "i", "turn")
    held: dict[tuple[int, int], int] = {}
    for k in range(rounds):
        for r in out[-1].groupBy("mode", F.col("owner").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect():
            held[r["mode"], r["part"]] = held.get((r["mode"], r["part"]), 0) + r["n"]
        loads = F.broadcast(df.sparkSession.createDataFrame([(int(c[1:]), p, held.get((int(c[1:]), p), 0)) for c in modes for p in range(parts)], "mode int, part long, load long"))
        offers = used.where(F.col("turn") == k).join(contested.where(F.col("turn") == k), ["mode", "i", "turn"]).join(loads, ["mode", "part"])
        best = offers.groupBy("mode", "i").agg(F.min_by("part", F.struct("load", F.xxhash64("mode", "i", "part").alias("h"), "part")).alias("owner"))
        out.append(materialize(best.select("mode", "i", "owner")))
    return reduce(DataFrame.unionByName, out)


def owned_rows(owners: DataFrame, df: DataFrame, modes: list[str]) -> DataFrame:
    """part, mode, owned, sent: factor rows a part owns, and how many copies of them other parts need."""
    used = _used(df, modes).join(owners, ["mode", "i"])
    need = F.count_if(F.col("part") != F.col("owner"))
    return used.groupBy(F.col("owner").alias("part"), "mode").agg(F.count_if(F.col("part") == F.col("owner")).alias("owned"), need.alias("sent"))


def fiber_part_stats(tensor: SparseTensor, parts: DataFrame, mode: int) -> DataFrame:
    """Per part of a fiber partition (vtx, part): fibers, nonzeros and distinct slices, fiber and leaf indices."""
    order = structure.fiber_order(tensor.dims, mode)
    names = ["s", *[f"f{k}" for k in range(len(order) - 2)]]
    f = structure.fibers(tensor, mode).join(parts.select(F.col("vtx").alias("fiber"), "part"), "fiber")
    x = tensor.df.select(*[F.col(f"i{m}").alias(c) for m, c in zip(order, names)], F.col(f"i{order[-1]}").alias("leaf")).join(f.select(*names, "fiber", "part"), names)
    return _distinct_per_part(x, [*names, "leaf", "fiber"]).withColumnRenamed("n_fiber", "fibers")
