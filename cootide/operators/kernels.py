"""Matricized tensor times Khatri-Rao product, in several plans with equal results.

M[i, r] = sum over nonzeros with i_m = i of val * product over the other modes k of A_k[i_k, r]. A factor matrix is a
DataFrame (i BIGINT, row ARRAY<DOUBLE>). Rows without nonzeros are absent, which stands for zero; ``dense=True`` adds them.

Plans: ``wide`` joins arrays and keeps one sum per column, all in generated code (the default); ``blocked`` does so for
slices of the columns where they are too many for one; ``long`` joins
(i, r, v) triples; ``fiber`` sums the last mode first and multiplies each fiber's factor row once, worth it when fibers
hold several nonzeros; ``unfold`` joins through the decoded columns of the matricised tensor; ``arrow`` holds factors of
checked size as NumPy arrays in the tasks, for large ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from cootide.core import SparseTensor, TensorError
from cootide.functions import radix
from cootide.session import materialize

BROADCAST_BYTES = 64 << 20
WIDE_RANK = 48
PACKED_NONZEROS = 1 << 20
HELD_NONZEROS = 1 << 17  # a tensor of so few is passed over by the driver: a job would take longer
PLANS = ("auto", "wide", "blocked", "long", "fiber", "unfold", "arrow")
# Fixed value: sums are kept per task if a mode has at most this share of indices per nonzero and task.
PRIVATE_SHARE = 0.02


def factor_bytes(dim: int, rank: int) -> int:
    return dim * (rank * 8 + 32)


def _side(factor: DataFrame, dim: int, rank: int) -> DataFrame:
    """Broadcast a factor only if its dim and rank prove it small; else Spark chooses a shuffled join."""
    return F.broadcast(factor) if factor_bytes(dim, rank) <= BROADCAST_BYTES else factor


def _others(tensor: SparseTensor, mode: int) -> list[int]:
    """The other modes, smallest first: small factors join first."""
    return sorted((m for m in range(tensor.nmodes) if m != mode), key=lambda m: (tensor.dims[m], m))


def _joined(df: DataFrame, tensor: SparseTensor, modes: list[int], factors: dict[int, DataFrame], rank: int) -> DataFrame:
    for k in modes:
        side = factors[k].select(F.col("i").alias(f"i{k}"), F.col("row").alias(f"a{k}"))
        df = df.join(_side(side, tensor.dims[k], rank), f"i{k}")
    return df


def choose_plan(dims: list[int], mode: int, rank: int, nnz: int | None = None, fibers: int | None = None) -> str:
    """The plan of a product: ``fiber`` where it is known that fibers hold three nonzeros or more on average, so that
    summing them first saves most joins; else ``wide``, up to the rank whose sums fit generated code; beyond, ``arrow`` for
    factors of checked size, and ``blocked`` for others."""
    if nnz and fibers and nnz >= 3 * fibers and rank <= WIDE_RANK:
        return "fiber"
    if rank <= WIDE_RANK:
        return "wide"
    small = sum(factor_bytes(d, rank) for m, d in enumerate(dims) if m != mode) <= BROADCAST_BYTES
    return "arrow" if small else "blocked"


def is_private(dim: int, nnz: int, tasks: int) -> bool:
    """Whether every task may keep its own sums of a whole mode: they are few beside the nonzeros."""
    return tasks > 1 and dim * tasks <= PRIVATE_SHARE * nnz


def _sums(value: Column, arrays: list[str], rank: int) -> list[Column]:
    out = []
    for r in range(rank):
        term = value
        for a in arrays:
            term = term * F.col(a)[r]
        out.append(F.sum(term).alias(f"r{r}"))
    return out


def mttkrp(tensor: SparseTensor, factors: dict[int, DataFrame] | list[DataFrame], mode: int, rank: int, *, plan: str = "auto", dense: bool = False) -> DataFrame:
    """i, row of the product for ``mode``; ``factors[k]`` is needed for every other mode."""
    if plan not in PLANS:
        raise TensorError(f"unknown plan {plan!r}; one of {PLANS}")
    if not 0 <= mode < tensor.nmodes:
        raise TensorError(f"mode {mode} of a tensor of {tensor.nmodes} modes")
    given = dict(enumerate(factors)) if isinstance(factors, list) else factors
    others = _others(tensor, mode)
    small = sum(factor_bytes(tensor.dims[k], rank) for k in others) <= BROADCAST_BYTES
    if plan == "auto":
        plan = choose_plan(tensor.dims, mode, rank)
    if plan == "arrow" and not small:
        raise TensorError("factors are too large to be held by every task")
    columns = {"wide": _wide, "blocked": _blocked, "long": _long, "fiber": _fiber, "unfold": _unfold, "arrow": _arrow}[plan](tensor, given, mode, rank, others)
    if dense:
        every = tensor.df.sparkSession.range(tensor.dims[mode]).withColumnRenamed("id", "i")
        zero = F.array_repeat(F.lit(0.0), rank)
        return every.join(columns, "i", "left").select("i", F.coalesce("row", zero).alias("row"))
    return columns


def _as_row(df: DataFrame, key: str, rank: int) -> DataFrame:
    return df.select(F.col(key).alias("i"), F.array(*[F.col(f"r{r}") for r in range(rank)]).alias("row"))


def _wide(tensor, factors, mode, rank, others) -> DataFrame:
    x = _joined(tensor.df, tensor, others, factors, rank)
    return _as_row(x.groupBy(f"i{mode}").agg(*_sums(F.col("val"), [f"a{k}" for k in others], rank)), f"i{mode}", rank)


def _blocked(tensor, factors, mode, rank, others) -> DataFrame:
    """``wide`` for slices of WIDE_RANK columns each, joined by the index, by which all of them are partitioned."""
    out = None
    for a in range(0, rank, WIDE_RANK):
        width = min(WIDE_RANK, rank - a)
        sliced = {k: factors[k].select("i", F.slice("row", a + 1, width).alias("row")) for k in others}
        part = _wide(tensor, sliced, mode, width, others).withColumnRenamed("row", f"row{a}")
        out = part if out is None else out.join(part, "i")
    return out.select("i", F.concat(*[f"row{a}" for a in range(0, rank, WIDE_RANK)]).alias("row"))


def _long(tensor, factors, mode, rank, others) -> DataFrame:
    x = tensor.df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))))
    for k in others:
        side = factors[k].select(F.col("i").alias(f"i{k}"), F.posexplode("row").alias("r", f"v{k}"))
        x = x.join(_side(side, tensor.dims[k], rank * 4), [f"i{k}", "r"]).withColumn("val", F.col("val") * F.col(f"v{k}")).drop(f"v{k}")
    per = x.groupBy(F.col(f"i{mode}").alias("i"), "r").agg(F.sum("val").alias("v"))
    return per.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("row"))


def _fiber(tensor, factors, mode, rank, others) -> DataFrame:
    """The longest other mode is summed first, within fibers of fixed remaining coordinates."""
    leaf = max(others, key=lambda m: (tensor.dims[m], m))
    above = [k for k in others if k != leaf]
    x = _joined(tensor.df, tensor, [leaf], factors, rank)
    fibers = x.groupBy(f"i{mode}", *[f"i{k}" for k in above]).agg(*[F.sum(F.col("val") * F.col(f"a{leaf}")[r]).alias(f"s{r}") for r in range(rank)])
    y = _joined(fibers, tensor, above, factors, rank)
    sums = []
    for r in range(rank):
        term = F.col(f"s{r}")
        for k in above:
            term = term * F.col(f"a{k}")[r]
        sums.append(F.sum(term).alias(f"r{r}"))
    return _as_row(y.groupBy(f"i{mode}").agg(*sums), f"i{mode}", rank)


def _unfold(tensor, factors, mode, rank, others) -> DataFrame:
    rest = [m for m in range(tensor.nmodes) if m != mode]
    sizes = [tensor.dims[m] for m in rest]
    cols = radix.decode(F.col("col"), sizes) if radix.fits(sizes) else [F.col(f"col.i{m}") for m in rest]
    x = tensor.unfold(mode).select("row", "val", *[c.alias(f"i{m}") for m, c in zip(rest, cols)])
    x = _joined(x, tensor, others, factors, rank)
    return _as_row(x.groupBy("row").agg(*_sums(F.col("val"), [f"a{k}" for k in others], rank)).withColumnRenamed("row", "_i"), "_i", rank)


def to_numpy(factor: DataFrame, dim: int, rank: int) -> np.ndarray:
    """A factor of checked size as an array; absent rows are zero."""
    if factor_bytes(dim, rank) > BROADCAST_BYTES * 4:
        raise TensorError("the factor is too large for the driver")
    out = np.zeros((dim, rank))
    t = factor.select("i", "row").toArrow()
    if t.num_rows:
        out[t["i"].to_numpy()] = np.asarray(t["row"].combine_chunks().flatten()).reshape(-1, rank)
    return out


def partial_products(batches, arrays: dict[int, np.ndarray], mode: int, rank: int):
    """Per batch the summed rows of the product: one row per distinct index of the mode."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = b.column("val").to_numpy()[:, None] * np.ones((1, rank))
        for k, a in arrays.items():
            rows *= a[b.column(f"i{k}").to_numpy()]
        at = b.column(f"i{mode}").to_numpy()
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        sums = np.add.reduceat(rows[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(at[starts]), *[pa.array(sums[:, r]) for r in range(rank)]], ["i", *[f"r{r}" for r in range(rank)]])


def arrow_products(tensor: SparseTensor, arrays: dict[int, np.ndarray], mode: int, rank: int) -> DataFrame:
    """i, r0 .. r{R-1}: the product with factors broadcast as arrays; partial sums in NumPy, final sums in Spark."""
    shared = tensor.df.sparkSession.sparkContext.broadcast(arrays)
    schema = "i bigint, " + ", ".join(f"r{r} double" for r in range(rank))
    parts = tensor.df.mapInArrow(lambda batches: partial_products(batches, shared.value, mode, rank), schema)
    return parts.groupBy("i").agg(*[F.sum(f"r{r}").alias(f"r{r}") for r in range(rank)])


def packed(tensor: SparseTensor) -> DataFrame:
    """The nonzeros as few rows of packed arrays (i0 .. and val as bytes), at most PACKED_NONZEROS each, for work that passes
    over them many times; written once. Indices take 4 bytes if all dims allow. Nonzeros that do not fill a row per core
    are spread over all cores first."""
    cores = tensor.df.sparkSession.sparkContext.defaultParallelism
    df = tensor.df if tensor.nnz() >= cores * PACKED_NONZEROS else tensor.df.repartition(cores)
    kind = np.dtype(np.int32 if max(tensor.dims) < 1 << 31 else np.int64)
    names = [*tensor.modes, "val"]

    def run(batches):
        def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            arrays = [t[c].to_numpy().astype(kind).tobytes() for c in names[:-1]] + [t["val"].to_numpy().tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays], names)

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= PACKED_NONZEROS:
                yield one(held)
                held, rows = [], 0
        if rows:
            yield one(held)

    return materialize(df.select(*names).mapInArrow(run, ", ".join(f"{c} binary" for c in names)))


def _unpacked(batches, dims: list[int]):
    """(indices per mode, values) of every packed row."""
    kind = np.dtype(np.int32 if max(dims) < 1 << 31 else np.int64)
    for b in batches:
        for r in range(b.num_rows):
            yield [np.frombuffer(b.column(m)[r].as_buffer(), kind) for m in range(len(dims))], np.frombuffer(b.column(len(dims))[r].as_buffer())


def _products(indices: list[np.ndarray], values: np.ndarray, arrays: dict[int, np.ndarray], rank: int) -> np.ndarray:
    """(rank, nonzeros): value times the factors' rows; columns are kept apart, so that each is summed in one pass."""
    out = None
    for k, a in arrays.items():
        rows = a.T[:, indices[k]]
        out = rows if out is None else np.multiply(out, rows, out=out)
    return np.multiply(out, values, out=out) if out is not None else np.tile(values, (rank, 1))


def held_product(nonzeros: list[tuple[list[np.ndarray], np.ndarray]], dims: list[int], arrays: dict[int, np.ndarray], mode: int, rank: int) -> np.ndarray:
    """The product as an array, from unpacked nonzeros and factors of the other modes in memory."""
    total = np.zeros((rank, dims[mode]))
    for indices, values in nonzeros:
        p = _products(indices, values, {k: a for k, a in arrays.items() if k != mode}, rank)
        for r in range(rank):
            total[r] += np.bincount(indices[mode], p[r], dims[mode])
    return total.T


def held(nonzeros: DataFrame, dims: list[int]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """``packed`` nonzeros, which the caller knows to be few, on the driver."""
    return list(_unpacked(nonzeros.toArrow().to_batches(), dims))


def product_array(nonzeros: DataFrame, dims: list[int], shared: dict[int, Broadcast], mode: int, rank: int, tasks: int) -> np.ndarray:
    """The product as an array, from ``packed`` nonzeros and broadcast factors of the other modes, which the caller keeps and
    destroys. If all tasks' sums together are proven small they are added on the driver, without an exchange; else Spark
    adds them first."""
    dim = dims[mode]
    others = {k: b for k, b in shared.items() if k != mode}

    def whole(batches):
        total = held_product(_unpacked(batches, dims), dims, {k: b.value for k, b in others.items()}, mode, rank)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def partial(batches):
        arrays = {k: b.value for k, b in others.items()}
        for indices, values in _unpacked(batches, dims):
            p = _products(indices, values, arrays, rank)
            at, place = np.unique(indices[mode], return_inverse=True)
            sums = [pa.array(np.bincount(place, p[r], len(at))) for r in range(rank)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *sums], ["i", *[f"r{r}" for r in range(rank)]])

    if tasks * factor_bytes(dim, rank) <= BROADCAST_BYTES:
        t = nonzeros.mapInArrow(whole, "total binary").toArrow()
        return sum((np.frombuffer(x.as_buffer()).reshape(dim, rank) for x in t["total"]), np.zeros((dim, rank)))
    out = np.zeros((dim, rank))
    parts = nonzeros.mapInArrow(partial, "i bigint, " + ", ".join(f"r{r} double" for r in range(rank)))
    t = parts.groupBy("i").agg(*[F.sum(f"r{r}").alias(f"r{r}") for r in range(rank)]).toArrow()
    if t.num_rows:
        out[t["i"].to_numpy()] = np.stack([t[f"r{r}"].to_numpy() for r in range(rank)], axis=1)
    return out


def _arrow(tensor, factors, mode, rank, others) -> DataFrame:
    arrays = {k: to_numpy(factors[k], tensor.dims[k], rank) for k in others}
    return _as_row(arrow_products(tensor, arrays, mode, rank), "i", rank)


def inner_product(tensor: SparseTensor, product: DataFrame, factor: DataFrame, weights: list[float]) -> float:
    """<X, Z> from any mode's product and factor: sum over i, r of M[i, r] A[i, r] weight[r]."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    x = product.select("i", F.col("row").alias("m")).join(factor, "i")
    term = F.aggregate(F.zip_with(F.zip_with("m", "row", lambda a, b: a * b), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return float(x.agg(F.sum(term)).first()[0] or 0.0)


def ttv(tensor: SparseTensor, vector: DataFrame, mode: int) -> DataFrame:
    """The tensor times a vector (i, v) along a mode: remaining coordinates and val."""
    keep = [c for c in tensor.modes if c != f"i{mode}"]
    x = tensor.df.join(vector.select(F.col("i").alias(f"i{mode}"), "v"), f"i{mode}")
    return x.groupBy(*keep).agg(F.sum(F.col("val") * F.col("v")).alias("val"))
