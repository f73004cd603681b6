"""Queries over tensors built from the driver's tables, each with its SQL.

T3 is lineitem as (part, supplier, month) with summed quantities, T4 is orders as (customer, status, priority, month) with
counts, TE is events as (user, type, day) with counts. Values and the factors by rule are whole numbers, so sums are exact
in any order. Tensors are written once per session and folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cootide.core import SparseTensor, affine_factor, affine_row, density, index_column, rebase
from cootide.functions import ranking
from cootide.operators import cpd, graphs, kernels, linalg, partition, reorder, stats, structure
from cootide.session import materialize, read_table, release, shared_folder

_kept: dict[tuple, SparseTensor] = {}


def _build(spark: SparkSession, sf_dir: str, which: str) -> SparseTensor:
    month = lambda c: (F.year(c) * 12 + F.month(c)).alias("ym")
    if which in ("t3", "raw3", "gap3"):
        x = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), month("l_shipdate"), F.col("l_quantity").alias("v")).dropna()
        if which == "gap3":
            return SparseTensor.from_dataframe(x, ["a", "b", "ym"], "v")
        y = SparseTensor.from_dataframe(index_column(rebase(x, ["a", "b"]), "ym", "c"), ["a", "b", "c"], "v")
        return y if which == "raw3" else y.sum_duplicates()
    if which == "t4":
        x = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", month("o_orderdate"), F.lit(1.0).alias("v")).dropna()
        x = index_column(index_column(index_column(rebase(x, ["o_custkey"]), "o_orderstatus", "s"), "o_orderpriority", "p"), "ym", "c")
        return SparseTensor.from_dataframe(x, ["o_custkey", "s", "p", "c"], "v").sum_duplicates()
    x = read_table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.lit(1.0).alias("v")).dropna()
    x = index_column(index_column(rebase(x, ["user_id"]), "event_type", "t"), "day", "d")
    return SparseTensor.from_dataframe(x, ["user_id", "t", "d"], "v").sum_duplicates()


def tensor(spark: SparkSession, sf_dir: str, which: str) -> SparseTensor:
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _kept:
        _kept[key] = _build(spark, sf_dir, which).materialize()
    return _kept[key]


def forget(spark: SparkSession) -> None:
    """Drop the tensors kept so far."""
    for x in _kept.values():
        release(x.df)
    _kept.clear()


def _factors(x: SparseTensor, rank: int) -> list[DataFrame]:
    return [affine_factor(x.df.sparkSession, d, m, rank) for m, d in enumerate(x.dims)]


def _arrays(x: SparseTensor, rank: int) -> list[np.ndarray]:
    return [np.array([[(7 * i + 5 * r + 3 * m) % 11 - 5 for r in range(rank)] for i in range(d)], float) for m, d in enumerate(x.dims)]


def _columns(rows: DataFrame, rank: int) -> DataFrame:
    return rows.select("i", *[F.col("row")[r].alias(f"r{r}") for r in range(rank)])


# -- SQL of the tensors ----------------------------------------------------------------------------------------------

_LINE = "(SELECT l_partkey AS a, l_suppkey AS b, year(l_shipdate) * 12 + month(l_shipdate) AS ym, l_quantity AS v FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_quantity IS NOT NULL)"
_RAW3 = f"raw3 AS (SELECT a - min(a) OVER () AS i0, b - min(b) OVER () AS i1, dense_rank() OVER (ORDER BY ym) - 1 AS i2, v AS val FROM {_LINE})"
_GAP3 = f"gap3 AS (SELECT a AS i0, b AS i1, ym AS i2, v AS val FROM {_LINE})"
_T3 = f"{_RAW3}, t3 AS (SELECT i0, i1, i2, sum(val) AS val FROM raw3 GROUP BY ALL)"
_T4 = """t4 AS (SELECT i0, i1, i2, i3, CAST(count(*) AS DOUBLE) AS val FROM (
    SELECT o_custkey - min(o_custkey) OVER () AS i0, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS i1, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i2,
           dense_rank() OVER (ORDER BY year(o_orderdate) * 12 + month(o_orderdate)) - 1 AS i3
    FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL) GROUP BY ALL)"""
_TE = """te AS (SELECT i0, i1, i2, CAST(count(*) AS DOUBLE) AS val FROM (
    SELECT user_id - min(user_id) OVER () AS i0, dense_rank() OVER (ORDER BY event_type) - 1 AS i1, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i2
    FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL) GROUP BY ALL)"""
_CTE = {"t3": _T3, "raw3": _RAW3, "gap3": _GAP3, "t4": _T4, "te": _TE}


def _dims(which: str, n: int) -> str:
    return f"dims AS (SELECT {', '.join(f'max(i{m}) + 1 AS d{m}' for m in range(n))} FROM {which})"


def _with(which: str, n: int = 3, dims: bool = False) -> str:
    return f"WITH {_CTE[which]}" + (f", {_dims(which, n)}" if dims else "")


def _a(mode: int, r: int | str, index: str) -> str:
    return f"CAST((7 * {index} + 5 * {r} + {3 * mode}) % 11 - 5 AS DOUBLE)"


def _mttkrp_sql(which: str, n: int, mode: int, rank: int) -> str:
    terms = [f"sum(val * {' * '.join(_a(k, r, f'i{k}') for k in range(n) if k != mode)}) AS r{r}" for r in range(rank)]
    return f"{_with(which)} SELECT i{mode} AS i, {', '.join(terms)} FROM {which} GROUP BY 1"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# -- building, cleaning, describing ------------------------------------------------------------------------------------

for _w, _n in (("t3", 3), ("t4", 4), ("te", 3)):
    _query(f"tensor_build_{_w}", f"{_with(_w)} SELECT * FROM {_w}")(lambda s, d, w=_w: tensor(s, d, w).df)

_query("sum_duplicates", f"{_with('raw3')} SELECT i0, i1, i2, sum(val) AS val FROM raw3 GROUP BY ALL")(lambda s, d: tensor(s, d, "raw3").sum_duplicates().df)


@_query("count_duplicates", f"{_with('raw3')} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT i0, i1, i2 FROM raw3)) AS duplicates FROM raw3")
def count_duplicates(spark, sf_dir):
    return spark.createDataFrame([(tensor(spark, sf_dir, "raw3").count_duplicates(),)], "duplicates bigint")


_query("tensor_stats", f"{_with('te')} SELECT 3 AS nmodes, count(*) AS nnz, sum(val * val) AS normsq, count(*) * 32 AS coord_bytes FROM te")(lambda s, d: stats.stats(tensor(s, d, "te")))


@_query("tensor_density", f"{_with('te', 3, True)} SELECT round(count(*) / (max(d0) * max(d1) * max(d2)), 12) AS density FROM te, dims")
def tensor_density(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    return spark.createDataFrame([(round(density(x.nnz(), x.dims), 12),)], "density double")


@_query("tensor_normsq", f"{_with('t3')} SELECT sum(val * val) AS normsq FROM t3")
def tensor_normsq(spark, sf_dir):
    return spark.createDataFrame([(tensor(spark, sf_dir, "t3").normsq(),)], "normsq double")


for _m in range(3):
    _query(f"mode_histogram_{_m}", f"{_with('te', 3, True)} SELECT g.i, count(te.val) AS nnz FROM (SELECT unnest(range(d{_m})) AS i FROM dims) g LEFT JOIN te ON te.i{_m} = g.i GROUP BY g.i")(lambda s, d, m=_m: tensor(s, d, "te").histogram(m))
    _query(f"mode_slices_{_m}", f"{_with('t3')} SELECT i{_m} AS i, count(*) AS nnz FROM t3 GROUP BY 1")(lambda s, d, m=_m: tensor(s, d, "t3").slices(m))
    _query(f"compact_map_{_m}", f"{_with('gap3')} SELECT row_number() OVER (ORDER BY old) - 1 AS new, old FROM (SELECT DISTINCT i{_m} AS old FROM gap3)")(lambda s, d, m=_m: tensor(s, d, "gap3").index_map(m))

_query("compact_indices", f"{_with('gap3')} SELECT dense_rank() OVER (ORDER BY i0) - 1 AS i0, dense_rank() OVER (ORDER BY i1) - 1 AS i1, dense_rank() OVER (ORDER BY i2) - 1 AS i2, val FROM gap3")(lambda s, d: tensor(s, d, "gap3").compact().df)


@_query("empty_slice_count", f"{_with('gap3')} SELECT max(i0) + max(i1) + max(i2) + 3 - count(DISTINCT i0) - count(DISTINCT i1) - count(DISTINCT i2) AS empty FROM gap3")
def empty_slice_count(spark, sf_dir):
    return spark.createDataFrame([(tensor(spark, sf_dir, "gap3").empty_slices(),)], "empty bigint")


_query("restrict_mode2", f"{_with('t3')} SELECT i0, i1, i2 - 5 AS i2, val FROM t3 WHERE i2 >= 5 AND i2 < 20")(lambda s, d: tensor(s, d, "t3").restrict(2, 5, 20).df)


@_query("sorted_positions", f"{_with('te')} SELECT i0, i1, i2, val, row_number() OVER (ORDER BY i1, i2, i0) - 1 AS position FROM te")
def sorted_positions(spark, sf_dir):
    return ranking.global_rank(tensor(spark, sf_dir, "te").df, ["i1", "i2", "i0"], "position")


for _m in range(3):
    _u, _v = [k for k in range(3) if k != _m]
    _query(f"unfold_mode{_m}", f"{_with('t3', 3, True)} SELECT i{_m} AS row, i{_u} * d{_v} + i{_v} AS col, val FROM t3, dims")(lambda s, d, m=_m: tensor(s, d, "t3").unfold(m))
_query("csr_rowptr", f"{_with('te', 3, True)}, h AS (SELECT g.i AS row, count(te.val) AS nnz FROM (SELECT unnest(range(d0)) AS i FROM dims) g LEFT JOIN te ON te.i0 = g.i GROUP BY 1) SELECT row, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h")(lambda s, d: tensor(s, d, "te").row_pointers(0))

# -- products ----------------------------------------------------------------------------------------------------------

for _m in range(3):
    _query(f"mttkrp_m{_m}_r4", _mttkrp_sql("t3", 3, _m, 4))(lambda s, d, m=_m: _columns(kernels.mttkrp(x := tensor(s, d, "t3"), _factors(x, 4), m, 4), 4))
for _m in range(4):
    _query(f"mttkrp4_m{_m}", _mttkrp_sql("t4", 4, _m, 4))(lambda s, d, m=_m: _columns(kernels.mttkrp(x := tensor(s, d, "t4"), _factors(x, 4), m, 4), 4))
for _p in ("wide", "long", "fiber", "unfold", "arrow"):
    _query(f"mttkrp_{_p}", _mttkrp_sql("te", 3, 0, 4))(lambda s, d, p=_p: _columns(kernels.mttkrp(x := tensor(s, d, "te"), _factors(x, 4), 0, 4, plan=p), 4))
_query("mttkrp_m0_r16", _mttkrp_sql("t3", 3, 0, 16))(lambda s, d: _columns(kernels.mttkrp(x := tensor(s, d, "t3"), _factors(x, 16), 0, 16), 16))
_query("ttv_mode2", f"{_with('t3')} SELECT i0, i1, sum(val * {_a(2, 0, 'i2')}) AS val FROM t3 GROUP BY 1, 2")(
    lambda s, d: kernels.ttv(x := tensor(s, d, "t3"), affine_factor(s, x.dims[2], 2, 1).select("i", F.col("row")[0].alias("v")), 2)
)

# -- dense algebra -----------------------------------------------------------------------------------------------------


def _factor_sql(which: str, mode: int, rank: int) -> str:
    return f"f{mode} AS (SELECT i, {', '.join(_a(mode, r, 'i') + f' AS r{r}' for r in range(rank))} FROM (SELECT unnest(range(d{mode})) AS i FROM dims))"


for _m in range(3):
    _query(f"gram_m{_m}", f"{_with('t3', 3, True)} SELECT r, s, sum({_a(_m, 'r', 'i')} * {_a(_m, 's', 'i')}) AS v FROM (SELECT unnest(range(d{_m})) AS i FROM dims), (SELECT unnest([0, 1, 2, 3]) AS r), (SELECT unnest([0, 1, 2, 3]) AS s) WHERE s >= r GROUP BY r, s")(
        lambda s, d, m=_m: linalg.gram_entries(affine_factor(s, tensor(s, d, "t3").dims[m], m, 4), 4)
    )


def _gram_of(m: int) -> str:
    return f"(SELECT r, s, sum({_a(m, 'r', 'i')} * {_a(m, 's', 'i')}) AS v FROM (SELECT unnest(range(d{m})) AS i FROM dims), (SELECT unnest([0, 1, 2, 3]) AS r), (SELECT unnest([0, 1, 2, 3]) AS s) GROUP BY r, s) g{m}"


@_query("gram_hadamard", f"{_with('t3', 3, True)} SELECT g1.r, g1.s, g1.v * g2.v AS v FROM {_gram_of(1)} JOIN {_gram_of(2)} ON g1.r = g2.r AND g1.s = g2.s")
def gram_hadamard(spark, sf_dir):
    x = tensor(spark, sf_dir, "t3")
    h = linalg.hadamard([linalg.gram(f, 4) for f in _factors(x, 4)], 0)
    return spark.createDataFrame([(r, s, float(h[r, s])) for r in range(4) for s in range(4)], "r int, s int, v double")


@_query("matmul_factor", f"{_with('te', 3, True)}, b AS (SELECT k, j, {_a(1, 'j', 'k')} AS v FROM (SELECT unnest([0, 1, 2, 3]) AS k), (SELECT unnest([0, 1, 2]) AS j)) SELECT i, j, sum({_a(0, 'k', 'i')} * b.v) AS v FROM (SELECT unnest(range(d0)) AS i FROM dims), b GROUP BY i, j")
def matmul_factor(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    a = linalg.to_long(affine_factor(spark, x.dims[0], 0, 4)).withColumnRenamed("r", "k")
    b = linalg.to_long(affine_factor(spark, 4, 1, 3)).select(F.col("i").alias("k"), F.col("r").alias("j"), "v")
    return linalg.matmul(a, b)


def _normalized(spark, sf_dir, kind):
    m, _ = linalg.normalize(affine_factor(spark, tensor(spark, sf_dir, "te").dims[0], 0, 2), 2, kind)
    return m.select("i", F.round(F.col("row")[0], 9).alias("r0"), F.round(F.col("row")[1], 9).alias("r1"))


_query("normalize_2", f"{_with('te', 3, True)}, {_factor_sql('te', 0, 2)} SELECT i, round(r0 / (SELECT sqrt(sum(r0 * r0)) FROM f0), 9) AS r0, round(r1 / (SELECT sqrt(sum(r1 * r1)) FROM f0), 9) AS r1 FROM f0")(lambda s, d: _normalized(s, d, "2"))
_query("normalize_max", f"{_with('te', 3, True)}, {_factor_sql('te', 0, 2)} SELECT i, round(r0 / (SELECT greatest(1, max(r0)) FROM f0), 9) AS r0, round(r1 / (SELECT greatest(1, max(r1)) FROM f0), 9) AS r1 FROM f0")(lambda s, d: _normalized(s, d, "max"))


@_query("column_norms", f"{_with('te', 3, True)}, {_factor_sql('te', 0, 2)} SELECT 0 AS r, round(sqrt(sum(r0 * r0)), 6) AS two, greatest(1, max(r0)) AS most FROM f0 UNION ALL SELECT 1, round(sqrt(sum(r1 * r1)), 6), greatest(1, max(r1)) FROM f0")
def column_norms(spark, sf_dir):
    f = affine_factor(spark, tensor(spark, sf_dir, "te").dims[0], 0, 2)
    two, most = linalg.column_norms(f, 2), linalg.column_norms(f, 2, "max")
    return spark.createDataFrame([(r, round(two[r], 6), most[r]) for r in range(2)], "r int, two double, most double")


_INNER = f"SELECT sum(val * ({' + '.join(' * '.join(_a(m, r, f'i{m}') for m in range(3)) for r in range(2))})) AS v FROM te"
_GRAMS = ", ".join(f"g{m} AS (SELECT sum(r0 * r0) AS a, sum(r0 * r1) AS b, sum(r1 * r1) AS c FROM f{m})" for m in range(3))
_MODEL = f"{_with('te', 3, True)}, {', '.join(_factor_sql('te', m, 2) for m in range(3))}, {_GRAMS}"
_NORM = "abs(g0.a * g1.a * g2.a + 2 * g0.b * g1.b * g2.b + g0.c * g1.c * g2.c)"


@_query("tensor_innerprod", f"{_with('te')} SELECT v AS inner_product FROM ({_INNER})")
def tensor_innerprod(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    f = _factors(x, 2)
    v = kernels.inner_product(x, kernels.mttkrp(x, f, 1, 2), f[1], [1.0, 1.0])
    return spark.createDataFrame([(v,)], "inner_product double")


@_query("kruskal_norm", f"{_MODEL} SELECT {_NORM} AS normsq FROM g0, g1, g2")
def kruskal_norm(spark, sf_dir):
    v = cpd.model_normsq([linalg.gram(f, 2) for f in _factors(tensor(spark, sf_dir, "te"), 2)], np.ones(2))
    return spark.createDataFrame([(v,)], "normsq double")


@_query("cpd_fit_given", f"{_MODEL} SELECT round(1 - sqrt((SELECT sum(val * val) FROM te) + {_NORM} - 2 * (SELECT v FROM ({_INNER}))) / (SELECT sqrt(sum(val * val)) FROM te), 9) AS fit FROM g0, g1, g2")
def cpd_fit_given(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    f = _factors(x, 2)
    inner = kernels.inner_product(x, kernels.mttkrp(x, f, 2, 2), f[2], [1.0, 1.0])
    fit = cpd.fit_of(x.normsq(), cpd.model_normsq([linalg.gram(a, 2) for a in f], np.ones(2)), inner)
    return spark.createDataFrame([(round(fit, 9),)], "fit double")


def _als_steps(rank: int, iterations: int) -> str:
    """The recurrence of the decomposition of TE from the factors by rule, unrolled as SQL for rank 1 or 2."""
    rs = range(rank)
    pairs = [(r, s) for r in rs for s in rs if s >= r]
    gram = lambda t: ", ".join(f"sum(r{r} * r{s}) AS g{r}{s}" for r, s in pairs) + f" FROM {t}"
    ctes = [_factor_sql("te", m, rank) for m in range(3)]
    now = ["f0", "f1", "f2"]
    for it in range(iterations):
        for m in range(3):
            k, j = [n for n in range(3) if n != m]
            t = f"s{it}{m}"
            ctes.append(f"{t}m AS MATERIALIZED (SELECT te.i{m} AS i, {', '.join(f'sum(val * p.r{r} * q.r{r}) AS r{r}' for r in rs)} FROM te JOIN {now[k]} p ON p.i = te.i{k} JOIN {now[j]} q ON q.i = te.i{j} GROUP BY 1)")
            ctes.append(f"{t}h AS (SELECT {', '.join(f'a.g{r}{s} * b.g{r}{s} AS h{r}{s}' for r, s in pairs)} FROM (SELECT {gram(now[k])}) a, (SELECT {gram(now[j])}) b)")
            if rank == 1:
                solved = "r0 / h00 AS r0"
            else:
                det = "(h00 * h11 - h01 * h01)"
                solved = f"(r0 * h11 - r1 * h01) / {det} AS r0, (r1 * h00 - r0 * h01) / {det} AS r1"
            ctes.append(f"{t}a AS MATERIALIZED (SELECT i, {solved} FROM {t}m, {t}h)")
            norm = (lambda r: f"sqrt(sum(r{r} * r{r}))") if it == 0 else (lambda r: f"greatest(1, max(r{r}))")
            ctes.append(f"{t}l AS (SELECT {', '.join(f'{norm(r)} AS l{r}' for r in rs)} FROM {t}a)")
            ctes.append(f"{t} AS MATERIALIZED (SELECT i, {', '.join(f'r{r} / l{r} AS r{r}' for r in rs)} FROM {t}a, {t}l)")
            now[m] = t
    last = f"s{iterations - 1}2"
    inner = f"(SELECT sum({' + '.join(f'a.r{r} * m.r{r} * l{r}' for r in rs)}) FROM {last} a JOIN {last}m m ON a.i = m.i, {last}l)"
    weight = lambda r, s: f"l{r} * l{s} * {1 if r == s else 2} * {' * '.join(f'(SELECT sum(r{r} * r{s}) FROM {t})' for t in now)}"
    model = f"(SELECT abs({' + '.join(weight(r, s) for r, s in pairs)}) FROM {last}l)"
    return f"{_with('te', 3, True)}, {', '.join(ctes)} SELECT round(1 - sqrt((SELECT sum(val * val) FROM te) + {model} - 2 * {inner}) / (SELECT sqrt(sum(val * val)) FROM te), 6) AS fit"


def _als(spark, sf_dir, rank, iterations, frames=False):
    x = tensor(spark, sf_dir, "te")
    o = cpd.CpdOptions(tolerance=0.0, max_iterations=iterations, init="affine", compact=False, driver_bytes=0 if frames else 256 << 20)
    return spark.createDataFrame([(round(cpd.cpd_als(x, rank, o).fit, 6),)], "fit double")


_query("cpd_rank1_it3", _als_steps(1, 3))(lambda s, d: _als(s, d, 1, 3))
_query("cpd_rank2_it2", _als_steps(2, 2))(lambda s, d: _als(s, d, 2, 2))
_query("cpd_rank2_it2_distributed", _als_steps(2, 2))(lambda s, d: _als(s, d, 2, 2, True))


@_query("cpd_als_r8", "SELECT TRUE AS stopped, TRUE AS rising, TRUE AS in_range, TRUE AS unit_columns, TRUE AS same_fit")
def cpd_als_r8(spark, sf_dir):
    """What must hold of a decomposition of rank 8 from a random start: it ends by the default tolerance or after 50
    iterations, fits never fall, lie in (0, 1), the model's columns have norm one, and its fit is that of its own factors."""
    x = tensor(spark, sf_dir, "te")
    out = cpd.cpd_als(x, 8, cpd.CpdOptions(seed=1, compact=False))
    fits = out.fits
    frames = [out.factor_frame(spark, m) for m in range(3)]
    inner = kernels.inner_product(x, kernels.mttkrp(x, frames, 0, 8), frames[0], out.weights.tolist())
    again = cpd.fit_of(x.normsq(), cpd.model_normsq([f.T @ f for f in out.factors], out.weights), inner)
    return spark.createDataFrame(
        [(
            len(fits) == 50 or abs(fits[-1] - fits[-2]) < 1e-5, all(b >= a - 1e-9 for a, b in zip(fits, fits[1:])), all(0 < f < 1 for f in fits),
            all(bool(np.allclose((f * f).sum(axis=0), 1)) for f in out.factors), abs(again - out.fit) < 1e-9,
        )],
        "stopped boolean, rising boolean, in_range boolean, unit_columns boolean, same_fit boolean",
    )


@_query("solve_normals_r2", f"{_MODEL}, m AS ({_mttkrp_sql('te', 3, 0, 2).split('GROUP BY ALL) ', 1)[1]}) SELECT i, round((r0 * (g1.c * g2.c) - r1 * (g1.b * g2.b)) / (g1.a * g2.a * g1.c * g2.c - g1.b * g2.b * g1.b * g2.b), 6) AS x0, round((r1 * (g1.a * g2.a) - r0 * (g1.b * g2.b)) / (g1.a * g2.a * g1.c * g2.c - g1.b * g2.b * g1.b * g2.b), 6) AS x1 FROM m, g1, g2")
def solve_normals_r2(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    f = _factors(x, 2)
    h = linalg.hadamard([linalg.gram(a, 2) for a in f], 0)
    solved = linalg.times(kernels.mttkrp(x, f, 0, 2), linalg.normal_inverse(h))
    return solved.select("i", F.round(F.col("row")[0], 6).alias("x0"), F.round(F.col("row")[1], 6).alias("x1"))


# -- tiles and trees ---------------------------------------------------------------------------------------------------

_TILE = "least(i0 // greatest(d0 // 4, 1), 3) * 12 + least(i1 // greatest(d1 // 3, 1), 2) * 4 + least(i2 // greatest(d2 // 4, 1), 3)"
_TILES = [4, 3, 4]
_query("dense_tile_ids", f"{_with('te', 3, True)} SELECT i0, i1, i2, val, CAST({_TILE} AS BIGINT) AS tile FROM te, dims")(lambda s, d: structure.with_tiles(tensor(s, d, "te"), _TILES))
_query("tile_histogram", f"{_with('te', 3, True)} SELECT CAST({_TILE} AS BIGINT) AS tile, count(*) AS nnz FROM te, dims GROUP BY 1")(lambda s, d: structure.with_tiles(tensor(s, d, "te"), _TILES).groupBy("tile").agg(F.count(F.lit(1)).alias("nnz")))
_query(
    "tile_ptr",
    f"{_with('te', 3, True)}, c AS (SELECT g.tile, count(x.tile) AS nnz FROM (SELECT unnest(range(48)) AS tile) g LEFT JOIN (SELECT {_TILE} AS tile FROM te, dims) x ON x.tile = g.tile GROUP BY 1) SELECT tile, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c",
)(lambda s, d: structure.tile_pointers(tensor(s, d, "te"), _TILES))

_query("csf_level_counts", f"{_with('te')} SELECT 0 AS depth, count(DISTINCT i1) AS nfibs FROM te UNION ALL SELECT 1, count(*) FROM (SELECT DISTINCT i1, i2 FROM te) UNION ALL SELECT 2, count(*) FROM te")(lambda s, d: structure.level_counts(tensor(s, d, "te"), [1, 2, 0]))
_CHILDREN = ["SELECT i1 AS p0, i1 AS fid, count(DISTINCT i2) AS children FROM te GROUP BY 1", "SELECT i1 AS p0, i2 AS p1, i2 AS fid, count(*) AS children FROM te GROUP BY 1, 2"]
for _d in range(2):
    _names = ", ".join(f"p{k}" for k in range(_d + 1))
    _query(f"csf_fids_level{_d}", f"{_with('te')} SELECT {_names}, fid, row_number() OVER (ORDER BY {_names}) - 1 AS position FROM ({_CHILDREN[_d]})")(lambda s, d, n=_d: structure.level_nodes(tensor(s, d, "te"), [1, 2, 0], n).drop("children", "fptr"))
    _query(f"csf_fptr_level{_d}", f"{_with('te')} SELECT {_names}, children, CAST(coalesce(sum(children) OVER (ORDER BY {_names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fptr FROM ({_CHILDREN[_d]})")(lambda s, d, n=_d: structure.level_nodes(tensor(s, d, "te"), [1, 2, 0], n).drop("fid", "position"))


@_query("csf_storage_bytes", f"{_with('te', 3, True)}, a AS (SELECT count(*) AS n FROM te), b AS (SELECT count(DISTINCT i1) AS n FROM te), c AS (SELECT count(*) AS n FROM (SELECT DISTINCT i1, i2 FROM te)) SELECT a.n * 16 + 200 + (b.n + 1) * 8 + CASE WHEN b.n < d1 THEN b.n * 8 ELSE 0 END + (c.n + 1) * 8 + c.n * 8 AS bytes FROM a, b, c, dims")
def csf_storage_bytes(spark, sf_dir):
    return spark.createDataFrame([(structure.tree_storage(tensor(spark, sf_dir, "te"), [1, 2, 0]),)], "bytes bigint")


_query("slab_tubes", f"{_with('t3')} SELECT i0, i1, i2, val, i0 // 32 AS slab, (dense_rank() OVER (PARTITION BY i0 // 32 ORDER BY i1) - 1) // 16 AS tube, (dense_rank() OVER (PARTITION BY i0 // 32 ORDER BY i2) - 1) // 8 AS tile FROM t3")(lambda s, d: structure.slab_tiles(tensor(s, d, "t3"), [0, 1, 2], fibers_per_tube=16, indices_per_tile=8))

# -- graphs ------------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT i0 AS a, d0 + i1 AS b FROM te, dims UNION ALL SELECT i0, d0 + d1 + i2 FROM te, dims UNION ALL SELECT d0 + i1, d0 + d1 + i2 FROM te, dims), w AS (SELECT a, b, count(*) AS w FROM e GROUP BY 1, 2), edges AS (SELECT a AS u, b AS v, w FROM w UNION ALL SELECT b, a, w FROM w)"
_query("graph_edges", f"{_with('te', 3, True)}, {_EDGES} SELECT u, v, w FROM edges")(lambda s, d: graphs.partite_edges(tensor(s, d, "te")))
_query("graph_degree", f"{_with('te', 3, True)}, {_EDGES} SELECT u, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM edges GROUP BY 1")(lambda s, d: graphs.degrees(graphs.partite_edges(tensor(s, d, "te"))))
_VERTICES = "vertices AS (" + " UNION ALL ".join(f"SELECT {' + '.join(['i', *[f'd{k}' for k in range(m)]])} AS v, {m} AS mode, i FROM (SELECT unnest(range(d{m})) AS i, * FROM dims)" for m in range(3)) + ")"
_query("graph_vertex_weights", f"{_with('te', 3, True)}, {_VERTICES} SELECT v, mode, i, (SELECT count(*) FROM te WHERE (mode = 0 AND i0 = i) OR (mode = 1 AND i1 = i) OR (mode = 2 AND i2 = i)) AS w FROM vertices")(lambda s, d: graphs.vertex_weights(tensor(s, d, "te")))


def _mod_parts(spark, n, column, parts=4):
    return spark.range(n).select(F.col("id").alias(column), F.pmod("id", F.lit(parts)).alias("part"))


_query("edge_cut", f"{_with('te', 3, True)}, {_EDGES} SELECT CAST(coalesce(sum(w), 0) // 2 AS BIGINT) AS cut FROM edges WHERE u % 4 <> v % 4")(lambda s, d: graphs.edge_cut(graphs.partite_edges(x := tensor(s, d, "te")), _mod_parts(s, sum(x.dims), "v")))
_NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY i0, i1, i2) - 1 AS vtx FROM te)"
_query("hypergraph_nnz_pins", f"{_with('te', 3, True)}, {_NUMBERED} SELECT i0 AS hedge, vtx FROM n UNION ALL SELECT d0 + i1, vtx FROM n, dims UNION ALL SELECT d0 + d1 + i2, vtx FROM n, dims")(lambda s, d: graphs.nonzero_pins(tensor(s, d, "te")))
_PINS = "p AS (SELECT i0 AS hedge, vtx FROM n UNION ALL SELECT d0 + i1, vtx FROM n, dims UNION ALL SELECT d0 + d1 + i2, vtx FROM n, dims)"
_query("hypergraph_uncut", f"{_with('t3', 3, True)}, {_NUMBERED.replace('te)', 't3)')}, {_PINS} SELECT g.hedge FROM (SELECT unnest(range(d0 + d1 + d2)) AS hedge FROM dims) g LEFT JOIN p USING (hedge) GROUP BY 1 HAVING count(DISTINCT p.vtx // 50) <= 1")(
    lambda s, d: graphs.uncut_hyperedges(graphs.nonzero_pins(x := tensor(s, d, "t3")), s.range(x.nnz()).select(F.col("id").alias("vtx"), F.floor(F.col("id") / 50).alias("part")), sum(x.dims))
)
# Seen from mode 1 the order of T3's modes is 1, 2, 0: parts are the longest other mode at every scale.
_FIBERS = "f AS (SELECT i1 AS s, i2 AS f0, count(*) AS nnz, row_number() OVER (ORDER BY i1, i2) - 1 AS fiber FROM t3 GROUP BY 1, 2)"
_query("hypergraph_fiber_weights", f"{_with('t3')}, {_FIBERS} SELECT s, f0, nnz, fiber FROM f")(lambda s, d: structure.fibers(tensor(s, d, "t3"), 1))
_query("hypergraph_fiber_pins", f"{_with('t3', 3, True)}, {_FIBERS} SELECT s AS hedge, fiber AS vtx FROM f UNION ALL SELECT d1 + f0, fiber FROM f, dims UNION ALL SELECT d1 + d2 + t3.i0, fiber FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0, dims")(lambda s, d: graphs.fiber_pins(tensor(s, d, "t3"), 1))

# -- permutations ------------------------------------------------------------------------------------------------------


@_query("reorder_graph_perm", f"{_with('te', 3, True)}, {_VERTICES} SELECT mode, i AS old, row_number() OVER (PARTITION BY mode ORDER BY v % 4, v) - 1 AS new FROM vertices")
def reorder_graph_perm(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    return _perms(reorder.by_graph_parts(x, _mod_parts(spark, sum(x.dims), "v")))


def _perms(perms):
    out = None
    for m, p in sorted(perms.items()):
        x = p.select(F.lit(m).alias("mode"), "old", "new")
        out = x if out is None else out.unionByName(x)
    return out


_MET = f"{_FIBERS}, met AS (SELECT 1 AS mode, s AS old, min(fiber % 4 * 1000000000 + fiber) AS k, 0 AS pos FROM f GROUP BY 2 UNION ALL SELECT 2, f0, min(fiber % 4 * 1000000000 + fiber), 0 FROM f GROUP BY 2 UNION ALL SELECT 0, t3.i0, min(fiber % 4 * 1000000000 + fiber), t3.i0 FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0 GROUP BY t3.i0)"


@_query("reorder_hgraph_perm", f"{_with('t3', 3, True)}, {_VERTICES}, {_MET} SELECT vertices.mode, i AS old, row_number() OVER (PARTITION BY vertices.mode ORDER BY (k IS NULL), k, pos, i) - 1 AS new FROM vertices LEFT JOIN met ON met.mode = vertices.mode AND met.old = vertices.i")
def reorder_hgraph_perm(spark, sf_dir):
    x = tensor(spark, sf_dir, "t3")
    return _perms(reorder.by_fiber_parts(x, _mod_parts(spark, structure.fibers(x, 1).count(), "vtx"), 1))


@_query("apply_perm", f"{_with('te', 3, True)} SELECT d0 - 1 - i0 AS i0, i1, d2 - 1 - i2 AS i2, val FROM te, dims")
def apply_perm(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    flip = lambda n: spark.range(n).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new"))
    return reorder.apply(x, {0: flip(x.dims[0]), 2: flip(x.dims[2])}).df


@_query("perm_is_bijection", f"{_with('t3', 3, True)} SELECT d0 AS n, d0 AS distinct_new, CAST(0 AS BIGINT) AS least, d0 - 1 AS most FROM dims")
def perm_is_bijection(spark, sf_dir):
    p = reorder.random_permutation(tensor(spark, sf_dir, "t3"), 0, 3)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new").alias("distinct_new"), F.min("new").alias("least"), F.max("new").alias("most"))


# -- partitions --------------------------------------------------------------------------------------------------------


@_query("partition_simple_bounds", f"{_with('t3', 3, True)} SELECT k, CASE WHEN k = 0 THEN 0 WHEN k = 7 THEN d0 ELSE least(greatest(d0 // 7 * k, 1), d0) END AS bound FROM dims, (SELECT unnest(range(8)) AS k)")
def partition_simple_bounds(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(partition.simple_bounds(tensor(spark, sf_dir, "t3").dims[0], 7))), "k bigint, bound bigint")


@_query("partition_weighted")
def partition_weighted(spark, sf_dir):
    """Bounds and weights of the optimal contiguous partition of T3's first mode into 31 parts."""
    x = tensor(spark, sf_dir, "t3")
    w = partition.mode_weights(x, 0)
    bounds, most = partition.weighted_bounds(w, 31)
    return spark.createDataFrame([(p, a, b, w.below(b) - w.below(a), most) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))], "part int, first bigint, past bigint, weight bigint, bottleneck bigint")


_GIVEN = {0: 4, 1: 2, 2: 2}
_CELL = "CAST(least(i0 // greatest(d0 // 4, 1), 3) * 4 + least(i1 // greatest(d1 // 2, 1), 1) * 2 + least(i2 // greatest(d2 // 2, 1), 1) AS BIGINT)"


def _grid(spark, sf_dir):
    x = tensor(spark, sf_dir, "t3")
    return partition.grid_parts(x, [4, 2, 2], {m: partition.simple_bounds(x.dims[m], n) for m, n in _GIVEN.items()})


_query("grid_partition_nnz", f"{_with('t3', 3, True)} SELECT {_CELL} AS part, count(*) AS nnz, count(DISTINCT i0) AS n_i0, count(DISTINCT i1) AS n_i1, count(DISTINCT i2) AS n_i2 FROM t3, dims GROUP BY 1")(lambda s, d: partition.part_stats(_grid(s, d)))
_query("partition_nnz_stats", f"{_with('t3', 3, True)}, c AS (SELECT {_CELL} AS part, count(*) AS n FROM t3, dims GROUP BY 1) SELECT count(*) AS parts, min(n) AS lightest, max(n) AS heaviest, avg(n) AS average, 100 * (max(n) - avg(n)) / max(n) AS imbalance FROM c")(lambda s, d: partition.balance(_grid(s, d)))
_USED = " UNION ALL ".join(f"SELECT {m} AS mode, i{m} AS i, part FROM x GROUP BY 2, 3" for m in range(3))
_query("comm_volume", f"{_with('t3', 3, True)}, x AS (SELECT *, {_CELL} AS part FROM t3, dims), u AS ({_USED}), o AS (SELECT mode, i, min(part) AS owner FROM u GROUP BY 1, 2) SELECT part, CAST(sum(CASE WHEN part <> owner THEN 1 ELSE 0 END) AS BIGINT) AS volume FROM u JOIN o USING (mode, i) GROUP BY 1")(
    lambda s, d: partition.communication_volume(_grid(s, d), ["i0", "i1", "i2"])
)


@_query("grid_layers")
def grid_layers(spark, sf_dir):
    """Layer bounds of a grid of 12 parts chosen by dims and balanced by nonzeros."""
    x = tensor(spark, sf_dir, "t3")
    rows = [(m, k, b) for m, g in enumerate(partition.grid_dims(x.dims, 12)) for k, b in enumerate(partition.layer_bounds(partition.mode_weights(x, m), g))]
    return spark.createDataFrame(rows, "mode int, k int, bound bigint")


_query("coarse_owners")(lambda s, d: partition.coarse_owners(tensor(s, d, "te"), 4).groupBy("part").agg(F.count(F.lit(1)).alias("nnz")))
_query("fiber_part_stats", f"{_with('t3')}, {_FIBERS} SELECT fiber % 4 AS part, count(DISTINCT fiber) AS fibers, count(*) AS nnz, count(DISTINCT s) AS n_s, count(DISTINCT f0) AS n_f0, count(DISTINCT t3.i0) AS n_leaf FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0 GROUP BY 1")(
    lambda s, d: partition.fiber_part_stats(x := tensor(s, d, "t3"), _mod_parts(s, structure.fibers(x, 1).count(), "vtx"), 1)
)

# -- sources, sinks, streams -------------------------------------------------------------------------------------------


@_query("text_roundtrip", f"{_with('t3')} SELECT * FROM t3")
def text_roundtrip(spark, sf_dir):
    from cootide.sources import text

    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.tns"
    text.write_text(tensor(spark, sf_dir, "t3"), path)
    return materialize(text.read_text(spark, path).df)


@_query("binary_roundtrip", f"{_with('t4')} SELECT * FROM t4")
def binary_roundtrip(spark, sf_dir):
    from cootide.sources import binary

    path = f"{shared_folder(spark)}/binary-{uuid.uuid4().hex}.bin".removeprefix("file://")
    binary.write_binary(tensor(spark, sf_dir, "t4"), path)
    return binary.read_binary(spark, path, nonzeros_per_task=5000).df


@_query("stream_append", f"{_with('gap3')} SELECT i0, i1, i2, sum(val) AS val FROM gap3 GROUP BY ALL")
def stream_append(spark, sf_dir):
    """The tensor of lineitem read as a stream and merged batch by batch."""
    from cootide.streaming import append

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/lineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    x = stream.withColumn("ym", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    append.append_stream(x, ["l_partkey", "l_suppkey", "ym"], "l_quantity", folder + "/table", folder + "/log").awaitTermination()
    return append.read_table(spark, folder + "/table", 3).df
