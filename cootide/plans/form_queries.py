"""Queries over sources and sinks, orders, partitions, statistics and the widest tensor, each with its SQL.

Files are written to and read from the shared folder. Tensors are those of ``tensor_queries`` and N4, the rows of nonzeros
as they were delivered, whose indices come from modes of up to 2^29.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cootide.core import SparseTensor, affine_factor
from cootide.functions import ranking
from cootide.operators import cpd, graphs, kernels, linalg, partition, reorder, stats, structure
from cootide.plans import tensor_queries as base
from cootide.plans.tensor_queries import _EDGES, _FIBERS, _VERTICES, _a, _factor_sql, _mod_parts, _perms, _with, tensor
from cootide.session import materialize, read_table, shared_folder
from cootide.sources import binary, matrices, text

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _path(spark, ending: str = "") -> str:
    return f"{shared_folder(spark)}/form-{uuid.uuid4().hex}{ending}"


def _lines(spark, path: str) -> DataFrame:
    """line_no (from 1), line of a text file, read in pieces whose places in the file number the lines."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1] + 1, x[0]))
    return spark.createDataFrame(lines, "line_no int, line string", verifySchema=False)


def _numbered(sql: str) -> str:
    """Lines (k, line) in order of k as line_no, line."""
    return f"SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS line_no, line FROM ({sql})"


# -- sources -----------------------------------------------------------------------------------------------------------


@_query("file_types", "SELECT file_id, file_name, CASE WHEN lower(file_name) LIKE '%.bin' THEN 'binary' ELSE 'text' END AS kind FROM tns_files")
def file_types(spark, sf_dir):
    rows = read_table(spark, sf_dir, "tns_files").select("file_id", "file_name").collect()  # one row per file
    return spark.createDataFrame([(r["file_id"], r["file_name"], text.format_of(r["file_name"] or "")) for r in rows], "file_id int, file_name string, kind string")


@_query("read_by_name", f"{_with('t4')} SELECT k.kind, i0, i1, i2, i3, val FROM t4, (SELECT unnest(['text', 'binary']) AS kind) k")
def read_by_name(spark, sf_dir):
    """One tensor written and read twice, the form chosen by the file's name."""
    x, out = tensor(spark, sf_dir, "t4"), None
    for ending, kind in ((".tns", "text"), (".bin", "binary")):
        path = _path(spark, ending).removeprefix("file://")
        text.write(x, path)
        part = materialize(text.read(spark, path).df.select(F.lit(kind).alias("kind"), *x.modes, "val"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("from_arrays", "SELECT CAST(n_regionkey AS BIGINT) AS i0, CAST(n_nationkey AS BIGINT) AS i1, CAST(length(n_name) AS DOUBLE) AS val FROM nation")
def from_arrays(spark, sf_dir):
    """A tensor of 1-based index arrays and values."""
    rows = read_table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.length("n_name")).collect()  # a fixed table of 25 rows
    subs = np.array([[r[0] + 1, r[1] + 1] for r in rows])
    return SparseTensor.from_arrays(spark, subs, [r[2] for r in rows], base=1).df


@_query("read_parts", f"{_with('te', 3, True)} SELECT vtx, vtx % 4 AS part FROM (SELECT unnest(range(d0 + d1 + d2)) AS vtx FROM dims)")
def read_parts(spark, sf_dir):
    path = _path(spark)
    n = sum(tensor(spark, sf_dir, "te").dims)
    matrices.write_parts(_mod_parts(spark, n, "vtx"), path.removeprefix("file://"))
    return matrices.read_parts(spark, path, n)


# -- sinks -------------------------------------------------------------------------------------------------------------


@_query("matrix_roundtrip", f"{_with('te', 3, True)} SELECT i, r, {_a(0, 'r', 'i')} AS v FROM (SELECT unnest(range(d0)) AS i FROM dims), (SELECT unnest([0, 1, 2]) AS r)")
def matrix_roundtrip(spark, sf_dir):
    d = tensor(spark, sf_dir, "te").dims[0]
    path = _path(spark)
    matrices.write_matrix(affine_factor(spark, d, 0, 3), path.removeprefix("file://"), d, 3)
    return linalg.to_long(matrices.read_matrix(spark, path))


@_query("vector_lines", _numbered("SELECT n_nationkey AS k, printf('%e', n_nationkey * 1.5) AS line FROM nation"))
def vector_lines(spark, sf_dir):
    path = _path(spark)
    matrices.write_vector(spark, [n * 1.5 for n in range(read_table(spark, sf_dir, "nation").count())], path)
    return _lines(spark, path)


@_query("csr_lines", f"{_with('te', 3, True)}, e AS (SELECT i2 AS row, i0 * d1 + i1 AS col, val FROM te, dims) " + _numbered("SELECT g.k, coalesce(string_agg(col || ' ' || printf('%.6f', val) || ' ', '' ORDER BY col), '') AS line FROM (SELECT unnest(range(d2)) AS k FROM dims) g LEFT JOIN e ON e.row = g.k GROUP BY 1"))
def csr_lines(spark, sf_dir):
    path = _path(spark)
    matrices.write_csr(tensor(spark, sf_dir, "te"), 2, path)
    return _lines(spark, path)


@_query("permutation_lines", f"{_with('te', 3, True)} " + _numbered("SELECT old AS k, CAST(d0 - 1 - old AS VARCHAR) AS line FROM (SELECT unnest(range(d0)) AS old, d0 FROM dims)"))
def permutation_lines(spark, sf_dir):
    n = tensor(spark, sf_dir, "te").dims[0]
    path = _path(spark)
    matrices.write_permutation(spark.range(n).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new")), path.removeprefix("file://"))
    return _lines(spark, path)


@_query("map_lines", f"{_with('gap3')} " + _numbered("SELECT old AS k, CAST(old + 1 AS VARCHAR) AS line FROM (SELECT DISTINCT i2 AS old FROM gap3)"))
def map_lines(spark, sf_dir):
    path = _path(spark)
    matrices.write_map(tensor(spark, sf_dir, "gap3").index_map(2), path)
    return _lines(spark, path)


_ADJACENT = "l AS (SELECT u, string_agg((v + 1) || ' ' || w || ' ', '' ORDER BY v) AS near FROM edges GROUP BY 1)"


def _graph_sql(weighted: bool) -> str:
    own = "(SELECT count(*) FROM te WHERE (mode = 0 AND i0 = i) OR (mode = 1 AND i1 = i) OR (mode = 2 AND i2 = i)) || ' ' || " if weighted else ""
    head = f"(d0 + d1 + d2) || ' ' || (SELECT count(*) // 2 FROM edges) || ' {'011 1' if weighted else '001'}'"
    return f"{_with('te', 3, True)}, {_EDGES}, {_ADJACENT}, {_VERTICES} " + _numbered(f"SELECT -1 AS k, {head} AS line FROM dims UNION ALL SELECT vertices.v, {own}coalesce(near, '') FROM vertices LEFT JOIN l ON l.u = vertices.v")


def _graph_lines(spark, sf_dir, weighted):
    path = _path(spark)
    matrices.write_graph(tensor(spark, sf_dir, "te"), path, weighted)
    return _lines(spark, path)


_query("graph_lines", _graph_sql(False))(lambda s, d: _graph_lines(s, d, False))
_query("graph_weighted_lines", _graph_sql(True))(lambda s, d: _graph_lines(s, d, True))

_FIBER_PINS = f"{_FIBERS}, p AS (SELECT s AS hedge, fiber AS vtx FROM f UNION ALL SELECT d1 + f0, fiber FROM f, dims UNION ALL SELECT d1 + d2 + t3.i0, fiber FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0, dims)"
for _code in (0, 1, 10, 11):
    _own = "g.k % 5 + 1 || ' ' || " if _code % 10 else ""
    _tail = " UNION ALL SELECT 1000000000 + fiber, CAST(nnz AS VARCHAR) FROM f" if _code >= 10 else ""
    _query(
        f"hypergraph_lines_{_code}",
        f"{_with('t3', 3, True)}, {_FIBER_PINS} "
        + _numbered(f"SELECT -1 AS k, (d0 + d1 + d2) || ' ' || (SELECT count(*) FROM f) || '{f' {_code}' if _code else ''}' AS line FROM dims UNION ALL SELECT g.k, {_own}coalesce(string_agg((vtx + 1) || ' ', '' ORDER BY vtx), '') FROM (SELECT unnest(range(d0 + d1 + d2)) AS k FROM dims) g LEFT JOIN p ON p.hedge = g.k GROUP BY g.k{_tail}"),
    )(lambda s, d, c=_code: _hypergraph(s, d, c))


def _hypergraph(spark, sf_dir, code):
    """The fiber hypergraph of a mode as text, with weights of hyperedges (1), vertices (10), both (11) or none."""
    x = tensor(spark, sf_dir, "t3")
    n, f = sum(x.dims), structure.fibers(x, 1)
    path = _path(spark)
    own = spark.range(n).select(F.col("id").alias("hedge"), (F.col("id") % 5 + 1).alias("w")) if code % 10 else None
    matrices.write_hypergraph(graphs.fiber_pins(x, 1), n, f.count(), path, f.select(F.col("fiber").alias("v"), F.col("nnz").alias("w")) if code >= 10 else None, own)
    return _lines(spark, path)


@_query("fiber_matrix", f"{_with('t3')}, {_FIBERS} SELECT f.fiber AS row, t3.i0 AS col, t3.val FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0")
def fiber_matrix(spark, sf_dir):
    return structure.fiber_matrix(tensor(spark, sf_dir, "t3"), 1)


@_query("fiber_matrix_lines", f"{_with('t3')}, {_FIBERS} " + _numbered("SELECT f.fiber AS k, string_agg(t3.i0 || ' ' || printf('%.6f', t3.val) || ' ', '' ORDER BY t3.i0) AS line FROM t3 JOIN f ON t3.i1 = f.s AND t3.i2 = f.f0 GROUP BY 1"))
def fiber_matrix_lines(spark, sf_dir):
    path = _path(spark)
    matrices.write_fiber_matrix(tensor(spark, sf_dir, "t3"), 1, path)
    return _lines(spark, path)


@_query("part_files", f"{_with('t3', 3, True)} SELECT i0, i1, i2, val, {base._CELL} AS part FROM t3, dims")
def part_files(spark, sf_dir):
    """Nonzeros written to one folder per part of a grid and read back with their part."""
    path = _path(spark)
    matrices.write_part_files(base._grid(spark, sf_dir), path)
    return matrices.read_part_files(spark, path, 3)


@_query("binary_part_files", f"{_with('t3')} SELECT * FROM t3")
def binary_part_files(spark, sf_dir):
    """Nonzeros written by every task to a binary file of its own and read back."""
    x = tensor(spark, sf_dir, "t3")
    files = binary.write_binary_parts(x.with_df(x.df.repartition(5)), _path(spark).removeprefix("file://"))
    return binary.binary_parts(spark, [r["path"] for r in files.collect()])


_START = f"{_with('te', 3, True)}, {', '.join(_factor_sql('te', m, 2) for m in range(3))}, {', '.join(f'n{m} AS (SELECT sqrt(sum(r0 * r0)) AS n0, sqrt(sum(r1 * r1)) AS n1 FROM f{m})' for m in range(3))}"


def _start_model(spark, sf_dir):
    """The start by rule as a decomposition: no iteration is run, what follows the iterations normalises it."""
    return cpd.cpd_als(tensor(spark, sf_dir, "te"), 2, cpd.CpdOptions(max_iterations=0, init="affine", compact=False))


@_query("model_files", _START + " SELECT 0 AS mode, i, round(r0 / n0, 6) AS r0, round(r1 / n1, 6) AS r1 FROM f0, n0" + "".join(f" UNION ALL SELECT {m}, i, round(r0 / n0, 6), round(r1 / n1, 6) FROM f{m}, n{m}" for m in (1, 2)))
def model_files(spark, sf_dir):
    """The factors of a saved model as its files give them."""
    model, stem, out = _start_model(spark, sf_dir), _path(spark, "."), None
    model.save(spark, stem)
    for m in range(3):
        x = matrices.read_matrix(spark, f"{stem}mode{m + 1}.mat").select(F.lit(m).alias("mode"), "i", *[F.round(F.col("row")[r], 6).alias(f"r{r}") for r in range(2)])
        out = x if out is None else out.unionByName(x)
    return out


@_query("model_weights", _START + " SELECT CAST(0 AS INTEGER) AS r, round(n0.n0 * n1.n0 * n2.n0, 3) AS weight FROM n0, n1, n2 UNION ALL SELECT 1, round(n0.n1 * n1.n1 * n2.n1, 3) FROM n0, n1, n2")
def model_weights(spark, sf_dir):
    return spark.createDataFrame([(r, round(float(w), 3)) for r, w in enumerate(_start_model(spark, sf_dir).weights)], "r int, weight double")


# -- orders ------------------------------------------------------------------------------------------------------------

_SMALL = "SELECT m, row_number() OVER (ORDER BY d, m) - 1 AS depth FROM d"
_EACH_DIM = "d AS (SELECT unnest([0, 1, 2, 3]) AS m, unnest([d0, d1, d2, d3]) AS d FROM dims)"


@_query(
    "mode_orders",
    f"{_with('t4', 4, True)}, {_EACH_DIM}, small AS ({_SMALL}) SELECT 'small_first' AS policy, m AS mode, depth FROM small UNION ALL SELECT 'big_first', m, row_number() OVER (ORDER BY d DESC, m) - 1 FROM d"
    " UNION ALL SELECT 'in_order_minus_one', m, row_number() OVER (ORDER BY m <> 2, m) - 1 FROM d UNION ALL SELECT 'sorted_minus_one', m, row_number() OVER (ORDER BY m <> 2, d, m) - 1 FROM d UNION ALL SELECT 'custom', m, 3 - m FROM d",
)
def mode_orders(spark, sf_dir):
    """Depth of every mode under each policy."""
    x = tensor(spark, sf_dir, "t4")
    rows = []
    for policy in ("small_first", "big_first", "in_order_minus_one", "sorted_minus_one", "custom"):
        rows += [(policy, m, depth) for m, depth in enumerate(structure.inverse_order(structure.mode_order(x.dims, policy, 2, [3, 2, 1, 0])))]
    return spark.createDataFrame(rows, "policy string, mode int, depth bigint")


@_query(
    "tree_copies",
    f"{_with('t4', 4, True)}, {_EACH_DIM}, small AS ({_SMALL}), last AS (SELECT m AS root FROM small WHERE depth = 3) SELECT 'one' AS copies, 0 AS copy, m AS mode, depth FROM small UNION ALL SELECT 'two', 0, m, depth FROM small"
    " UNION ALL SELECT 'two', 1, m, row_number() OVER (ORDER BY m <> root, d, m) - 1 FROM d, last UNION ALL SELECT 'all', root, m, row_number() OVER (PARTITION BY root ORDER BY m <> root, d, m) - 1 FROM d, (SELECT m AS root FROM d) r",
)
def tree_copies(spark, sf_dir):
    x = tensor(spark, sf_dir, "t4")
    rows = [(copies, n, m, depth) for copies in ("one", "two", "all") for n, order in enumerate(structure.tree_orders(x.dims, copies)) for m, depth in enumerate(structure.inverse_order(order))]
    return spark.createDataFrame(rows, "copies string, copy int, mode int, depth bigint")


_DEEP = "least(i2 // greatest(d2 // 3, 1), 2) + 3 * least(i1 // greatest(d1 // 3, 1), 2)"
_query("deep_tiles", f"{_with('te', 3, True)} SELECT i0, i1, i2, val, CAST({_DEEP} AS BIGINT) AS tile FROM te, dims")(lambda s, d: structure.deep_tiles(tensor(s, d, "te"), [0, 1, 2], 3, 2))
_query("tree_stats", f"{_with('te', 3, True)}, t AS (SELECT count(DISTINCT {_DEEP}) AS used, count(*) AS nnz FROM te, dims) SELECT 3 AS nmodes, nnz, '0->1->2' AS mode_order, '1x3x3' AS tile_dims, CAST(9 AS BIGINT) AS ntiles, 9 - used AS empty, round(100.0 * (9 - used) / 9, 1) AS empty_percent FROM t")(
    lambda s, d: stats.tree_stats(tensor(s, d, "te"), [0, 1, 2], 3, 2)
)
_query("sorted_in_tiles", f"{_with('te', 3, True)}, x AS (SELECT te.*, CAST({base._TILE} AS BIGINT) AS tile FROM te, dims) SELECT i0, i1, i2, val, tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY i1, i2, i0) - 1 AS BIGINT) AS at FROM x")(lambda s, d: _sorted_in_tiles(s, d))


def _sorted_in_tiles(spark, sf_dir):
    """Nonzeros with their position in their tile, as a scan of the sorted tiles meets them."""
    import pyarrow as pa

    x = tensor(spark, sf_dir, "te")
    tile = structure.with_tiles(x, base._TILES).schema  # the columns
    cuts = [structure.tile_coordinate(F.col(f"i{m}"), d, c) for m, (d, c) in enumerate(zip(x.dims, base._TILES))]
    laid = x.sorted_within(cuts[0] * 12 + cuts[1] * 4 + cuts[2], 1)

    def count(batches):
        last, at = None, -1
        for b in batches:
            out = []
            for t in b.column("tile").to_pylist():
                at = at + 1 if t == last else 0
                last = t
                out.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "at"])

    return laid.select(*tile.names).mapInArrow(count, "i0 bigint, i1 bigint, i2 bigint, val double, tile bigint, at bigint")


_query("slice_pointers", f"{_with('t3', 3, True)}, {_FIBERS}, h AS (SELECT g.s, count(f.fiber) AS fibers FROM (SELECT unnest(range(d1)) AS s FROM dims) g LEFT JOIN f ON f.s = g.s GROUP BY 1) SELECT s, fibers, CAST(coalesce(sum(fibers) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h")(lambda s, d: structure.slice_pointers(tensor(s, d, "t3"), 1))
_query("slab_pointers", f"{_with('t3', 3, True)}, {_FIBERS}, h AS (SELECT g.slab, count(f.fiber) AS fibers FROM (SELECT unnest(range((d1 + 31) // 32)) AS slab FROM dims) g LEFT JOIN f ON f.s // 32 = g.slab GROUP BY 1) SELECT slab, fibers, CAST(coalesce(sum(fibers) OVER (ORDER BY slab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h")(lambda s, d: structure.slab_pointers(tensor(s, d, "t3"), 1))
_query("fiber_pointers", f"{_with('t3')}, {_FIBERS} SELECT fiber, CAST(coalesce(sum(nnz) OVER (ORDER BY fiber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f")(lambda s, d: structure.fiber_pointers(tensor(s, d, "t3"), 1))


@_query("fiber_storage", f"{_with('t3', 3, True)}, {_FIBERS}, n AS (SELECT count(*) AS nfibs, sum(nnz) AS nnz FROM f) SELECT CAST(nnz * 16 + (nfibs + 1) * 8 + nfibs * 8 + (d1 + 1) * 8 AS BIGINT) AS by_slices, CAST(nnz * 16 + (nfibs + 1) * 8 + nfibs * 8 + ((d1 + 31) // 32 + 1) * 8 + nfibs * 8 AS BIGINT) AS by_slabs FROM n, dims")
def fiber_storage(spark, sf_dir):
    x = tensor(spark, sf_dir, "t3")
    return spark.createDataFrame([(structure.fiber_storage(x, 1), structure.fiber_storage(x, 1, True))], "by_slices bigint, by_slabs bigint")


@_query("permuted_rows", f"{_with('te', 3, True)}, {_factor_sql('te', 0, 2)} SELECT d0 - 1 - i AS i, r0, r1 FROM f0, dims")
def permuted_rows(spark, sf_dir):
    n = tensor(spark, sf_dir, "te").dims[0]
    flip = spark.range(n).select(F.col("id").alias("old"), (n - 1 - F.col("id")).alias("new"))
    return base._columns(reorder.apply_rows(affine_factor(spark, n, 0, 2), flip), 2)


@_query("reordered_by_graph", f"{_with('te', 3, True)}, {_VERTICES}, p AS (SELECT mode, i AS old, row_number() OVER (PARTITION BY mode ORDER BY v % 4, v) - 1 AS new FROM vertices) SELECT a.new AS i0, b.new AS i1, c.new AS i2, val FROM te JOIN p a ON a.mode = 0 AND a.old = i0 JOIN p b ON b.mode = 1 AND b.old = i1 JOIN p c ON c.mode = 2 AND c.old = i2")
def reordered_by_graph(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    return reorder.reorder(x, "graph", parts=_mod_parts(spark, sum(x.dims), "v"))[0].df


_query("identity_order", f"{_with('te', 3, True)}, {_VERTICES} SELECT mode, i AS old, i AS new FROM vertices")(lambda s, d: _perms({m: reorder.identity(tensor(s, d, "te"), m) for m in range(3)}))


@_query("random_orders", f"{_with('te', 3, True)} SELECT unnest([0, 1, 2]) AS mode, unnest([d0, d1, d2]) AS n, unnest([d0, d1, d2]) AS olds, unnest([d0, d1, d2]) AS news, CAST(0 AS BIGINT) AS least, unnest([d0, d1, d2]) - 1 AS most, TRUE AS kept FROM dims")
def random_orders(spark, sf_dir):
    """The permutations of a random reordering are bijections, and undoing them gives the tensor back."""
    x = tensor(spark, sf_dir, "te")
    y, perms = reorder.reorder(x, "random", seed=5)
    back = reorder.apply(y, {m: reorder.inverse(p) for m, p in perms.items()}).df
    kept = not back.exceptAll(x.df).limit(1).count() and not x.df.exceptAll(back).limit(1).count()
    each = _perms(perms).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("old").alias("olds"), F.count_distinct("new").alias("news"), F.min("new").alias("least"), F.max("new").alias("most"))
    return each.withColumn("kept", F.lit(kept))


# -- dense algebra and statistics ----------------------------------------------------------------------------------------

_G1 = "(SELECT sum(r0 * r0) AS a, sum(r0 * r1) AS b, sum(r1 * r1) AS c FROM f0)"


@_query(
    "cholesky",
    f"{_with('te', 3, True)}, {_factor_sql('te', 0, 2)} SELECT 'factor' AS what, unnest([0, 1, 1]) AS r, unnest([0, 0, 1]) AS s, round(unnest([sqrt(a), b / sqrt(a), sqrt(c - b * b / a)]), 6) AS v FROM {_G1}"
    f" UNION ALL SELECT 'inverse', unnest([0, 0, 1, 1]), unnest([0, 1, 0, 1]), round(unnest([c, -b, -b, a]) / (a * c - b * b) * 1000, 6) FROM {_G1}",
)
def cholesky(spark, sf_dir):
    """The Cholesky factor of a Gram matrix, and a thousand times its inverse."""
    g = linalg.gram(affine_factor(spark, tensor(spark, sf_dir, "te").dims[0], 0, 2), 2)
    low, inv = linalg.cholesky(g), linalg.symmetric_inverse(g)
    rows = [("factor", r, s, round(float(low[r, s]), 6)) for r in range(2) for s in range(r + 1)] + [("inverse", r, s, round(float(inv[r, s]) * 1000, 6)) for r in range(2) for s in range(2)]
    return spark.createDataFrame(rows, "what string, r int, s int, v double")


@_query("solve_singular", f"{_with('te', 3, True)}, m AS (SELECT i0 AS i, sum(val * {_a(1, 0, 'i1')} * {_a(2, 0, 'i2')}) AS r0 FROM te GROUP BY 1), g AS (SELECT sum({_a(1, 0, 'i')} * {_a(1, 0, 'i')}) AS a FROM (SELECT unnest(range(d1)) AS i FROM dims)), h AS (SELECT sum({_a(2, 0, 'i')} * {_a(2, 0, 'i')}) AS b FROM (SELECT unnest(range(d2)) AS i FROM dims)) SELECT i, round(r0 / (2 * a * b), 6) AS x0, round(r0 / (2 * a * b), 6) AS x1 FROM m, g, h")
def solve_singular(spark, sf_dir):
    """Normal equations of two equal columns: the solution of least norm shares the value between them."""
    x = tensor(spark, sf_dir, "te")
    one = [affine_factor(spark, d, m, 1) for m, d in enumerate(x.dims)]
    twice = [f.select("i", F.array(F.col("row")[0], F.col("row")[0]).alias("row")) for f in one]
    h = linalg.hadamard([linalg.gram(f, 2) for f in twice], 0)
    solved = linalg.solve_rows(kernels.mttkrp(x, twice, 0, 2), h)
    return solved.select("i", F.round(F.col("row")[0], 6).alias("x0"), F.round(F.col("row")[1], 6).alias("x1"))


@_query("random_start", f"{_with('te', 3, True)} SELECT unnest([0, 1, 2]) AS mode, unnest([d0, d1, d2]) * 4 AS n, TRUE AS in_range, TRUE AS varied FROM dims")
def random_start(spark, sf_dir):
    """Random factors: how many values, whether all lie in (-3, 3), and whether no two in a thousand are equal."""
    x = tensor(spark, sf_dir, "te")
    out = None
    for m, d in enumerate(x.dims):
        v = linalg.to_long(cpd.start_factor(spark, d, m, 4, cpd.CpdOptions(seed=4)))
        row = v.agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("v") < 3).alias("in_range"), (F.count_distinct("v") * 1000 > 999 * F.count(F.lit(1))).alias("varied"))
        out = row if out is None else out.unionByName(row)
    return out


@_query(
    "storage_text",
    f"{_with('t3')}, x AS (SELECT * FROM (SELECT count(*) * 32 AS b FROM t3) UNION ALL SELECT unnest([0, 1, 1023, 1024, 1025, 1048576, 1048577, 5000000000, 3000000000000]))"
    " SELECT b, CASE WHEN b <= 1024 THEN printf('%.2fB', b * 1.0::DOUBLE) WHEN b <= 1048576 THEN printf('%.2fKB', b / 1024.0::DOUBLE) WHEN b <= 1073741824 THEN printf('%.2fMB', b / 1048576.0::DOUBLE) WHEN b <= 1099511627776 THEN printf('%.2fGB', b / 1073741824.0::DOUBLE) ELSE printf('%.2fTB', b / 1099511627776.0::DOUBLE) END AS size FROM x",
)
def storage_text(spark, sf_dir):
    x = tensor(spark, sf_dir, "t3")
    sizes = [stats.coordinate_bytes(x.nnz(), 3), 0, 1, 1023, 1024, 1025, 1 << 20, (1 << 20) + 1, 5_000_000_000, 3_000_000_000_000]
    return spark.createDataFrame([(b, stats.bytes_text(b)) for b in sizes], "b bigint, size string")


@_query("extreme_slices", f"{_with('t3', 3, True)} " + " UNION ALL ".join(f"SELECT {m} AS mode, (SELECT i{m} FROM t3 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most, (SELECT g.i FROM (SELECT unnest(range(d{m})) AS i FROM dims) g LEFT JOIN t3 ON t3.i{m} = g.i GROUP BY 1 ORDER BY count(t3.val), 1 LIMIT 1) AS fewest" for m in range(3)))
def extreme_slices(spark, sf_dir):
    """The first slice of each mode with most and with fewest nonzeros."""
    x = tensor(spark, sf_dir, "t3")
    return spark.createDataFrame([(m, x.extreme_slice(m)[0], x.extreme_slice(m, False)[0]) for m in range(3)], "mode int, most bigint, fewest bigint")


@_query("kernel_choice", f"{_with('t3', 3, True)}, n AS (SELECT count(*) AS nnz FROM t3), f AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT i1, i2 FROM t3)) AS fibers) SELECT CASE WHEN nnz >= 3 * fibers THEN 'fiber' ELSE 'wide' END AS small_rank, 'arrow' AS large_rank, d2 * 8 <= 0.02 * nnz AS private_leaf FROM n, f, dims")
def kernel_choice(spark, sf_dir):
    """The product plan by rank and fiber length, and whether tasks may keep sums of the last mode of their own."""
    x = tensor(spark, sf_dir, "t3")
    nnz, fibers = x.nnz(), x.df.select("i1", "i2").distinct().count()
    return spark.createDataFrame([(kernels.choose_plan(x.dims, 1, 4, nnz, fibers), kernels.choose_plan(x.dims, 1, 64), kernels.is_private(x.dims[2], nnz, 8))], "small_rank string, large_rank string, private_leaf boolean")


_query("mttkrp_m0_r50", base._mttkrp_sql("te", 3, 0, 50))(lambda s, d: base._columns(kernels.mttkrp(x := tensor(s, d, "te"), base._factors(x, 50), 0, 50, plan="blocked"), 50))


@_query("task_imbalance", "SELECT TRUE AS timed, round(100.0 * (4 - 2.5) / 4, 6) AS imbalance")
def task_imbalance(spark, sf_dir):
    """Whether every task of a scan was timed, and the imbalance of given times."""
    df = tensor(spark, sf_dir, "t3").df
    times = stats.task_times(df)
    return spark.createDataFrame([(len(times) == df.rdd.getNumPartitions() and min(times) >= 0, round(stats.imbalance([1.0, 2.0, 3.0, 4.0])[2], 6))], "timed boolean, imbalance double")


@_query("bench_sweep", "SELECT unnest(['wide', 'wide', 'wide', 'wide', 'wide', 'wide']) AS plan, unnest([1, 1, 1, 4, 4, 4]) AS parts, unnest([0, 1, 2, 0, 1, 2]) AS mode, TRUE AS timed")
def bench_sweep(spark, sf_dir):
    """Every mode of a plan timed on one and on four partitions."""
    rows = stats.sweep(tensor(spark, sf_dir, "te"), ["wide"], [1, 4], 4, 1)
    return spark.createDataFrame([(plan, n, m, s > 0) for plan, n, m, s in rows], "plan string, parts int, mode int, timed boolean")


@_query("model_banner", f"{_with('te', 3, True)}, n AS (SELECT count(*) AS nnz FROM te) SELECT 'DIMS=' || d0 || 'x' || d1 || 'x' || d2 || ' NNZ=' || nnz || ' RANK=8' AS line FROM n, dims UNION ALL SELECT 'TOLERANCE=1e-05 MAX-ITERATIONS=50 REGULARIZATION=0 SEED=1 START=random'")
def model_banner(spark, sf_dir):
    """What a decomposition logs of its tensor and settings."""
    x = tensor(spark, sf_dir, "te")
    return spark.createDataFrame([(line,) for line in cpd.describe(x, 8, cpd.CpdOptions(seed=1)).split("\n")[:2]], "line string")


# -- partitions --------------------------------------------------------------------------------------------------------


def _prefix(mode: int, which: str = "t3") -> str:
    """pre{mode}: n, w: nonzeros below n, for n of 0 to the dim."""
    counts = f"SELECT g.n, count(x.i{mode}) AS c FROM (SELECT unnest(range(d{mode} + 1)) AS n FROM dims) g LEFT JOIN {which} x ON x.i{mode} = g.n - 1 GROUP BY 1"
    return f"pre{mode} AS MATERIALIZED (SELECT n, CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS w FROM ({counts}))"


def _optimal_sql(mode: int, parts: int) -> str:
    """The least heaviest part by dynamic programming over parts, then bounds filled up to it."""
    ctes = [_prefix(mode), f"best1 AS (SELECT n, w AS most FROM pre{mode})"]
    for p in range(2, parts + 1):
        ctes.append(f"best{p} AS MATERIALIZED (SELECT b.n, min(greatest(a.most, b.w - pa.w)) AS most FROM pre{mode} b JOIN pre{mode} pa ON pa.n <= b.n JOIN best{p - 1} a ON a.n = pa.n GROUP BY 1)")
    ctes += [f"top AS MATERIALIZED (SELECT most FROM best{parts} WHERE n = (SELECT d{mode} FROM dims))", "b0 AS (SELECT 0 AS n, 0 AS w)"]
    for p in range(1, parts + 1):
        ctes.append(f"b{p} AS MATERIALIZED (SELECT pre.n, pre.w FROM pre{mode} pre, b{p - 1}, top WHERE pre.w <= b{p - 1}.w + most ORDER BY pre.n DESC LIMIT 1)")
    rows = " UNION ALL ".join(f"SELECT {p} AS part, b{p}.n AS first, b{p + 1}.n AS past, CAST(b{p + 1}.w - b{p}.w AS BIGINT) AS weight, CAST(most AS BIGINT) AS bottleneck FROM b{p}, b{p + 1}, top" for p in range(parts))
    return f"{_with('t3', 3, True)}, {', '.join(ctes)} {rows}"


def _optimal(spark, sf_dir, mode, parts):
    x = tensor(spark, sf_dir, "t3")
    w = partition.mode_weights(x, mode)
    bounds, most = partition.weighted_bounds(w, parts)
    return spark.createDataFrame([(p, a, b, w.below(b) - w.below(a), most) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))], "part int, first bigint, past bigint, weight bigint, bottleneck bigint")


_query("partition_optimal", _optimal_sql(2, 7))(lambda s, d: _optimal(s, d, 2, 7))
_query("partition_optimal_m1", _optimal_sql(1, 4))(lambda s, d: _optimal(s, d, 1, 4))


@_query("partition_roots", _optimal_sql(2, 5))
def partition_roots(spark, sf_dir):
    """The roots of a fiber tree in five parts by the nonzeros below them."""
    x = tensor(spark, sf_dir, "t3")
    bounds, most = partition.tree_partition(x, [2, 1, 0], 5)
    w = partition.mode_weights(x, 2)
    return spark.createDataFrame([(p, a, b, w.below(b) - w.below(a), most) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))], "part int, first bigint, past bigint, weight bigint, bottleneck bigint")


def _tile_parts_sql() -> str:
    sql = _optimal_sql(9, 4).replace(_with("t3", 3, True), f"{_with('te', 3, True)}, tiles AS (SELECT {base._TILE} AS tile FROM te, dims)")
    return sql.replace(_prefix(9), "pre9 AS (SELECT g.n, (SELECT count(*) FROM tiles WHERE tile < g.n) AS w FROM (SELECT unnest(range(49)) AS n) g)").replace("(SELECT d9 FROM dims)", "48")


@_query("partition_tiles", _tile_parts_sql())
def partition_tiles(spark, sf_dir):
    """Dense tiles in four contiguous parts by their nonzeros."""
    x = tensor(spark, sf_dir, "te")
    bounds, most = partition.tile_partition(x, base._TILES, 4)
    counts = {r["tile"]: r["nnz"] for r in structure.tile_pointers(x, base._TILES).collect()}  # 48 rows
    return spark.createDataFrame([(p, a, b, sum(counts[t] for t in range(a, b)), most) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))], "part int, first bigint, past bigint, weight bigint, bottleneck bigint")


def _layer_ctes(mode: int, layers: int | str, most: int | None = None, which: str = "t3") -> list[str]:
    """y{mode}_k: the k-th bound of the greedy layers of a mode, the weight counted as done, and the next target; ``layers``
    may be an expression of at most ``most``."""
    total = f"(SELECT max(w) FROM pre{mode})"
    ctes = [_prefix(mode, which), f"y{mode}_0 AS (SELECT 0 AS at, 0 AS done, {total} // {layers} AS target)"]
    for k in range(1, most or layers):
        y = f"y{mode}_{k - 1}"
        reach = f"(SELECT min(n) FROM pre{mode} WHERE w >= {y}.done + {y}.target AND n >= {y}.at + 1)"
        ctes.append(f"z{mode}_{k} AS MATERIALIZED (SELECT least(coalesce({reach}, d{mode}), d{mode}) AS at, {y}.done + {y}.target AS goal FROM {y}, dims)")
        done = "CASE WHEN goal - lo.w >= 0 AND goal - lo.w < hi.w - goal THEN lo.w ELSE hi.w END"
        ctes.append(f"y{mode}_{k} AS MATERIALIZED (SELECT z.at, {done} AS done, ({total} - ({done})) // greatest(1, {layers} - {k}) AS target FROM z{mode}_{k} z JOIN pre{mode} hi ON hi.n = z.at JOIN pre{mode} lo ON lo.n = z.at - 1)")
    return ctes


def _layer_rows(mode: int, layers: int | str, most: int | None = None) -> str:
    ends = [f"SELECT {mode} AS mode, {k} AS k, y{mode}_{k}.at AS bound FROM y{mode}_{k}" + (f" WHERE {k} < {layers}" if most else "") for k in range(most or layers)]
    return " UNION ALL ".join([*ends, f"SELECT {mode}, CAST({layers} AS INTEGER), d{mode} FROM dims"])


_LAYERS = {0: 4, 1: 3, 2: 5}
_query("layers_by_weight", f"{_with('t3', 3, True)}, {', '.join(c for m, n in _LAYERS.items() for c in _layer_ctes(m, n))} {' UNION ALL '.join(_layer_rows(m, n) for m, n in _LAYERS.items())}")(
    lambda s, d: s.createDataFrame([(m, k, b) for m, n in _LAYERS.items() for k, b in enumerate(partition.layer_bounds(partition.mode_weights(tensor(s, d, "t3"), m), n))], "mode int, k int, bound bigint")
)


def _grid_sql(primes: list[int]) -> str:
    """The grid by prime factors, largest first, one step each."""
    n = int(np.prod(primes))
    ctes = [f"s{n}_0 AS (SELECT 1 AS g0, 1 AS g1, 1 AS g2, d0, d1, d2, (d0 + d1 + d2) // {n} AS goal FROM dims)"]
    for k, p in enumerate(primes):
        e = [f"greatest(0, d{m} // g{m} - goal)" for m in range(3)]
        pick = f"CASE WHEN {e[0]} >= {e[1]} AND {e[0]} >= {e[2]} THEN 0 WHEN {e[1]} >= {e[2]} THEN 1 ELSE 2 END"
        ctes.append(f"p{n}_{k} AS (SELECT *, {pick} AS pick FROM s{n}_{k})")
        ctes.append(f"s{n}_{k + 1} AS (SELECT {', '.join(f'CASE WHEN pick = {m} THEN g{m} * {p} ELSE g{m} END AS g{m}' for m in range(3))}, d0, d1, d2, goal FROM p{n}_{k})")
    return ", ".join([*ctes, f"grid{n} AS (SELECT {n} AS parts, g0, g1, g2 FROM s{n}_{len(primes)})"])


_query("grid_by_primes", f"{_with('t3', 3, True)}, {_grid_sql([3, 2, 2])}, {_grid_sql([7, 5])}, {_grid_sql([2, 2, 2, 2])} SELECT * FROM grid12 UNION ALL SELECT * FROM grid35 UNION ALL SELECT * FROM grid16")(
    lambda s, d: s.createDataFrame([(n, *partition.grid_dims(tensor(s, d, "t3").dims, n)) for n in (12, 35, 16)], "parts int, g0 int, g1 int, g2 int")
)

_OWNER = {m: " + ".join(f"(te.i{m} >= (SELECT y.at FROM y{m}_{k} y))::INT" for k in range(1, 4)) for m in range(3)}
SQL["coarse_owners"] = f"{_with('te', 3, True)}, {', '.join(c for m in range(3) for c in _layer_ctes(m, 4, None, 'te'))}, o AS (SELECT i0, i1, i2, {', '.join(f'{_OWNER[m]} AS o{m}' for m in range(3))} FROM te), c AS (SELECT DISTINCT i0, i1, i2, unnest([o0, o1, o2]) AS part FROM o) SELECT CAST(part AS BIGINT) AS part, count(*) AS nnz FROM c GROUP BY 1"
_PARTS_OF = {m: f"(SELECT g{m} FROM grid12)" for m in range(3)}
SQL["grid_layers"] = f"{_with('t3', 3, True)}, {_grid_sql([3, 2, 2])}, {', '.join(c for m in range(3) for c in _layer_ctes(m, _PARTS_OF[m], 12))} {' UNION ALL '.join(_layer_rows(m, _PARTS_OF[m], 12) for m in range(3))}"
SQL["partition_weighted"] = _optimal_sql(0, 31)


@_query("fine_parts", f"{_with('te')} SELECT id, i0, i1, i2, val, id % 5 AS part FROM (SELECT *, row_number() OVER (ORDER BY i0, i1, i2) - 1 AS id FROM te)")
def fine_parts(spark, sf_dir):
    x = tensor(spark, sf_dir, "te")
    ids = ranking.global_rank(x.df, x.modes, "id")
    return partition.fine_parts(ids, _mod_parts(spark, x.nnz(), "id", 5)).select("id", *x.modes, "val", "part")


_USED = f"x AS (SELECT *, {base._CELL} AS part FROM t3, dims), u AS ({base._USED})"
_query("layered_volume", f"{_with('t3', 3, True)}, {_USED}, o AS (SELECT mode, i, min(part) AS owner FROM u GROUP BY 1, 2) SELECT part, CAST(sum(CASE WHEN part <> owner THEN CASE WHEN mode = 2 THEN 1 ELSE 2 END ELSE 0 END) AS BIGINT) AS volume FROM u JOIN o USING (mode, i) GROUP BY 1")(
    lambda s, d: partition.communication_volume(base._grid(s, d), ["i0", "i1", "i2"], {0: 4, 1: 2, 2: 1})
)


@_query("claimed_rows", f"{_with('t3', 3, True)}, {_USED}, n AS (SELECT mode, i, count(*) AS users FROM u GROUP BY 1, 2) SELECT CAST(mode AS INTEGER) AS mode, count(*) AS n_rows, CAST(0 AS BIGINT) AS strangers, CAST(sum(users) - count(*) AS BIGINT) AS volume, TRUE AS balanced FROM n GROUP BY 1")
def claimed_rows(spark, sf_dir):
    """Owners of factor rows: all used rows have one, none is a stranger to its row, copies sent, and whether no part owns
    more than the rows only it uses, or else half above an equal share and a few."""
    modes = ["i0", "i1", "i2"]
    parts = materialize(base._grid(spark, sf_dir))
    owners = materialize(partition.claim_rows(parts, modes, 16))
    used = partition._used(parts, modes)
    users = used.groupBy("mode", "i").agg(F.count(F.lit(1)).alias("users"), F.collect_set("part").alias("by"))  # at most 16 parts
    own = owners.join(users, ["mode", "i"])
    per = own.groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.array_contains("by", F.col("owner"))).alias("strangers"), F.sum(F.col("users") - 1).alias("volume"))
    loads = own.groupBy("mode", "owner").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("users") == 1).alias("forced")).withColumn("all", F.sum("n").over(base.Window.partitionBy("mode")))
    fair = loads.groupBy("mode").agg(F.bool_and(F.col("n") <= F.greatest("forced", 1.5 * F.col("all") / 16 + 8)).alias("balanced"))
    return per.join(fair, "mode").select("mode", "n_rows", "strangers", "volume", "balanced")


for _method, _part in (("range", "row_number() OVER (ORDER BY v) - 1"), ("weighted", "coalesce(sum(w) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")):
    _all = "count(*) OVER ()" if _method == "range" else "sum(w) OVER ()"
    _query(f"vertices_by_{_method}", f"{_with('te', 3, True)}, {_VERTICES}, x AS (SELECT v, (SELECT count(*) FROM te WHERE (mode = 0 AND i0 = i) OR (mode = 1 AND i1 = i) OR (mode = 2 AND i2 = i)) AS w FROM vertices) SELECT v, CAST(least(({_part}) * 6 // {_all}, 5) AS INTEGER) AS part FROM x")(
        lambda s, d, m=_method: graphs.partition_vertices(graphs.vertex_weights(tensor(s, d, "te")), 6, m)
    )

# -- the widest tensor -------------------------------------------------------------------------------------------------

N4_DIMS = [1 << 24, 1 << 25, 1 << 29, 1 << 11]
_N4 = "n4 AS (SELECT i0, i1, i2, i3, val FROM nonzeros WHERE i0 IS NOT NULL AND i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL AND val IS NOT NULL)"


def _n4(spark, sf_dir) -> SparseTensor:
    cols = ["i0", "i1", "i2", "i3"]
    return SparseTensor.from_dataframe(read_table(spark, sf_dir, "nonzeros").select(*cols, "val").dropna(), cols, "val", N4_DIMS)


_query("unfold_wide", f"WITH {_N4} SELECT i0 AS row, i1, i2, i3, val FROM n4")(lambda s, d: _n4(s, d).unfold(0).select("row", "col.*", "val"))
_query("unfold_wide_codes", f"WITH {_N4} SELECT i0 AS row, CAST((CAST(i1 AS HUGEINT) * 536870912 + i2) * 2048 + i3 AS VARCHAR) AS col, val FROM n4")(lambda s, d: _n4(s, d).unfold(0, wide="decimal").select("row", F.col("col").cast("string").alias("col"), "val"))
_query("mttkrp_unfold_wide", f"WITH {_N4} SELECT i0 AS i, {', '.join(f'round(sum(val * {_a(1, r, chr(105) + str(1))} * {_a(3, r, chr(105) + str(3))} * {_a(2, r, chr(105) + str(2))}), 6) AS r{r}' for r in range(2))} FROM n4 GROUP BY 1")(lambda s, d: _wide_product(s, d))


def _wide_product(spark, sf_dir):
    """The product through the unfolding of a mode whose columns exceed 64 bits; factors of used rows only."""
    x = _n4(spark, sf_dir)
    f = {m: x.df.select(F.col(f"i{m}").alias("i")).distinct().select("i", *[base.affine_row(F.col("i"), m, 2).alias("row")]) for m in (1, 2, 3)}
    y = kernels.mttkrp(x, f, 0, 2, plan="unfold")
    return y.select("i", *[F.round(F.col("row")[r], 6).alias(f"r{r}") for r in range(2)])


_query("layers_wide", f"WITH {_N4}, c AS (SELECT i2 AS i, count(*) AS n FROM n4 GROUP BY 1), e AS (SELECT i, sum(n) OVER (ORDER BY i) AS w FROM c), t AS (SELECT max(w) AS w FROM e) SELECT CAST(0 AS INTEGER) AS k, CAST(0 AS BIGINT) AS bound UNION ALL SELECT 1, (SELECT min(i) + 1 FROM e, t WHERE e.w >= t.w // 2) UNION ALL SELECT 2, 536870912")(
    lambda s, d: s.createDataFrame(list(enumerate(partition.layer_bounds(partition.mode_weights(_n4(s, d), 2), 2))), "k int, bound bigint")
)


@_query("partition_wide", f"WITH {_N4}, c AS (SELECT i2 AS i, count(*) AS n FROM n4 GROUP BY 1), e AS (SELECT i, n, sum(n) OVER (ORDER BY i) AS w FROM c), t AS (SELECT max(w) AS w FROM e), b AS (SELECT min(greatest(e.w, t.w - e.w)) AS most FROM e, t) SELECT CAST(most AS BIGINT) AS bottleneck, (SELECT count(*) FROM n4) AS nnz, TRUE AS holds FROM b")
def partition_wide(spark, sf_dir):
    """The best cut in two of a mode of 2^29 indices, by weights of which the driver holds one row per block."""
    x = _n4(spark, sf_dir)
    w = partition.mode_weights(x, 2)
    bounds, most = partition.weighted_bounds(w, 2)
    parts = [w.below(b) - w.below(a) for a, b in zip(bounds, bounds[1:])]
    return spark.createDataFrame([(most, w.total, max(parts) == most and sum(parts) == w.total)], "bottleneck bigint, nnz bigint, holds boolean")
