"""Queries p3_ and p4_: skewed keys and lines that fail to parse, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cootide.operators.lenient import parse_lines
from cootide.operators.skew import keyed_fiber_counts
from cootide.session import read_table


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "nonzeros").select("run_id", "i0", "i1", "val")
    stats = read_table(spark, sf_dir, "slice_stats").select("run_id", "i0", "nnz", "nfibs")
    return keyed_fiber_counts(rows, stats, ["run_id", "i0"], "i1", "val")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded slices whose fiber count differs from the fibers among the rows."""
    return _slices(spark, sf_dir).where(F.col("has_match") & F.col("nfibs").isNotNull() & (F.col("nfibs") != F.col("n_fibers"))).select("run_id", "i0")


def p3_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, fibers and sum of values of every slice, with the recorded fiber count."""
    x = _slices(spark, sf_dir).where("has_rows")
    return x.select("run_id", "i0", "n_rows", "n_fibers", F.round("sum_value", 3).alias("sum_val"), F.col("nfibs").alias("recorded_nfibs"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(read_table(spark, sf_dir, "tns_lines"), read_table(spark, sf_dir, "tns_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no valid nonzero, with the first reason that applies."""
    return _lines(spark, sf_dir).where("reason IS NOT NULL").select("line_id", "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded nonzeros per line: 0-based indices, joined by commas, and the value."""
    x = _lines(spark, sf_dir).where("reason IS NULL")
    return x.select("line_id", "file_id", "line_no", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"), "value")


def p4_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set apart with reason, cost of the cheapest mending and its edits."""
    return _lines(spark, sf_dir).where("reason IS NOT NULL").select("line_id", "file_id", "line_no", "reason", "cost", "edits")


def p4_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and number of edits of lines without any quote that have a wrong number of fields."""
    lines = read_table(spark, sf_dir, "tns_lines").where(~F.col("raw_line").contains('"'))
    x = parse_lines(lines, read_table(spark, sf_dir, "tns_files")).where("reason = 'columns'")
    return x.select("line_id", "cost", F.size(F.split("edits", "; ")).alias("n_edits"))


QUERIES = {f.__name__: f for f in (p3_found, p3_slices, p4_found, p4_loaded, p4_edits, p4_costs)}

_FIELD = r"""("[^"]*"|[^" \t]+)"""
_LINES = rf"""
    WITH a AS (SELECT line_id, file_id, line_no, CASE WHEN suffix(raw_line, chr(13)) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line FROM tns_lines),
    b AS (SELECT a.*, f.nmodes, f.index_base, f.dims,
            regexp_full_match(line, '[ \t]*{_FIELD}([ \t]+{_FIELD})*[ \t]*', 's') AS quoted,
            list_transform(regexp_extract_all(line, '{_FIELD}', 1), lambda x : trim(x, '"')) AS parts
          FROM a JOIN tns_files f USING (file_id) WHERE NOT starts_with(line, '#') AND trim(line, ' ' || chr(9)) <> ''),
    c AS (SELECT *, list_transform(range(1, nmodes + 1), lambda m : CASE WHEN regexp_full_match(parts[m], '[0-9]+') THEN try_cast(parts[m] AS HUGEINT) - index_base END) AS idx,
            CASE WHEN regexp_full_match(parts[nmodes + 1], '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(parts[nmodes + 1] AS DOUBLE) END AS v
          FROM b),
    d AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(parts) <> nmodes + 1 THEN 'columns'
            WHEN len(list_filter(range(1, nmodes + 1), lambda m : idx[m] IS NULL OR idx[m] < 0 OR idx[m] >= dims[m])) > 0 THEN 'indices'
            WHEN v IS NULL OR isinf(v) OR isnan(v) THEN 'values' END AS reason FROM c)
"""
_SLICES = """
    WITH s AS (SELECT run_id, i0, count(*) AS n_rows, count(DISTINCT i1) AS n_fibers, round(sum(val), 3) AS sum_val FROM nonzeros WHERE run_id IS NOT NULL AND i0 IS NOT NULL GROUP BY run_id, i0)
"""
SQL = {
    "p3_found": _SLICES + "SELECT t.run_id, t.i0 FROM slice_stats t LEFT JOIN s USING (run_id, i0) WHERE t.nfibs <> coalesce(s.n_fibers, 0)",
    "p3_slices": _SLICES + "SELECT s.run_id, s.i0, s.n_rows, s.n_fibers, s.sum_val, t.nfibs AS recorded_nfibs FROM s LEFT JOIN slice_stats t USING (run_id, i0)",
    "p4_found": _LINES + "SELECT line_id, reason FROM d WHERE reason IS NOT NULL",
    # Missing fields need a delimiter each; of excess ones one is joined to its neighbour, or a pair of quotes holds them all.
    "p4_costs": _LINES + "SELECT line_id, CAST(CASE WHEN len(parts) < nmodes + 1 THEN nmodes + 1 - len(parts) ELSE least(len(parts) - nmodes - 1, 2) END AS INTEGER) AS cost, CAST(cost AS INTEGER) AS n_edits FROM d WHERE reason = 'columns' AND NOT contains(line, '\"')",
    "p4_loaded": _LINES + "SELECT line_id, file_id, line_no, array_to_string(list_transform(idx, lambda x : CAST(x AS VARCHAR)), ',') AS indices, v AS value FROM d WHERE reason IS NULL",
}
