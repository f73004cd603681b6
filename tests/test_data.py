"""Skewed keys and lines that fail to parse."""

import random
import re
from collections import defaultdict

import pytest

from cootide.operators import lenient, skew
from tests.tensors import rows


def counts(data):
    out = defaultdict(lambda: [0, set(), 0.0])
    for run, i, f, v in data:
        if run is not None and i is not None:
            out[run, i][0] += 1
            out[run, i][1].add(f)
            out[run, i][2] += v or 0.0
    return {k: (n, len(f - {None}), s) for k, (n, f, s) in out.items()}


def test_keyed_counts_under_skew(spark):
    random.seed(1)
    data = [(0, 7 if random.random() < 0.5 else random.randrange(40), random.choice([None, 1, 1, random.randrange(300)]), float(random.randrange(9))) for _ in range(3000)]
    data += [(None, 7, 1, 1.0), (1, None, 1, 1.0), (2, 5, None, None)]
    df = spark.createDataFrame(data, "run int, i bigint, f bigint, val double").selectExpr("*", "'x' AS n_rows", "1 AS _task")
    match = spark.createDataFrame([(0, 7, 3, "a"), (0, 999, 1, "b"), (None, 1, 2, "c"), (2, 5, None, "d")], "run int, i bigint, nfibs bigint, note string")
    got = skew.keyed_fiber_counts(df, match, ["run", "i"], "f", "val", tasks=5).collect()
    want = counts(data)
    have = {(r["run"], r["i"]): (r["n_rows"], r["n_fibers"], r["sum_value"] or 0.0) for r in got if r["has_rows"]}
    assert have == want
    assert sorted((r["note"], r["nfibs"], r["n_rows"] > 0) for r in got if r["has_match"]) == [("a", 3, True), ("b", 1, False), ("c", 2, False), ("d", None, True)]
    plan = skew.plan_loads(df, ["run", "i"], 5)
    assert plan.heavy[0][0] == (0, 7) and len(plan.heavy[0][1]) > 1
    assert max(plan.task_loads) < 2 * sum(plan.task_loads) / 5


def test_a_repeated_matching_key_keeps_one_record_whole(spark):
    df = spark.createDataFrame([(1, 2, 3, 1.0)] * 5, "run int, i bigint, f bigint, val double")
    match = spark.createDataFrame([(1, 2, 7, None, "a"), (1, 2, 7, 1, None), (1, 2, 3, 9, "z")], "run int, i bigint, x bigint, y bigint, note string")
    got = skew.keyed_fiber_counts(df, match, ["run", "i"], "f", "val", tasks=3).collect()
    assert [(r["n_rows"], r["n_fibers"], r["x"], r["y"], r["note"]) for r in got] == [(5, 1, 7, 1, None)]


def test_keyed_counts_of_nothing(spark):
    df = spark.createDataFrame([], "run int, i bigint, f bigint, val double")
    match = spark.createDataFrame([(1, 2, 3)], "run int, i bigint, nfibs bigint")
    assert skew.keyed_fiber_counts(df, match.limit(0), ["run", "i"], "f", "val", tasks=3).count() == 0
    assert rows(skew.keyed_fiber_counts(df, match, ["run", "i"], "f", "val", tasks=3), "run", "n_rows", "nfibs") == [(1, 0, 3)]


def test_packing_balances():
    where, loads = skew.pack([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2)
    assert sorted(loads) == [8, 10] and set(where.values()) == {0, 1}


LINES = [
    ("1 2 3.5", None), ('"1"\t"2"  "-.5e1"', None), (" 1 2 1. \r", None), ("# note", "skip"), (" \t", "skip"), ("", "skip"), ("\r", "skip"), (None, "skip"),
    ('"1 2 3.5', "quoting"), ('1 2" 3.5', "quoting"), ('"1"2 3.5', "quoting"), ('1 "2"" 3.5', "quoting"), ("1 3.5", "columns"), ("1 2 3 3.5", "columns"), (" # 1", "columns"), ("1 2 3.5", "columns"),
    ("0 2 3.5", "indices"), ("4 2 3.5", "indices"), ("+1 2 3.5", "indices"), ('"1 " 2 3', "indices"), ('"" 2 3', "indices"), ("1 2" + "0" * 30 + " 3", "indices"), ("x 2 y", "indices"), ("﻿1 2 3", "indices"), ("١ 2 3", "indices"),
    ("1 2 inf", "values"), ("1 2 NaN", "values"), ("1 2 1e999", "values"), ("1 2 .", "values"), ("1 2 1,5", "values"), ('1 2 ""', "values"), ("1 2 0x1", "values"), ("1 2 5\r\r", "values"), ("1 2 1e", "values"), ("1 2 1d", "values"),
    ("001 " + "0" * 25 + "2 +3E+2", None), ('1 2 "' + "9" * 5000 + '"', "values"), ("1 " * 20000, "columns"), ('"' * 3001, "quoting"),
]


def test_reasons(spark):
    lines = spark.createDataFrame([(n, 1, n, line, "extra") for n, (line, _) in enumerate(LINES)] + [(900, 9, 0, "1 2 3", "x"), (901, 9, 0, '"1 2 3', "x")], "line_id bigint, file_id int, line_no bigint, raw_line string, dims string")
    files = spark.createDataFrame([(1, 2, 1, [3, 5], "f"), (2, None, None, None, "g")], "file_id int, nmodes int, index_base int, dims array<bigint>, raw_line string")
    got = {r["line_id"]: r for r in lenient.parse_lines(lines, files).collect()}
    for n, (line, reason) in enumerate(LINES):
        assert (n in got) == (reason != "skip"), line
        if n in got:
            assert got[n]["reason"] == reason, (line, got[n])
            assert (got[n]["cost"] > 0) == (reason in ("quoting", "columns")), line
            assert (got[n]["value"] is not None) == (reason is None)
    assert got[1]["indices"] == [0, 1] and got[1]["value"] == -5.0
    assert got[900]["reason"] == "columns" and got[901]["reason"] == "quoting"
    assert lenient.parse_lines(lines.limit(0), files).count() == 0


def brute_edits(shape, fields, most):
    """Fewest quotes and delimiters to insert or delete by search; a bar stands for an inserted delimiter, which begins a
    field that is empty if nothing follows it."""
    whole = re.compile(r'[ |]*((?:"[^"]*"|x+)(?:[ |]+(?:"[^"]*"|x+))*[ |]*)?')

    def fits(s):
        bare = re.sub(r'"[^"]*"', lambda m: "q" * len(m[0]), s)
        return whole.fullmatch(s) is not None and len(re.findall(r"\||(?:^|(?<= ))(?=[xq])", bare)) == fields

    layer = {shape}
    for cost in range(most + 1):
        if any(map(fits, layer)):
            return cost
        layer = {s[:i] + c + s[i:] for s in layer for i in range(len(s) + 1) for c in '"|'} | {s[:i] + s[i + 1 :] for s in layer for i, c in enumerate(s) if c in '" '}
    return None


@pytest.mark.parametrize("seed", range(3))
def test_edits_are_fewest(seed):
    random.seed(seed)
    for _ in range(60):
        shape = lenient.shape_of("".join(random.choice('" x') for _ in range(random.randrange(1, 8))))
        fields = random.randrange(1, 4)
        cost, edits = lenient.cheapest_edits(shape, fields)
        fewest = brute_edits(shape, fields, 3)
        assert cost == len(edits) and (cost == fewest or fewest is None and cost > 3), (shape, fields, cost, fewest)


def test_quotes_and_delimiters_are_mended_together():
    assert lenient.error_parse('1 2 3 "4 5', 4) == (1, "quoting", "insert quote at run 11")
    assert lenient.error_parse('1 2 3 "4"5', 5)[:2] == (1, "quoting")
    assert lenient.error_parse("1 " * 20_000, 3)[:2] == (2, "columns")  # one pair of quotes around the excess
    assert lenient.error_parse("1 2 3 4 5", 4) == (1, "columns", "delete delimiter at run 2")
    assert lenient.error_parse("1 2", 4) == (2, "columns", "insert delimiter at run 2; insert delimiter at run 2")


@pytest.mark.parametrize("line", ["1 2 3 4 " + "5 " * 20, '1 2"' * 15, "1", 'a"b ' * 300])
def test_every_edit_is_given(line):
    cost, _, edits = lenient.error_parse(line, 4)
    given = edits.split("; ")
    assert cost == len(given) and all(" at run " in e for e in given)
