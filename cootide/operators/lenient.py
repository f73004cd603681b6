"""Text tensor lines that load, and those that fail with the reason: a minimum-cost error parse.

A line is parsed by dynamic programming over its characters: an edit inserts or deletes a double quote or a delimiter,
each at cost 1, until the line is the right number of whole fields, bare or quoted; the fewest edits of both kinds together
are found. A parse of cost zero whose fields have valid types loads. Any other line is set apart: its edits are given, and
the reason is whether they mend its quoting or else its number of fields, or which kind of field has a wrong type.

Lines of cost zero are recognised inside the JVM: a line is well quoted if no quote is left once the whole quoted fields
are taken out, leftmost first. Only the others reach the dynamic program, which works on the line's shape (runs of quote, blank and other
characters), of which there are few, so results are kept per shape.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The reasons in the order in which they apply.
REASONS = ("quoting", "columns", "indices", "values")

# A field in quotes, whole; neither this nor any other pattern here repeats a group, which Java's matcher would do by
# recursion and so fail on very long lines.
QUOTED_FIELD = r'(?<![^ \t])"[^"]*"(?![^ \t])'
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

# States of the parse: between fields, in a bare field, in a quoted field, after a closing quote, after an inserted
# delimiter, whose field is empty unless something follows.
_GAP, _BARE, _QUOTED, _CLOSED, _OPEN = range(5)
_STATES = 5
_FAR = 1 << 60
_UNIT = 1 << 30  # cost of an edit; what is below it breaks ties
_EDITS = ("", "insert quote", "delete quote", "insert delimiter", "delete delimiter")


def shape_of(line: str) -> str:
    """Runs of other characters become one ``x``; quotes stay, a run of blanks and tabs becomes one blank."""
    return re.sub(r"[ \t]+", " ", re.sub(r'[^" \t]+', "x", line))


def well_quoted(shape: str) -> bool:
    """Whether every quote of a shape belongs to a field that is quoted as a whole."""
    state = _GAP
    for c in shape:
        if state == _QUOTED:
            state = _CLOSED if c == '"' else _QUOTED
        elif c == " ":
            state = _GAP
        elif state == _CLOSED or (c == '"' and state == _BARE):
            return False
        else:
            state = _QUOTED if c == '"' else _BARE
    return state != _QUOTED


def cheapest_edits(shape: str, fields: int) -> tuple[int, list[tuple[str, int]]]:
    """Fewest quotes and delimiters to insert or delete so that the shape is ``fields`` whole fields: (cost, edits).

    One dynamic program over the shape: per state of the parse and number of fields so far the cheapest way is kept. A
    deleted delimiter joins its neighbours; an inserted one begins a field, empty if nothing follows. With ``fields`` 0
    any number of fields will do. Of equally cheap ways one with fewest delimiter edits is taken for a line whose quoting is
    broken, else one with fewest quote edits. An edit is stated with the run of the shape, from 0, before which it takes place.
    Time and memory grow with the shape's length times the number of fields.
    """
    most = max(fields, 0)
    step = 1 if most else 0  # how many fields a new field counts for
    width = most + 1
    broken = not well_quoted(shape)
    quote, delimiter = (_UNIT, _UNIT + 1) if broken else (_UNIT + 1, _UNIT)
    cost = [_FAR] * (_STATES * width)
    cost[_GAP * width] = 0
    trail: list[tuple[bytes, bytes, list[int] | bytes, list[int] | bytes]] = []
    at = lambda state, n: state * width + n

    def insert(now: list[int]) -> tuple[list[int], bytearray]:
        """Insertions before the next run; fields ascend, so one pass follows any chain of them."""
        by, source = bytearray(len(now)), list(range(len(now)))

        def relax(frm: int, to: int, price: int, edit: int) -> None:
            if now[frm] + price < now[to]:
                now[to], by[to], source[to] = now[frm] + price, edit, frm

        for n in range(width):
            relax(at(_OPEN, n), at(_QUOTED, n), quote, 1)
            relax(at(_QUOTED, n), at(_CLOSED, n), quote, 1)
            if not step:
                relax(at(_GAP, n), at(_QUOTED, n), quote, 1)
                relax(at(_QUOTED, n), at(_CLOSED, n), quote, 1)
            for state in (_GAP, _BARE, _CLOSED, _OPEN) if n + step < width else ():
                relax(at(state, n), at(_OPEN, n + step), delimiter, 3)
            if step and n + step < width:
                relax(at(_GAP, n), at(_QUOTED, n + step), quote, 1)
        return source, by

    def consume(now: list[int], c: str) -> tuple[list[int], list[int], bytearray]:
        out, source, by = [_FAR] * len(now), [0] * len(now), bytearray(len(now))

        def relax(frm: int, to: int, price: int, edit: int) -> None:
            if now[frm] + price < out[to]:
                out[to], by[to], source[to] = now[frm] + price, edit, frm

        for n in range(width):
            relax(at(_QUOTED, n), at(_CLOSED if c == '"' else _QUOTED, n), 0, 0)
            if c == " ":
                for state in (_GAP, _BARE, _CLOSED, _OPEN):
                    relax(at(state, n), at(_GAP, n), 0, 0)
                relax(at(_BARE, n), at(_BARE, n), delimiter, 4)
                relax(at(_CLOSED, n), at(_CLOSED, n), delimiter, 4)
                continue
            inside = _QUOTED if c == '"' else _BARE
            if n + step < width:
                relax(at(_GAP, n), at(inside, n + step), 0, 0)
            relax(at(_OPEN, n), at(inside, n), 0, 0)
            if c == '"':
                for state in range(_STATES):
                    relax(at(state, n), at(state, n), quote, 2)
            else:
                relax(at(_BARE, n), at(_BARE, n), 0, 0)
        return out, source, by

    pack = bytes if len(cost) <= 256 else list
    for c in shape:
        source, by = insert(cost)
        cost, source2, by2 = consume(cost, c)
        trail.append((pack(source), bytes(by), pack(source2), bytes(by2)))
    source, by = insert(cost)
    trail.append((pack(source), bytes(by), b"", b""))
    state = min((at(s, most) for s in (_GAP, _BARE, _CLOSED, _OPEN)), key=lambda s: cost[s])
    total, edits = cost[state], []
    for pos in range(len(shape), -1, -1):
        source, by, source2, by2 = trail[pos]
        if pos < len(shape):
            if by2[state]:
                edits.append((_EDITS[by2[state]], pos))
            state = source2[state]
        while by[state]:
            edits.append((_EDITS[by[state]], pos))
            state = source[state]
    return total // _UNIT, edits[::-1]


def _parse_shape(shape: str, fields: int) -> tuple[int, str, str]:
    cost, edits = cheapest_edits(shape, fields)
    reason = "quoting" if not well_quoted(shape) else "columns" if cost else ""
    return cost, reason, "; ".join(f"{name} at run {pos + 1}" for name, pos in edits)


_short_shapes = lru_cache(maxsize=16384)(_parse_shape)  # texts of up to 200 edits


def error_parse(line: str, fields: int) -> tuple[int, str, str]:
    """(cost, reason or '', all edits as text) of one line without its final carriage return."""
    shape = shape_of(line)
    return (_short_shapes if len(shape) <= 200 else _parse_shape)(shape, fields)


def _errors(lines: pd.Series, fields: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([error_parse(a, int(b)) for a, b in zip(lines, fields)], columns=["cost", "reason", "edits"])


def _fields(line: Column) -> Column:
    """The fields of a line, quotes taken off; null if it is not well quoted. Most lines hold no quote at all."""
    bare = F.split(F.regexp_replace(line, r"^[ \t]+|[ \t]+\z", ""), r"[ \t]+")
    found = F.regexp_extract_all(line, F.lit(r'("[^"]*"|[^" \t]+)'), F.lit(1))
    unquoted = F.transform(found, lambda f: F.when(f.startswith('"'), f.substr(F.lit(2), F.length(f) - 2)).otherwise(f))
    well = ~F.regexp_replace(line, QUOTED_FIELD, "x").contains('"')
    return F.when(~line.contains('"'), bare).when(well, unquoted)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: a plain projection would be repeated wherever it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every line that is a case: loaded (reason null) or set apart with reason, edit cost and edits.

    lines: line_id, file_id, line_no, raw_line; files: file_id, nmodes, index_base, dims; further columns are ignored.
    Result: line_id, file_id, line_no, reason, cost, edits, indices (rebased to 0) and value; the last two are null for
    lines set apart. A final carriage return is no part of a line. Lines that start with ``#``, lines of only blanks
    and tabs, and null lines are skipped. A line whose file is unknown, or whose file has null or too few dims, cannot
    be read as a row of that file: its reason is ``columns`` (no number of fields is right), unless its quoting is
    already broken. Repeated lines are separate cases. ``files`` is small metadata, but it is joined without a hint:
    Spark broadcasts it only if its files are below the session's threshold.
    """
    f = files.select("file_id", "nmodes", "index_base", "dims")
    line = F.regexp_replace("raw_line", r"\r\z", "").alias("line")
    cases = lines.select("line_id", "file_id", "line_no", line).where(F.col("line").isNotNull() & ~F.col("line").startswith("#") & F.col("line").rlike(r"[^ \t]"))
    known = F.col("nmodes").isNotNull() & F.col("index_base").isNotNull() & (F.size("dims") >= F.col("nmodes")) & (F.col("nmodes") > 0)
    x = cases.join(f, "file_id", "left").withColumn("known", F.coalesce(known, F.lit(False)))
    x = _once(x, "parts", _fields(F.col("line")))
    clean = F.col("known") & F.col("parts").isNotNull() & (F.size("parts") == F.col("nmodes") + 1)

    def rebased(p: Column, d: Column) -> Column:
        """0-based index, or null: digits keep leading zeros; with more than 18 after those they are out of every range."""
        n = p.try_cast("long") - F.col("index_base")
        return F.when(p.rlike(r"^0*[0-9]{1,18}\z") & n.between(0, d - 1), n)

    last = F.element_at("parts", F.col("nmodes") + 1)
    number = F.when(last.rlike(NUMBER), last.try_cast("double"))
    indices = F.zip_with(F.slice("parts", 1, F.col("nmodes")), F.slice("dims", 1, F.col("nmodes")), rebased)
    x = _once(x, "row", F.when(clean, F.struct(indices.alias("indices"), number.alias("value")))).select("line_id", "file_id", "line_no", "line", "known", "nmodes", F.col("row").isNotNull().alias("clean"), "row.indices", "row.value")
    bad_index = F.exists("indices", lambda i: i.isNull())
    bad_value = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    errors = F.pandas_udf(_errors, T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("edits", T.StringType())]))
    good = x.where(F.col("clean")).select(
        "line_id", "file_id", "line_no",
        F.when(bad_index, "indices").when(bad_value, "values").alias("reason"),
        F.lit(0).alias("cost"),
        F.when(bad_index, F.concat(F.lit("index field "), F.array_position(F.transform("indices", lambda i: i.isNull()), True).cast("string"), F.lit(" has a wrong type or range")))
        .when(bad_value, "value field is no finite number").otherwise("").alias("edits"),
        "indices", "value",
    )
    none = F.lit(None)
    bad = x.where(~F.col("clean")).select("line_id", "file_id", "line_no", "known", errors("line", F.when(F.col("known"), F.col("nmodes") + 1).otherwise(0)).alias("e"))
    bad = bad.select(
        "line_id", "file_id", "line_no",
        F.when(F.col("e.reason") == "quoting", "quoting").otherwise("columns").alias("reason"),
        F.col("e.cost").alias("cost"),
        F.when(F.col("known"), F.col("e.edits")).otherwise(F.lit("file without usable modes and dims")).alias("edits"),
        none.cast("array<bigint>").alias("indices"), none.cast("double").alias("value"),
    )
    out = good.unionByName(bad)
    sound = F.col("reason").isNull()
    return out.withColumns({"indices": F.when(sound, F.col("indices")), "value": F.when(sound, F.col("value"))})
