"""Most similar vectors of every vector, and links between similar vectors, by vantage-point trees per shard.

Usable vectors are scaled to unit length. Of each large group (here a factor matrix) a bounded sample gives pivots; a vector
belongs to the cell of its nearest pivot, or if near enough to the core of that, and cells make up shards of bounded size. One exchange brings every vector to
its shard, whose task reduces copies to classes and searches each class among the others by a tree. A class then visits
another shard only if the triangle inequality, or the plane half way between two pivots, leaves room there for something
better than what it has; ``factor`` relaxes both kinds of pruning alike. Factor 1 misses nothing.

Vectors travel and lie on disk as ``encoded`` gives them, in about the space of the input, and are scaled where they are
compared. Visits move nothing: a task reads the two shards from the files that the exchange was written to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, functions as F

from cootide.session import materialize

from . import vptree

SHARD_ROWS = 16_384
MOST_PIVOTS = 8_192  # of all groups
GROUP_PIVOTS = 4_096
ROWS_PER_PIVOT = 32
COVERED = 0.9  # a sampled vector this near a pivot is none
CORE = 0.9  # vectors of a cell this near its pivot form a cell of their own, that few from elsewhere visit
HOT_SHARE = 1_000  # a class above 1 / HOT_SHARE of all rows is split when its members are joined
SALTS = 64
CHUNK_ROWS = 200_000
VISITED = 4  # shards whose visits to another one share a task
_SLACK = 1e-9
_SINGLE = 1e-5  # more than single precision loses of two cosines
_SCALES = (1, 100, 10_000, 1_000_000)
_ITEM = np.array([8, 4] + [1, 2, 3, 4] * len(_SCALES))  # bytes a number by the first byte of an encoded vector


@dataclass
class Group:
    """Pivots of a large group, and per cell (two a pivot, the core first) its number, least and greatest distance from the pivot, and shards."""

    pivots: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    offset: int = 0  # of its shards among those of all groups
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of shards, tight ones first

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Twice the nearest pivot of each vector, the first of equals, the same for equal vectors whatever stands beside them;
        and one more for those outside of the core."""
        if not len(self.pivots):
            return np.zeros(len(x), np.int64)
        out, pivots = np.zeros(len(x), np.int64), self.pivots.T.astype(np.float32)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            cos = part.astype(np.float32) @ pivots
            top = cos.max(axis=1)
            near = cos >= top[:, None] - np.float32(_SINGLE)
            out[a : a + 512] = near.argmax(axis=1)
            for r in np.flatnonzero(np.count_nonzero(near, axis=1) > 1):  # products of matrices may differ in the last digits
                c = np.flatnonzero(near[r])
                out[a + r] = c[np.argmax([float((part[r] * self.pivots[j]).sum()) for j in c])]
            own = (part * self.pivots[out[a : a + 512]]).sum(axis=1)
            out[a : a + 512] = 2 * out[a : a + 512] + (own < CORE)
        return out

    def reached(self, x: np.ndarray, cell: np.ndarray, own: int, floor: np.ndarray, factor: float, tighter: bool, among: np.ndarray | None = None) -> np.ndarray:
        """Whether something of cosine at least ``floor`` may lie there: a row per vector, a column per shard (of ``among``), never in ``own``."""
        among = np.arange(len(self.rank)) if among is None else among
        holds, used = self._holds(among)
        out = np.zeros((len(x), len(among)), bool)
        for a, open_cells in self._open(x, cell, floor, factor, used):
            if len(among) == 1:
                out[a : a + len(open_cells), 0] = open_cells.any(axis=1)
                continue
            for n, c in enumerate(used):
                out[a : a + len(open_cells), holds[c]] |= open_cells[:, n, None]
        return out & self._allowed(among, own, tighter)

    def _allowed(self, among: np.ndarray, own: int, tighter: bool) -> np.ndarray:
        return (among != own) & (self.rank[among] < self.rank[own]) if tighter else among != own

    def _holds(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which cells (rows) lie in which shards of ``among``, and those that lie in any."""
        holds = (self.first[:, None] <= among) & (among < (self.first + self.parts)[:, None])
        return holds, np.flatnonzero(holds.any(axis=1))

    def _open(self, x: np.ndarray, cell: np.ndarray, floor: np.ndarray, factor: float, used: np.ndarray):
        """(first vector of a block, whether something of cosine at least ``floor`` may lie there: a row per vector, a column per cell of ``used``)."""
        if not len(self.pivots):
            yield 0, np.ones((len(x), len(used)), bool)
            return
        # Single precision with margins for what it loses, in squares so that no roots are needed.
        there = self.pivots[used // 2].astype(np.float32)
        low, high = self.low[used].astype(np.float32), self.high[used].astype(np.float32)
        homes, which = np.unique(cell // 2, return_inverse=True)
        apart = np.sqrt(np.maximum(2 - 2 * (self.pivots[homes].astype(np.float32) @ there.T), 0) + np.float32(2 * _SINGLE))
        apart[apart < 5e-3] = 1e6  # of the same pivot
        step = int(np.clip((1 << 17) // max(1, len(used)), 64, 2048))
        for a in range(0, len(x), step):
            part, home = x[a : a + step], which[a : a + step]
            cos = part.astype(np.float32) @ there.T
            r = ((vptree.chord(floor[a : a + step] - 2 * _SLACK) + _SLACK) / factor).astype(np.float32)[:, None]
            own = (part * self.pivots[homes[home]]).sum(axis=1).astype(np.float32)[:, None]
            allowed = own - cos <= r * apart[home] + np.float32(2 * _SINGLE)  # the plane between the pivots
            d2 = 2 - 2 * cos
            allowed &= d2 <= (high + r) ** 2 + np.float32(4 * _SINGLE)
            if low.max(initial=0) > r.min():
                allowed &= d2 >= np.maximum(low - r, 0) ** 2 - np.float32(4 * _SINGLE)
            yield a, allowed

    def visits(self, x: np.ndarray, cell: np.ndarray, own: int, floor: np.ndarray, factor: float, tighter: bool) -> list[np.ndarray]:
        """Shards other than ``own`` in which something of cosine at least ``floor`` may lie, for each vector."""
        return [np.flatnonzero(r) for r in self.reached(x, cell, own, floor, factor, tighter)]

    def tour(self, x: np.ndarray, cell: np.ndarray, own: int, floor: np.ndarray, factor: float, tighter: bool) -> list[np.ndarray]:
        """The shards that any of the vectors visits, with the first of them."""
        among = np.arange(len(self.rank))
        holds, left = self._holds(among)
        allowed = self._allowed(among, own, tighter)
        met = ~allowed
        for a in range(0, len(x), 512):  # what is met needs no further looks
            left = left[(holds[left] & ~met).any(axis=1)]
            if not len(left):
                break
            some = slice(a, a + 512)
            for _, open_cells in self._open(x[some], cell[some], floor[some], factor, left):
                met |= holds[left[open_cells.any(axis=0)]].any(axis=0)
        to = met & allowed
        return [np.flatnonzero(to), *[np.zeros(0, int)] * (len(x) - 1)]


@dataclass
class Index:
    """Usable rows with class and shard, and the groups that have more than one shard."""

    rows: DataFrame  # grp, row, class_key, unit, shard, cell
    keys: DataFrame  # grp, row, class_key of the same rows
    groups: dict[int, Group]
    shards: int


def _units(b: pa.RecordBatch, dimensions: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The usable rows of a batch (group, key, vector) and their vectors."""
    b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(2)), dimensions), False))
    if not b.num_rows:
        return b, np.zeros((0, dimensions))
    values = pc.list_flatten(b.column(2)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    largest = np.abs(values).max(axis=1)
    good = np.isfinite(largest) & (largest > 0)
    return b.filter(pa.array(good)), values[good]


def scaled(values: np.ndarray) -> np.ndarray:
    """Vectors of length one; those of a row depend on nothing beside it."""
    x = values / np.abs(values).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def unit_rows(df: DataFrame, key: str, group: str, vector: str, dimensions: int, groups: dict[int, Group] | None = None, *, distances: bool = False, keys_only: bool = False) -> DataFrame:
    """(grp, row, class_key, unit, cell) of usable rows, unit being the encoded vector as it came; with ``keys_only`` the first three.

    With ``distances`` (grp, cell, class_key, cosine), the last with the pivot of the cell, of rows of ``groups``.

    Rows take no part whose key, group or vector is null, whose vector has not ``dimensions`` numbers, holds null, NaN
    or infinity, or is all zero.
    """
    shared = df.sparkSession.sparkContext.broadcast(groups or {})

    def run(batches):
        for b in batches:
            b, values = _units(b, dimensions)
            if not b.num_rows:
                continue
            x = scaled(values)
            rounded = np.round(x, 12) + 0.0
            keys = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rounded]
            if keys_only:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["grp", "row", "class_key"])
                continue
            grp, cell, cos = b.column(0).to_numpy(), np.zeros(b.num_rows, np.int64), np.ones(b.num_rows)
            for g in np.unique(grp).tolist():
                if g in shared.value:
                    mine, of = grp == g, shared.value[g]
                    cell[mine] = of.cells(x[mine])
                    if distances and len(of.pivots):
                        cos[mine] = (x[mine] * of.pivots[cell[mine] // 2]).sum(axis=1)
            if distances:
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(keys, pa.int64()), pa.array(cos)], ["grp", "cell", "class_key", "cosine"])
                yield out.filter(pc.is_in(out.column(0), pa.array(list(shared.value), pa.int64())))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), encoded(values), pa.array(cell)], ["grp", "row", "class_key", "unit", "cell"])

    schema = "grp bigint, row bigint, class_key bigint" if keys_only else "grp bigint, cell bigint, class_key bigint, cosine double" if distances else "grp bigint, row bigint, class_key bigint, unit binary, cell bigint"
    return _known(df, key, group, vector).mapInArrow(run, schema)


def _known(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    known = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull())
    return known.select(F.col(group).cast("long").alias("grp"), F.col(key).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("vector"))


def encoded(values: np.ndarray) -> pa.Array:
    """Rows of finite numbers as binary values, from which ``decoded`` makes the same numbers.

    The first byte says how the others hold a row: as whole multiples of 1, 1e-2, 1e-4 or 1e-6, the sign in the last bit,
    in as few bytes as the largest takes; as floats; or as doubles. The first that loses nothing is taken.
    """
    n, width = values.shape
    kind, codes, left = np.zeros(n, np.uint8), np.zeros((n, width), np.uint32), np.arange(n)
    with np.errstate(over="ignore"):
        for i, scale in enumerate(_SCALES):
            x = values[left]
            whole = np.rint(np.clip(x * scale, -(2**31) + 1, 2**31 - 1))
            same = (whole / scale == x).all(axis=1)
            z = whole[same].astype(np.int64)
            codes[left[same]] = z = (z << 1 ^ z >> 63).astype(np.uint32)
            top = z.max(axis=1, initial=0)
            kind[left[same]] = 2 + 4 * i + sum((top >= 1 << s).astype(np.uint8) for s in (8, 16, 24))
            left = left[~same]
        kind[left] = (values[left].astype(np.float32) == values[left]).all(axis=1)
    offsets = np.concatenate([[0], np.cumsum(1 + width * _ITEM[kind])])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of vectors exceeds 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = kind
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        rows = values[at] if k == 0 else values[at].astype(np.float32) if k == 1 else codes[at]
        rows = rows.view(np.uint8).reshape(len(at), width, -1)[:, :, : _ITEM[k]].reshape(len(at), -1)
        out[offsets[at][:, None] + 1 + np.arange(rows.shape[1])] = rows
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def decoded(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The numbers of vectors that ``encoded`` made, none null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    kind = data[offsets[:-1]]
    width = int((offsets[1] - offsets[0] - 1) // _ITEM[kind[0]])
    out = np.empty((n, width))
    for k in np.unique(kind):
        at, item = np.flatnonzero(kind == k), _ITEM[k]
        rows = data[offsets[at][:, None] + 1 + np.arange(width * item)]
        if k < 2:
            out[at] = rows.view(np.float32 if k else np.float64)
            continue
        z = np.zeros((len(at), width, 4), np.uint8)
        z[:, :, :item] = rows.reshape(len(at), width, item)
        z = z.view(np.uint32)[:, :, 0].astype(np.int64)
        out[at] = (z >> 1 ^ -(z & 1)) / _SCALES[(k - 2) // 4]
    return out


def matrix_of(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Encoded vectors, scaled to length one, as a matrix."""
    return scaled(decoded(column)) if n else np.zeros((0, 0))


def _pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the vectors, skipping those that an earlier one covers."""
    chosen, n = np.zeros((most, x.shape[1])), 0
    for a in range(0, len(x), 256):
        part = x[a : a + 256]
        free = (part @ chosen[:n].T).max(axis=1) < COVERED if n else np.ones(len(part), bool)
        for v in part[free]:
            if n >= most:
                return chosen
            if not n or (chosen[max(0, n - 256) : n] @ v).max() < COVERED:
                chosen[n] = v
                n += 1
    return chosen[:n]


def _groups(df: DataFrame, key: str, group: str, vector: str, dimensions: int) -> dict[int, Group]:
    """Pivots of the groups that exceed a shard: at most MOST_PIVOTS, from a sample of at most about twice as many rows."""
    known = _known(df, key, group, vector)
    large = {r["grp"]: r["n"] for r in known.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS).collect()}
    if not large:
        return {}
    total = sum(large.values())
    want = {g: min(GROUP_PIVOTS, n // ROWS_PER_PIVOT, MOST_PIVOTS * n // total) for g, n in large.items()}
    ask = df.sparkSession.createDataFrame([(g, min(1.0, 2.0 * want[g] / n)) for g, n in large.items()], "grp bigint, share double")
    unit = F.shiftrightunsigned(F.xxhash64("row", F.lit(17)), 11).cast("double") / float(1 << 53)
    sampled = known.join(F.broadcast(ask), "grp").where(unit < F.col("share")).select("grp", "row", "vector")
    t = unit_rows(sampled, "row", "grp", "vector", dimensions).select("grp", "row", "unit").toArrow().sort_by([("grp", "ascending"), ("row", "ascending")])
    grp, x = t["grp"].to_numpy(), matrix_of(t["unit"], t.num_rows)
    out = {}
    for g in large:
        p = _pivots(x[grp == g], want[g]) if t.num_rows and want[g] > 1 else np.zeros((0, dimensions))
        out[g] = Group(p)
    return out


def _order(pivots: np.ndarray) -> np.ndarray:
    """A walk over the pivots that goes on to the nearest one left, so that cells side by side share a shard."""
    left, at, out = np.ones(len(pivots), bool), 0, []
    for _ in range(len(pivots)):
        left[at] = False
        out.append(at)
        cos = np.where(left, pivots @ pivots[at], -np.inf)
        at = int(cos.argmax())
    return np.array(out, int)


def _place(g: Group, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Cells to shards: a large cell is split by the hash of its classes, neighbouring small ones are put together.

    Loose cells, which most searches visit, do not share shards with tight ones.
    """
    g.low, g.high = low, high
    g.first, g.parts = np.zeros(len(n), int), np.zeros(len(n), int)
    order = (2 * _order(g.pivots)[:, None] + np.arange(2)).ravel() if len(g.pivots) else np.arange(len(n))
    rank, shard, held = [], -1, SHARD_ROWS
    for loose in (False, True):
        held = SHARD_ROWS
        for c in order[(high[order] > 0.8) == loose]:
            if not n[c]:
                continue
            parts = -(-int(n[c]) // SHARD_ROWS)
            if parts > 1 or held + n[c] > SHARD_ROWS:
                shard, held = shard + 1, 0
                rank += [len(rank) + k for k in range(parts)]
            g.first[c], g.parts[c] = shard, parts
            held += int(n[c])
            if parts > 1:
                shard, held = shard + parts - 1, SHARD_ROWS
    g.rank = np.array(rank, float)


def index(df: DataFrame, key: str, group: str, vector: str, dimensions: int) -> Index:
    """Usable rows with their class, cell and shard, made from ``df`` anew where they are read: a copy would take as much
    disk as the input. The driver holds pivots and one row per cell."""
    spark = df.sparkSession
    groups = _groups(df, key, group, vector, dimensions)
    rows = unit_rows(df, key, group, vector, dimensions, groups)
    shards = 1
    plan = []
    if groups:
        cos = unit_rows(df, key, group, vector, dimensions, groups, distances=True)
        stats = cos.groupBy("grp", "cell").agg(F.approx_count_distinct("class_key").alias("n"), F.min("cosine").alias("least"), F.max("cosine").alias("most")).collect()
        for g, of in groups.items():
            cells = max(1, 2 * len(of.pivots))
            n, low, high = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
            for r in stats:
                if r["grp"] == g:
                    n[r["cell"]] = max(1, r["n"])
                    if len(of.pivots):
                        low[r["cell"]], high[r["cell"]] = vptree.chord(np.array([r["most"] + _SLACK, r["least"] - _SLACK]))
            _place(of, n, low, high)
            of.offset = shards
            plan += [(g, c, int(of.first[c]), int(of.parts[c])) for c in range(cells) if of.parts[c]]
            shards += len(of.rank)
    places = F.broadcast(spark.createDataFrame(plan, "grp bigint, cell bigint, first int, parts int"))  # at most a row per pivot
    placed = rows.join(places, ["grp", "cell"], "left")
    shard = F.coalesce(F.col("first") + F.pmod("class_key", F.col("parts").cast("long")), F.lit(0)).cast("int")
    placed = placed.select("grp", "row", "class_key", "unit", shard.alias("shard"), "cell")
    return Index(placed, unit_rows(df, key, group, vector, dimensions, keys_only=True), groups, shards)


def combined(rows: DataFrame, keep: int) -> DataFrame:
    """Per chunk of a task and class its number of rows, ``keep`` smallest rows and, with the smallest, the vector.

    So a class that holds a third of all rows leaves a task as few rows.
    """

    def chunk(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        grp, key, row = (t[c].to_numpy() for c in ("grp", "class_key", "row"))
        order = np.lexsort((row, key, grp))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(grp[order]) != 0)]))
        n = np.diff(np.append(new, len(order)))
        place = np.arange(len(order)) - np.repeat(new, n)
        kept = order[place < keep]
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        count = np.zeros(len(order), np.int64)
        count[order[new]] = n
        t = t.append_column("n", pa.array(count)).take(pa.array(kept))
        unit = pc.if_else(pa.array(first[kept]), t["unit"], pa.scalar(None, pa.binary()))
        return t.set_column(t.schema.get_field_index("unit"), "unit", unit)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                yield from chunk(held).to_batches()
                held, rows = [], 0
        if rows:
            yield from chunk(held).to_batches()

    return rows.select("grp", "shard", "cell", "class_key", "row", "unit").mapInArrow(run, "grp bigint, shard int, cell bigint, class_key bigint, row bigint, unit binary, n bigint")


@dataclass
class Shard:
    """The classes of a shard: number of rows, smallest rows (ascending) and vector of each, by their smallest row."""

    grp: int
    shard: int
    key: np.ndarray
    cell: np.ndarray
    row: np.ndarray
    n: np.ndarray
    rows: list[np.ndarray]
    unit: np.ndarray
    encoded: pa.Array

    @classmethod
    def of(cls, t: pa.Table, keep: int) -> Shard:
        key, row, n = (t[c].to_numpy() for c in ("class_key", "row", "n"))
        order = np.lexsort((row, key))
        key, row, n = key[order], row[order], n[order]
        again = np.concatenate([[False], (np.diff(key) == 0) & (np.diff(row) == 0)])  # one row met by several tasks
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        ends = np.append(starts[1:], len(key))
        rows = [row[a:b][~again[a:b]][:keep] for a, b in zip(starts, ends)]
        total = np.add.reduceat(n, starts)
        valid = t["unit"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
        # The smallest row of a class is the first of its chunk, so it came with its vector.
        with_unit = np.array([a + int(valid[a:b].argmax()) for a, b in zip(starts, ends)], int)
        first = np.array([r[0] for r in rows], np.int64)
        by_row = np.argsort(first, kind="stable")
        at = order[with_unit[by_row]]
        unit = t["unit"].take(pa.array(at)).combine_chunks()
        return cls(t["grp"][0].as_py(), t["shard"][0].as_py(), key[starts][by_row], t["cell"].to_numpy()[at], first[by_row], total[by_row], [rows[i] for i in by_row], matrix_of(unit, len(at)), unit)


def at_home(ix: Index, keep: int, work: Callable, columns: str) -> DataFrame:
    """One row per class: grp, shard, row, class_key, n, rows, unit, cell, place, visits and the ``columns`` that ``work`` gives.

    ``work(shard, group)`` returns those columns' arrays and the lists of shards to visit; group is None for a group of one
    shard. place numbers the shards of all groups that have several; it is 0 for the others.
    """
    shared = ix.rows.sparkSession.sparkContext.broadcast(ix.groups)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        s = Shard.of(t, keep)
        g = shared.value.get(s.grp)
        arrays, visits = work(s, g)
        visits = pa.array([[]] * len(s.row), pa.list_(pa.int32())) if visits is None else pa.array([v.tolist() for v in visits], pa.list_(pa.int32()))
        place = np.full(len(s.row), g.offset + s.shard if g else 0, np.int32)
        head = [pa.array(np.full(len(s.row), s.grp)), pa.array(np.full(len(s.row), s.shard, np.int32)), pa.array(s.row), pa.array(s.key), pa.array(s.n), pa.array([r.tolist() for r in s.rows], pa.list_(pa.int64())), s.encoded, pa.array(s.cell), pa.array(place), visits]
        return pa.Table.from_arrays([*head, *arrays], ["grp", "shard", "row", "class_key", "n", "rows", "unit", "cell", "place", "visits", *names])

    schema = f"grp bigint, shard int, row bigint, class_key bigint, n bigint, rows array<bigint>, unit binary, cell bigint, place int, visits array<int>, {columns}"
    # Shards are few and heavy: ask for enough partitions that they seldom share one.
    return combined(ix.rows, keep).repartition(int(min(50_000, 3 * ix.shards)), "grp", "shard").groupBy("grp", "shard").applyInArrow(run, schema)


def _shard_file(folder: str, place: int, columns: list[str]) -> pa.Table:
    """The rows of one place, read from the shared folder by the task that needs them."""
    folder = f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.dataset.dataset(f"{path}/place={place}", filesystem=files, format="parquet").to_table(columns=columns, use_threads=False)


def away(home: DataFrame, ix: Index, columns: list[str], floor: Callable, factor: float, tighter: bool, work: Callable, schema: str) -> DataFrame | None:
    """Rows of ``work(queries, their units, points, the tree of their units)`` for every shard and every other one that classes of it visit;
    None if nobody travels.

    ``home`` is written by place and its first row of a shard lists all shards to visit. Queries are the classes for which
    the group leaves room there above ``floor(queries)``, points all classes of the shard visited, both with row and
    ``columns``. Tasks read them from home's files, so disk and network hold no copies, however many shards are visited.
    """
    last = F.ceil(F.size("owners") / VISITED).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("owners", i * VISITED + 1, VISITED))
    each = home.where(F.size("visits") > 0).select("grp", "shard", F.explode("visits").alias("visited"))
    trips = each.groupBy("grp", "visited").agg(F.sort_array(F.collect_list("shard")).alias("owners")).select("grp", "visited", F.explode(parts).alias("owners"))  # a row per task
    tasks = trips.count() if ix.groups else 0
    if not tasks:
        return None
    shared = home.sparkSession.sparkContext.broadcast(ix.groups)
    folder, columns = home._cootide_path, ["row", "cell", "unit", *columns]

    def run(batches):
        for b in batches:
            for grp, shard, owners in zip(*(b.column(c).to_pylist() for c in ("grp", "visited", "owners"))):
                g, p, tree = shared.value[grp], None, None
                for own in owners:
                    q = _shard_file(folder, g.offset + own, columns)
                    x = matrix_of(q["unit"], q.num_rows)
                    to = np.flatnonzero(g.reached(x, q["cell"].to_numpy(), own, floor(q), factor, tighter, np.array([shard]))[:, 0])
                    if not len(to):
                        continue
                    if tree is None:
                        p = _shard_file(folder, g.offset + shard, columns)
                        tree = vptree.Tree(matrix_of(p["unit"], p.num_rows))
                    yield from work(q.take(pa.array(to)), x[to], p, tree).to_batches()

    return trips.repartition(int(min(50_000, tasks))).mapInArrow(run, schema)


def _expand(cos: np.ndarray, at: np.ndarray, rows: list[np.ndarray], k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nearest classes to nearest rows: (rows, cosines) per query, best first, ties to the smaller row, at most k."""
    near, value = [], []
    several = any(len(r) > 1 for r in rows)
    for c, a in zip(cos, at):
        c, a = c[a >= 0], a[a >= 0]
        if several:
            r = [rows[i] for i in a]
            c, r = np.repeat(c, [len(x) for x in r]), np.concatenate([*r, np.zeros(0, np.int64)])
        else:
            r = np.array([rows[i][0] for i in a], np.int64)
        order = np.lexsort((r, -c))[:k]
        near.append(r[order]), value.append(c[order])
    return near, value


def nearest_rows(df: DataFrame, key: str, group: str, vector: str, k: int, *, dimensions: int = 64, min_cos: float = -1.0, factor: float = 1.0) -> DataFrame:
    """grp, row, near_row, cosine: the k most similar other rows of the same group, for every usable row.

    Cosines are rounded to 9 decimals, ties go to the smaller row; rows below ``min_cos`` are not given, so fewer than k
    may come out. What makes a row unusable is stated at ``unit_rows``. Copies of a vector are each other's nearest.
    A repeated key with the same vector counts once. An empty table gives an empty result; other columns are not read.
    """
    ix = index(df, key, group, vector, dimensions)
    k1 = k + 1  # with the row itself

    def at_its_home(s: Shard, g: Group | None):
        cos, at = vptree.nearest(s.unit, s.unit, s.row, k1, min_cos=min_cos, factor=factor)
        near, value = _expand(cos, at, s.rows, k1)
        floor = np.array([max(min_cos, v[-1]) if len(v) == k1 else min_cos for v in value])
        visits = g.tour(s.unit, s.cell, s.shard, floor, factor, False) if g else None
        return [pa.array(near, pa.list_(pa.int64())), _whole(value), pa.array(floor)], visits

    def elsewhere(q: pa.Table, x: np.ndarray, p: pa.Table, tree: vptree.Tree) -> pa.Table:
        cos, at = vptree.nearest(x, tree.points, p["row"].to_numpy(), k1, min_cos=min_cos, factor=factor, floor=q["floor"].to_numpy(), tree=tree)
        found = np.flatnonzero(at[:, 0] >= 0)  # often few
        used, at = np.unique(at[found], return_inverse=True)
        used, at = (used[1:], at - 1) if len(used) and used[0] < 0 else (used, at)
        rows = [np.array(r, np.int64) for r in p["rows"].take(pa.array(used)).to_pylist()]
        near, value = _expand(cos[found], at.reshape(len(found), k1), rows, k1)
        return pa.table({"grp": q["grp"].to_numpy()[found], "class_key": q["class_key"].to_numpy()[found], "near": pa.array(near, pa.list_(pa.int64())), "cosines": _whole(value)})

    home = materialize(at_home(ix, k1, at_its_home, "near array<bigint>, cosines array<int>, floor double"), lean=True, by="place")
    more = away(home, ix, ["grp", "class_key", "rows", "floor"], lambda q: q["floor"].to_numpy(), factor, False, elsewhere, "grp bigint, class_key bigint, near array<bigint>, cosines array<int>")
    pairs = F.arrays_zip((F.transform("cosines", lambda c: -c)).alias("c"), F.col("near").alias("r"))
    best = home.select("grp", "class_key", "n", "rows", "near", "cosines")
    if more is not None:
        brought = materialize(more, lean=True).groupBy("grp", "class_key").agg(F.flatten(F.collect_list(pairs)).alias("more"))  # at most k + 1 per shard
        best = best.join(brought, ["grp", "class_key"], "left").withColumn("best", F.when(F.col("more").isNull(), pairs).otherwise(F.slice(F.array_sort(F.concat(pairs, "more")), 1, k1))).drop("more")
    else:
        best = best.withColumn("best", pairs)
    others = F.slice(F.filter("best", lambda o: o["r"] != F.col("row")), 1, k)
    found = members_of(best, ix, "best", home).select("grp", "row", F.explode(others).alias("o"))
    return found.select("grp", "row", F.col("o.r").alias("near_row"), (-F.col("o.c") / F.lit(1e9)).alias("cosine"))


def _whole(cosines: list[np.ndarray]) -> pa.Array:
    """Cosines of 9 decimals as whole numbers, half as long."""
    return pa.array([np.rint(c * 1e9).astype(np.int32) for c in cosines], pa.list_(pa.int32()))


def members_of(classes: DataFrame, ix: Index, column: str, written: DataFrame) -> DataFrame:
    """grp, row and ``column`` of every row of classes (grp, class_key, n, rows, ``column``), each row once.

    Small classes hold their rows. Those of the others, if ``written``, the table behind classes, has any, are joined, hot
    classes in SALTS parts.
    """
    total, others = written.agg(F.sum("n"), F.count_if(F.col("n") > F.size("rows"))).first()
    rows = classes.where(F.col("n") <= F.size("rows")).select("grp", F.explode("rows").alias("row"), column)
    if not others:
        return rows
    large = classes.where(F.col("n") > F.size("rows"))
    hot = F.broadcast(large.where(F.col("n") * HOT_SHARE > total).select("grp", "class_key", F.lit(True).alias("hot")))  # fewer than HOT_SHARE rows
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = large.join(hot, ["grp", "class_key"], "left").select("grp", "class_key", F.explode(salts).alias("salt"), column)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int")
    members = ix.keys.join(hot, ["grp", "class_key"], "left").select("grp", "class_key", "row", salt.alias("salt"))
    return rows.unionByName(members.join(salted, ["grp", "class_key", "salt"]).dropDuplicates(["grp", "row"]).select("grp", "row", column))


def spanning_graph(ix: Index, min_cos: float, local: Callable, *, keep: int = 4, factor: float = 1.0) -> tuple[DataFrame, DataFrame | None]:
    """(classes with label, links between labels): a sparse graph that connects what cosines of ``min_cos`` connect.

    Within a shard the links of a spanning forest are given to ``local(rows, a, b, cosines)``, which returns a label, the
    smallest row of its cluster, for each class. Links (lo, hi, cosine) between labels of different shards are those of a
    spanning forest per visit, so they are fewer than the labels that meet, however many pairs are similar. Of two
    shards the looser visits the tighter one. Without visits there are none.
    """

    def at_its_home(s: Shard, g: Group | None):
        links = vptree.spanning_links(s.unit, s.unit, min_cos, same=True, factor=factor)
        labels = local(s.row, links)
        visits = g.tour(s.unit, s.cell, s.shard, np.full(len(s.row), min_cos), factor, True) if g else None
        return [pa.array(labels, pa.int64())], visits

    def elsewhere(q: pa.Table, x: np.ndarray, p: pa.Table, tree: vptree.Tree) -> pa.Table:
        names = np.concatenate([q["label"].to_numpy(), p["label"].to_numpy()])
        links = vptree.spanning_links(x, tree.points, min_cos, same=False, factor=factor, names=names, tree=tree)
        a, b, c = (np.array(x) for x in zip(*links)) if links else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        a, b = names[a], names[b + q.num_rows]
        return pa.table({"lo": np.minimum(a, b), "hi": np.maximum(a, b), "cosine": c})

    home = materialize(at_home(ix, keep, at_its_home, "label bigint"), lean=True, by="place")
    return home, away(home, ix, ["label"], lambda q: np.full(q.num_rows, min_cos), factor, True, elsewhere, "lo bigint, hi bigint, cosine double")
