"""Most frequent items with bounded memory: a mergeable majority-vote sketch.

Each of ``depth`` rows has ``width`` cells. A cell keeps the total number of items hashed to it, one candidate, and the
candidate's vote surplus. Within a cell, for every item x that is not the candidate, count(x) <= (total - surplus) / 2,
and for the candidate, surplus <= count <= (total + surplus) / 2. Cells merge by vote cancellation: equal candidates add
their surplus, different ones cancel it. The bounds hold whatever the order of merging.

Every task keeps one sketch of fixed size (modes * depth * width cells). The merge is two Catalyst aggregations with
map-side combine. The merged sketch has the same fixed size, whatever the number of rows or of distinct items, so the
driver reads it to bound the candidates' counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FOLD_ROWS = 1 << 18
MOST_WIDTH = 1 << 18
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def cell_of(values: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each int64 value in a hash row; width is a power of two."""
    x = values.view(np.uint64) ^ _SEEDS[row % 8] + np.uint64(row // 8)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(width - 1)).astype(np.int64)


class Cells:
    """One column's cells: arrays of shape (depth, width)."""

    def __init__(self, depth: int, width: int):
        self.total = np.zeros((depth, width), np.int64)
        self.candidate = np.zeros((depth, width), np.int64)
        self.surplus = np.zeros((depth, width), np.int64)

    def add(self, values: np.ndarray) -> None:
        """Vote with a block of values: each cell's block majority, then cancellation against what the cell held."""
        items, counts = np.unique(values, return_counts=True)
        depth, width = self.total.shape
        for row in range(depth):
            cell = cell_of(items, row, width)
            total = np.bincount(cell, counts, width).astype(np.int64)
            most = np.zeros(width, np.int64)
            np.maximum.at(most, cell, counts)
            top = np.flatnonzero(counts == most[cell])[::-1]  # of equals the smallest item stays
            candidate = np.zeros(width, np.int64)
            candidate[cell[top]] = items[top]
            self._merge(row, total, candidate, np.maximum(0, 2 * most - total))

    def _merge(self, row: int, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        held, votes = self.candidate[row].copy(), self.surplus[row].copy()
        same = held == candidate
        self.total[row] += total
        self.surplus[row] = np.where(same, votes + surplus, np.abs(votes - surplus))
        self.candidate[row] = np.where(~same & (surplus > votes), candidate, held)


def _sketch_batches(batches, n_columns: int, depth: int, width: int):
    columns = [Cells(depth, width) for _ in range(n_columns)]
    held: list[pa.RecordBatch] = []

    def fold():
        t = pa.Table.from_batches(held)
        for c, cells in enumerate(columns):
            values = t.column(c).drop_null().to_numpy()
            if len(values):
                cells.add(np.ascontiguousarray(values, dtype=np.int64))
        held.clear()

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOLD_ROWS:
            fold()
            rows = 0
    if held:
        fold()
    for c, cells in enumerate(columns):
        row, cell = np.nonzero(cells.total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(row), c, np.int32)), pa.array(row.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(cells.candidate[row, cell]), pa.array(cells.surplus[row, cell]), pa.array(cells.total[row, cell])],
            ["col", "row", "cell", "candidate", "surplus", "total"],
        )


def sketch(df: DataFrame, columns: list[str], *, depth: int = 4, width: int = 4096) -> DataFrame:
    """Merged cells (col, row, cell, candidate, surplus, total) of integer columns; nulls are no items.

    The result has at most len(columns) * depth * width rows. An empty table has none.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    parts = df.select(*[F.col(c).cast("long") for c in columns]).mapInArrow(
        lambda batches: _sketch_batches(batches, len(columns), depth, width),
        "col int, row int, cell int, candidate bigint, surplus bigint, total bigint",
    )
    return merge_sketches(parts)


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Merge cells of any number of sketches of equal shape, as one vote among each cell's candidates."""
    votes = parts.groupBy("col", "row", "cell", "candidate").agg(F.sum("surplus").alias("s"), F.sum("total").alias("t"))
    cells = votes.groupBy("col", "row", "cell").agg(F.max(F.struct("s", (-F.col("candidate")).alias("c"))).alias("top"), F.sum("s").alias("all"), F.sum("t").alias("total"))
    return cells.select("col", "row", "cell", (-F.col("top.c")).alias("candidate"), F.greatest(F.lit(0), 2 * F.col("top.s") - F.col("all")).cast("long").alias("surplus"), "total")


@dataclass
class Sketch:
    """A merged sketch on the driver; its fixed size bounds what is read here."""

    total: np.ndarray  # (columns, depth, width)
    candidate: np.ndarray
    surplus: np.ndarray

    @classmethod
    def of(cls, cells: DataFrame, n_columns: int, depth: int, width: int) -> Sketch:
        t = cells.toArrow()
        out = cls(*(np.zeros((n_columns, depth, width), np.int64) for _ in range(3)))
        at = tuple(t.column(c).to_numpy() for c in ("col", "row", "cell"))
        for array, name in ((out.total, "total"), (out.candidate, "candidate"), (out.surplus, "surplus")):
            array[at] = t.column(name).to_numpy()
        return out

    def bounds(self) -> list[tuple[int, int, int, int, int]]:
        """(col, item, lower, upper, column total) of every candidate, largest upper bound first: lower <= count <= upper."""
        out = []
        columns, depth, width = self.total.shape
        for c in range(columns):
            total, cand, surplus = self.total[c], self.candidate[c], self.surplus[c]
            items = np.unique(cand[(total > 0) & (surplus > 0)])
            if not len(items):
                continue
            upper, lower = np.full(len(items), np.iinfo(np.int64).max), np.zeros(len(items), np.int64)
            for row in range(depth):
                cell = cell_of(items, row, width)
                mine = (cand[row, cell] == items) & (total[row, cell] > 0)
                sign = np.where(mine, surplus[row, cell], -surplus[row, cell])
                upper = np.minimum(upper, (total[row, cell] + sign) // 2)
                lower = np.maximum(lower, np.where(mine, surplus[row, cell], 0))
            n = int(total[0].sum())
            out += [(c, int(i), int(lo), int(up), n) for i, lo, up in zip(items, lower, upper)]
        return sorted(out, key=lambda x: (x[0], -x[3], x[1]))

    def open_cells(self, share: float) -> list[np.ndarray | None]:
        """Per column the cells (depth, width) in which an item that is no candidate may fill ``share`` of the column; None
        if some row has no such cell, for then no item can, as each has a cell in every row."""
        out: list[np.ndarray | None] = []
        for total, surplus in zip(self.total, self.surplus):
            bad = (total - surplus) // 2 >= max(1.0, share * total[0].sum())
            out.append(bad if bad.any(axis=1).all() else None)
        return out


def candidates(cells: DataFrame, n_columns: int, *, depth: int = 4, width: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """``Sketch.bounds`` of merged cells."""
    return Sketch.of(cells, n_columns, depth, width).bounds()


def width_for(share: float) -> int:
    """A power of two with at least 16 cells per possible item of that share, MOST_WIDTH at most: what collides more in so
    many cells is found by ``_missed``."""
    return 1 << max(8, min(MOST_WIDTH.bit_length() - 1, int(np.ceil(np.log2(16 / share)))))


def _missed(df: DataFrame, columns: list[str], sketch: Sketch, share: float) -> DataFrame | None:
    """(col, item, n): exact counts of the items all of whose cells are open, the only ones that the sketch may have missed;
    None if there are no such cells."""
    open_cells = sketch.open_cells(share)
    if all(c is None for c in open_cells):
        return None
    shared = df.sparkSession.sparkContext.broadcast(open_cells)  # bits of the sketch's fixed size

    def run(batches):
        for b in batches:
            for c, cells in enumerate(shared.value):
                if cells is None:
                    continue
                items, n = np.unique(b.column(c).drop_null().to_numpy(), return_counts=True)
                keep = np.ones(len(items), bool)
                for row in range(len(cells)):
                    keep &= cells[row, cell_of(items, row, cells.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), c, np.int32)), pa.array(items[keep]), pa.array(n[keep])], ["col", "item", "n"])

    parts = df.select(*[F.col(c).cast("long") for c in columns]).mapInArrow(run, "col int, item bigint, n bigint")
    return parts.groupBy("col", "item").agg(F.sum("n").alias("n"))


def frequent_bounds(df: DataFrame, columns: list[str], share: float, *, depth: int = 4, width: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(col, item, lower, upper, column total) of the items whose upper bound reaches ``share`` of the column: candidates of
    the sketch, and where the sketch cannot exclude others those that a second pass over its open cells finds.

    Fewer than 1 / share items of a column reach the share, but more may by their bounds; at most a candidate per cell.
    """
    width = width or width_for(share)
    merged = Sketch.of(sketch(df, columns, depth=depth, width=width), len(columns), depth, width)
    found = {(x[0], x[1]): x for x in merged.bounds() if x[3] >= share * x[4]}
    missed = _missed(df, columns, merged, share)
    if missed is not None:
        totals = merged.total[:, 0].sum(axis=1)
        need = F.element_at(F.array(*[F.lit(float(max(1.0, share * n))) for n in totals]), F.col("col") + 1)
        for r in missed.where(F.col("n") >= need).collect():  # fewer than 1 / share per column
            found[r["col"], r["item"]] = (r["col"], r["item"], r["n"], r["n"], int(totals[r["col"]]))
    return sorted(found.values(), key=lambda x: (x[0], -x[3], x[1]))


def frequent_items(df: DataFrame, columns: list[str], share: float, *, depth: int = 4) -> DataFrame:
    """Approximate counts of items that may fill ``share`` of a column: mode_no, idx, lower_count, upper_count, rows.

    mode_no is the position in ``columns``. Nulls are no items; ties and repeated rows count as they stand; an empty
    table or an all-null column gives no rows. Other columns of ``df`` are not read.
    """
    rows = frequent_bounds(df, columns, share, depth=depth)
    return df.sparkSession.createDataFrame(rows, "mode_no int, idx bigint, lower_count bigint, upper_count bigint, rows bigint")


def frequent_exact(df: DataFrame, columns: list[str], share_num: int, share_den: int, *, depth: int = 4) -> DataFrame:
    """Items filling at least share_num / share_den of a column: mode_no, idx, n_rows, found by the sketch.

    A second pass counts the sketch's candidates exactly; they are at most modes * depth * MOST_WIDTH, so they are broadcast.
    """
    found = frequent_bounds(df, columns, share_num / share_den, depth=depth)
    need = df.sparkSession.createDataFrame([(c, i, -(-n * share_num // share_den)) for c, i, _, _, n in found], "mode_no int, idx bigint, need bigint")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode_no"), F.col(c).cast("long").alias("idx")) for m, c in enumerate(columns)])).alias("p")).select("p.*")
    counted = pairs.join(F.broadcast(need), ["mode_no", "idx"]).groupBy("mode_no", "idx", "need").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= F.col("need")).select("mode_no", "idx", "n_rows")
