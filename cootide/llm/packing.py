"""Packing items of whole-number sizes into containers of fixed capacity: bulk-synchronous best fit.

Items and gaps are range-sorted by size. In each round one successor sweep matches them: going up, every gap takes the
largest waiting item that fits it and that no smaller gap took, which is the pairing in which each item has the
smallest gap left for it and, when several want a gap, the larger item goes first. All gaps are then updated at once.
When no waiting item finds a gap, new containers are opened for the largest ones.

Sizes are whole numbers up to the capacity, so items of equal size are a run, and a sweep matches runs: its work depends on
the number of different sizes, not of items. The runs of a capacity are swept by one task as long as they are no more
than RANGE_RUNS; beyond that, every sweep is cut into ranges of that many runs, which tasks sweep side by side, and what is
left over, items below and gaps above, is matched between ranges by rank. The result does not depend on the number of
ranges. The range sort of the items (ties broken by key, so an equal size splits over tasks) and the assignment of
each item by its global rank are distributed too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cootide.functions import ranking
from cootide.session import materialize, release

RANGE_RUNS = 1_000_000
BROADCAST_RUNS = 2_000_000
BLOCK_BITS = 16

# A match of items with containers: ``n`` items of global ranks from ``at``, one each into containers from ``first``.
_PLAN = "limit_id int, at bigint, n bigint, first bigint"
# What a sweep leaves: matches (what 0), waiting items (1) and free gaps (2). ``pos`` is how many units of the same kind
# stand before it in its range: of items from the largest down, of gaps from the smallest up.
_SWEPT = "part int, limit_id int, what int, size bigint, gap bigint, n bigint, at bigint, first bigint, pos bigint"


def sweep(items: list[list[int]], gaps: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Match ascending runs of items [size, left, end] with ascending runs of gaps (gap, first, n).

    Gives matches (size, gap, n, at, first) and the gaps that stay free. Items wait on a stack, so a gap takes the largest
    below it. ``left`` is lowered in place; the waiting items of a run are the last of its ranks.
    """
    stack: list[int] = []
    matches, free, next_item = [], [], 0
    for gap, first, n in gaps:
        while next_item < len(items) and items[next_item][0] <= gap:
            stack.append(next_item)
            next_item += 1
        while n and stack:
            run = items[stack[-1]]
            use = min(n, run[1])
            if use:
                matches.append((run[0], gap, use, run[2] - run[1], first))
                run[1] -= use
                first, n = first + use, n - use
            if not run[1]:
                stack.pop()
        if n:
            free.append((gap, first, n))
    return matches, free


def opened(items: list[list[int]], capacity: int, containers: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches of the largest waiting items with as many new containers as all waiting items fill at least."""
    new = -(-sum(size * left for size, left, _ in items) // capacity)
    matches = []
    for run in reversed(items):
        use = min(new, run[1])
        if use:
            matches.append((run[0], capacity, use, run[2] - run[1], containers))
            run[1] -= use
            containers, new = containers + use, new - use
        if not new:
            break
    return matches, containers


def match_runs(capacity: int, sizes: list[int], counts: list[int], ends: list[int]) -> tuple[list[tuple[int, int, int]], int]:
    """All rounds for the runs of one capacity, sizes ascending: ([(at, n, first container)], containers)."""
    items = [[s, n, e] for s, n, e in zip(sizes, counts, ends) if n]
    gaps: list[tuple[int, int, int]] = []
    out, containers = [], 0
    while items:
        matches, gaps = sweep(items, gaps)
        if not matches:
            matches, containers = opened(items, capacity, containers)
        out += [(at, n, first) for _, _, n, at, first in matches]
        gaps = sorted(gaps + [(gap - size, first, n) for size, gap, n, _, first in matches if gap > size])
        items = [r for r in items if r[1]]
    return out, containers


def _sweep_ranges(batches):
    """Sweep the sorted runs (part, limit_id, size, kind, n, ref) of one range, capacity by capacity."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    part = t["part"][0].as_py()
    limits, size, kind, n, ref = (t[c].to_numpy() for c in ("limit_id", "size", "kind", "n", "ref"))
    for limit in np.unique(limits).tolist():
        mine = limits == limit
        items = [[s, c, r + c] for s, k, c, r in zip(size[mine].tolist(), kind[mine].tolist(), n[mine].tolist(), ref[mine].tolist()) if not k]
        gaps = [(s, r, c) for s, k, c, r in zip(size[mine].tolist(), kind[mine].tolist(), n[mine].tolist(), ref[mine].tolist()) if k]
        matches, free = sweep(items, gaps)
        rows = [(part, limit, 0, s, g, c, at, first, 0) for s, g, c, at, first in matches]
        pos = 0
        for s, left, end in reversed(items):
            if left:
                rows.append((part, limit, 1, s, 0, left, end - left, 0, pos))
                pos += left
        pos = 0
        for g, first, c in free:
            rows.append((part, limit, 2, 0, g, c, 0, first, pos))
            pos += c
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    kinds = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in _SWEPT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def between_ranges(left: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Segments that match what ranges leave over: (segment, limit, item range, from, gap range, from, units).

    left: (limit, range, units of items, units of gaps), ranges ascending. Gaps of a range take items of the nearest range
    below that has any, its largest first; they all are larger than these.
    """
    out, stacks = [], {}
    for limit, part, items, gaps in sorted(left):
        stack, taken = stacks.setdefault(limit, []), 0
        while gaps and stack:
            use = min(gaps, stack[-1][1])
            out.append((len(out), limit, stack[-1][0], stack[-1][2], part, taken, use))
            stack[-1][1] -= use
            stack[-1][2] += use
            taken, gaps = taken + use, gaps - use
            if not stack[-1][1]:
                stack.pop()
        if items:
            stack.append([part, items, 0])
    return out


def _match_segment(t: pa.Table) -> pa.Table:
    """Pair the items of a segment, largest first, with its gaps, smallest first, unit by unit."""
    t = t.sort_by([("pos", "ascending")])
    items, gaps = (t.filter(pc.equal(t["what"], w)).select(["limit_id", "size", "gap", "n", "at", "first"]).to_pylist() for w in (1, 2))
    rows, k, used = [], 0, 0
    for g in gaps:
        first, n = g["first"], g["n"]
        while n and k < len(items):
            i = items[k]
            use = min(n, i["n"] - used)
            rows.append((0, i["limit_id"], 0, i["size"], g["gap"], use, i["at"] + used, first, 0))
            first, n, used = first + use, n - use, used + use
            if used == i["n"]:
                k, used = k + 1, 0
    return pa.Table.from_batches([_batch(rows)])


def _over_cluster(classes: DataFrame, caps: dict[int, int]) -> DataFrame:
    """The rounds of ``match_runs`` with runs in tables of the shared folder and sweeps over ranges: limit_id, at, n, first.

    classes: limit_id, size, n, at. The driver holds numbers per range and capacity only.
    """
    spark = classes.sparkSession
    runs = materialize(classes.select("limit_id", "size", F.lit(0).alias("kind"), "n", F.col("at").alias("ref")))
    containers, plans = dict.fromkeys(caps, 0), []
    while n_runs := runs.count():
        key = ["limit_id", "size", "kind", "ref"]
        ranged = runs.repartitionByRange(-(-n_runs // RANGE_RUNS), *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
        swept = materialize(ranged.mapInArrow(_sweep_ranges, _SWEPT))
        left = swept.where("what > 0").groupBy("limit_id", "part").agg(F.sum(F.when(F.col("what") == 1, F.col("n"))).alias("i"), F.sum(F.when(F.col("what") == 2, F.col("n"))).alias("g")).collect()
        segments = between_ranges([(r["limit_id"], r["part"], r["i"] or 0, r["g"] or 0) for r in left])
        cut = [(s, limit, 1, p, a, n) for s, limit, p, a, _, _, n in segments] + [(s, limit, 2, p, a, n) for s, limit, _, _, p, a, n in segments]
        frame = F.broadcast(spark.createDataFrame(cut, "segment int, limit_id int, what int, part int, start bigint, units bigint"))  # a few per range
        rest = swept.where("what > 0")
        meet = (F.col("pos") < F.col("start") + F.col("units")) & (F.col("start") < F.col("pos") + F.col("n"))
        low = F.greatest("pos", "start")
        high = F.least(F.col("pos") + F.col("n"), F.col("start") + F.col("units"))
        skip = low - F.col("pos")
        pieces = rest.join(frame, ["limit_id", "what", "part"]).where(meet).select("segment", "limit_id", "what", "size", "gap", (high - low).alias("n"), (F.col("at") + skip).alias("at"), (F.col("first") + skip).alias("first"), low.alias("pos"))
        crossed = pieces.groupBy("segment").applyInArrow(_match_segment, _SWEPT)
        matches = materialize(swept.where("what = 0").unionByName(crossed).select("limit_id", "size", "gap", "n", "at", "first"))
        # Segments take leftovers from their start on, so of every range some first units are gone.
        taken = F.broadcast(frame.groupBy("limit_id", "what", "part").agg(F.max(F.col("start") + F.col("units")).alias("taken")))
        gone = F.least(F.col("n"), F.greatest(F.lit(0), F.coalesce("taken", F.lit(0)) - F.col("pos")))
        rest = rest.join(taken, ["limit_id", "what", "part"], "left").withColumn("gone", gone).where("gone < n")
        waiting = rest.where("what = 1").select("limit_id", "size", (F.col("n") - F.col("gone")).alias("n"), (F.col("at") + F.col("gone")).alias("at"))
        free = rest.where("what = 2").select("limit_id", "gap", (F.col("n") - F.col("gone")).alias("n"), (F.col("first") + F.col("gone")).alias("first"))
        placed = {r["limit_id"] for r in matches.select("limit_id").distinct().collect()}
        stuck = {r["limit_id"]: r["t"] for r in waiting.groupBy("limit_id").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect() if r["limit_id"] not in placed}
        plans.append(matches)
        if stuck:
            need = F.broadcast(spark.createDataFrame([(limit, -(-t // caps[limit]), containers[limit], caps[limit]) for limit, t in stuck.items()], "limit_id int, new bigint, held bigint, cap bigint"))
            down = waiting.join(need, "limit_id").withColumns({"down": -F.col("size"), "one": F.lit(0)})
            ordered = ranking.running_sum(down, ["limit_id", "down"], "n", "all_before")
            starts = ordered.groupBy("limit_id").agg(F.min("all_before").alias("limit_before"))
            before = F.col("all_before") - F.col("limit_before")
            ordered = ordered.join(starts, "limit_id").withColumn("use", F.least(F.col("n"), F.greatest(F.lit(0), F.col("new") - before))).withColumn("first", F.col("held") + before)
            ordered = materialize(ordered.select("limit_id", "size", "n", "at", "use", "first", "cap"))
            fresh = ordered.where("use > 0").select("limit_id", "size", F.col("cap").alias("gap"), F.col("use").alias("n"), "at", "first")
            plans.append(fresh)
            matches = matches.unionByName(fresh)
            others = waiting.where(~F.col("limit_id").isin(list(stuck)))
            waiting = others.unionByName(ordered.where("use < n").select("limit_id", "size", (F.col("n") - F.col("use")).alias("n"), (F.col("at") + F.col("use")).alias("at")))
            for limit, t in stuck.items():
                containers[limit] += min(-(-t // caps[limit]), _units(ordered, limit))
        updated = matches.where("gap > size").select("limit_id", (F.col("gap") - F.col("size")).alias("gap"), "n", "first")
        wait = waiting.select("limit_id", "size", F.lit(0).alias("kind"), "n", F.col("at").alias("ref"))
        alive = wait.select("limit_id").distinct()
        gaps = free.unionByName(updated).join(F.broadcast(alive), "limit_id", "left_semi").select("limit_id", F.col("gap").alias("size"), F.lit(1).alias("kind"), "n", F.col("first").alias("ref"))
        new_runs = materialize(wait.unionByName(gaps))
        release(runs), release(swept)
        runs = new_runs
    out = spark.createDataFrame([], _PLAN)
    for p in plans:
        out = out.unionByName(p.select("limit_id", "at", "n", "first"))
    return materialize(out)


def _units(ordered: DataFrame, limit: int) -> int:
    return ordered.where(F.col("limit_id") == limit).agg(F.sum("n")).first()[0] or 0


def _rounds(classes: DataFrame, caps: dict[int, int]) -> DataFrame:
    """limit_id, at, n, first: the plan of all capacities."""
    size = {r["limit_id"]: r["count"] for r in classes.groupBy("limit_id").count().collect()}
    large = [limit for limit, n in size.items() if n > RANGE_RUNS]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("size")
        limit = t["limit_id"][0].as_py()
        n, at = t["n"].to_numpy(), t["at"].to_numpy()
        out, _ = match_runs(caps[limit], t["size"].to_pylist(), n.tolist(), (at + n).tolist())
        at, n, first = zip(*out)
        return pa.table({"limit_id": pa.array([limit] * len(out), pa.int32()), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64())})

    out = classes.where(~F.col("limit_id").isin(large)).groupBy("limit_id").applyInArrow(run, _PLAN)
    if large:
        out = out.unionByName(_over_cluster(classes.where(F.col("limit_id").isin(large)), {k: caps[k] for k in large}))
    return materialize(out)


def pack(items: DataFrame, key: str, size: str, limits: DataFrame) -> DataFrame:
    """Assign items to containers of every capacity: limit_id, container_id, key, piece_no, n_tokens.

    items: one row per unique ``key`` with a whole ``size``; limits: limit_id, capacity_tokens (few rows). An item larger
    than the capacity is cut into full pieces and a rest, pieces numbered from 0; no other item is cut. Items of size 0
    or null fill no container and do not come out, nor do items without a key; capacities that are null or below 1
    are left out. Equal sizes are placed in order of the key. Empty inputs give an empty result. Other columns of
    either table are not read. Containers are numbered from 0 within each limit_id.
    """
    caps = {r["limit_id"]: r["capacity_tokens"] for r in limits.select("limit_id", "capacity_tokens").where("limit_id IS NOT NULL AND capacity_tokens > 0").collect()}
    each = F.expr("array(" + ", ".join(f"struct({int(i)} AS limit_id, {int(c)}L AS _cap)" for i, c in sorted(caps.items())) + ")") if caps else F.expr("cast(array() AS array<struct<limit_id: int, _cap: bigint>>)")
    # Sizes are written once: counting them may be dear, and the range sort reads its input twice.
    sized = materialize(items.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size")))
    x = sized.where("_key IS NOT NULL AND _size > 0").select("_key", "_size", F.inline(each))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_size - 1) div _cap"))).alias("_piece")
    x = x.select("limit_id", "_cap", "_key", "_size", piece).select("limit_id", F.least(F.col("_cap"), F.col("_size") - F.col("_piece") * F.col("_cap")).alias("_n"), "_key", "_piece")
    ranked = ranking.global_rank(x, ["limit_id", "_n", "_key", "_piece"], "_rank")
    # Ranks of a size follow the sort order, so a run is an interval of ranks.
    classes = materialize(ranked.groupBy("limit_id", F.col("_n").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("_rank").alias("at")))
    plan = _rounds(classes, caps)
    schema = f"limit_id int, container_id bigint, key {items.schema[key].dataType.simpleString()}, piece_no bigint, n_tokens bigint"

    def placed(t: pa.Table | pa.RecordBatch, at: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        rank = t["_rank"].to_numpy()
        run = np.searchsorted(at, rank, side="right") - 1
        return [t["limit_id"], pa.array(first[run] + rank - at[run]), t["_key"], t["_piece"], t["_n"]]

    names = ["limit_id", "container_id", "key", "piece_no", "n_tokens"]
    if plan.count() <= BROADCAST_RUNS:
        p = plan.select("at", "first").orderBy("at").toArrow()
        shared = items.sparkSession.sparkContext.broadcast((p["at"].to_numpy(), p["first"].to_numpy()))

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays(placed(b, *shared.value), names)

        out = ranked.mapInArrow(assign, schema)
    else:  # blocks of ranks meet the runs that reach into them

        def meet(rows: pa.Table, runs: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.Table.from_batches([], schema=pa.schema([("limit_id", pa.int32()), ("container_id", pa.int64()), ("key", rows["_key"].type), ("piece_no", pa.int64()), ("n_tokens", pa.int64())]))
            runs = runs.sort_by("at")
            return pa.Table.from_arrays(placed(rows, runs["at"].to_numpy(), runs["first"].to_numpy()), names)

        block = lambda c: F.shiftright(c, BLOCK_BITS)
        reach = F.explode(F.sequence(block(F.col("at")), block(F.col("at") + F.col("n") - 1))).alias("block")
        runs = plan.select("at", "first", reach)
        rows = ranked.select("limit_id", "_n", "_key", "_piece", "_rank", block(F.col("_rank")).alias("block"))
        out = rows.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(meet, schema)
    return out.withColumnRenamed("key", key)
