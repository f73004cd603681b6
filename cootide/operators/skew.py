"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

1. ``plan_loads`` measures how many rows fall into each of a fixed number of hash buckets of the key. Only in
   buckets heavier than a task's share are single keys counted, so the driver sees the bucket loads (a fixed number)
   and the heavy keys (at most a small multiple of the number of tasks), whatever the table's size.
2. Buckets and the shards of heavy keys are packed onto tasks, largest first, each to the least loaded task. A heavy
   key gets shards in proportion to its load.
3. Rows are routed to tasks with one exchange. A row of a heavy key goes to the shard of its ``split_by`` hash. The
   matching side is routed the same way and is copied only for heavy keys, once to each of their shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 4096
CHUNK_ROWS = 100_000


@dataclass
class LoadPlan:
    """Where rows go. ``bucket_task[b]`` is the task of light keys in bucket b; ``heavy`` lists (key..., tasks)."""

    keys: list[str]
    tasks: int
    bucket_task: list[int]
    heavy: list[tuple[tuple, list[int]]]
    task_loads: list[float]

    def heavy_frame(self, df: DataFrame) -> DataFrame:
        schema = T.StructType([df.schema[k] for k in self.keys] + [T.StructField("_shards", T.ArrayType(T.IntegerType()))])
        return df.sparkSession.createDataFrame([(*key, tasks) for key, tasks in self.heavy], schema)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def pack(loads: list[tuple[float, object]], tasks: int) -> tuple[dict, list[float]]:
    """Largest-first packing of (load, item) onto tasks; returns item -> task and the task loads."""
    heap = [(0.0, t) for t in range(tasks)]
    where: dict = {}
    for load, item in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        total, task = heapq.heappop(heap)
        where[item] = task
        heapq.heappush(heap, (total + load, task))
    out = [0.0] * tasks
    for total, task in heap:
        out[task] = total
    return where, out


def plan_loads(df: DataFrame, keys: list[str], tasks: int, *, weight: Column | None = None, shard_share: float = 0.5, buckets: int = BUCKETS) -> LoadPlan:
    """Estimate loads of ``keys`` and pack them onto ``tasks``; a key above ``shard_share`` of a task's mean load is split.

    Rows whose key holds a null are not counted: callers route them as they like. Both aggregations combine on the
    map side, so a hot key costs one partial row per map task.
    """
    weight = F.lit(1) if weight is None else weight
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    known = known.select(*keys, weight.cast("long").alias("_w"), _bucket(keys, buckets).alias("_b"))
    loads = {r["_b"]: r["_n"] for r in known.groupBy("_b").agg(F.sum("_w").alias("_n")).collect()}
    cap = max(1.0, sum(loads.values()) / tasks * shard_share)
    full = sorted(b for b, n in loads.items() if n > cap)
    heavy: list[tuple[tuple, int]] = []
    if full:
        # At most total / cap = tasks / shard_share keys can exceed cap.
        rows = known.where(F.col("_b").isin(full)).groupBy("_b", *keys).agg(F.sum("_w").alias("_n")).where(F.col("_n") > cap).collect()
        for r in rows:
            heavy.append((tuple(r[k] for k in keys), r["_n"]))
            loads[r["_b"]] -= r["_n"]
    heavy.sort(key=lambda x: (-x[1], str(x[0])))
    items: list[tuple[float, object]] = [(n, ("b", b)) for b, n in loads.items() if n > 0]
    shards = {}
    for i, (_, n) in enumerate(heavy):
        shards[i] = int(min(tasks, -(-n // cap)))
        items += [(n / shards[i], ("h", i, s)) for s in range(shards[i])]
    where, task_loads = pack(items, tasks)
    return LoadPlan(keys, tasks, [where.get(("b", b), b % tasks) for b in range(buckets)], [(key, [where["h", i, s] for s in range(shards[i])]) for i, (key, _) in enumerate(heavy)], task_loads)


def _constant(values: list[int]) -> Column:
    """An array literal: one foldable expression instead of one per element."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def route(df: DataFrame, plan: LoadPlan, split_by: Column | None) -> DataFrame:
    """Add ``_task`` and ``_split``. With ``split_by`` a row of a heavy key goes to one shard; without, to all of them.

    The heavy list is broadcast: ``plan_loads`` proves that it has at most tasks / shard_share rows.
    """
    lut = _constant(plan.bucket_task)
    light = F.element_at(lut, _bucket(plan.keys, len(plan.bucket_task)) + 1)
    if not plan.heavy:
        return df.withColumns({"_task": light, "_split": F.lit(False)})
    joined = df.join(F.broadcast(plan.heavy_frame(df)), plan.keys, "left")
    heavy = F.col("_shards").isNotNull()
    if split_by is not None:
        at = F.element_at("_shards", (F.pmod(F.xxhash64(split_by), F.size("_shards").cast("long")) + 1).cast("int"))
        return joined.withColumns({"_task": F.when(heavy, at).otherwise(light), "_split": heavy}).drop("_shards")
    copies = F.when(heavy, F.array_distinct("_shards")).otherwise(F.array(light))
    return joined.withColumns({"_task": F.explode(copies), "_split": heavy}).drop("_shards")


def _task_values(df: DataFrame, tasks: int) -> list[int]:
    """Integers whose Spark hash puts them into partitions 0..tasks-1, so that one task is one partition."""
    seen: dict[int, int] = {}
    upto = 0
    while len(seen) < tasks:
        upto = upto * 2 or tasks * 16
        for r in df.sparkSession.range(upto).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(tasks)).alias("p")).agg(F.min("v").alias("v")).collect():
            seen[r["p"]] = r["v"]
    return [seen[p] for p in range(tasks)]


def exchange(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """One exchange that puts each planned task's rows into a partition of its own.

    ``_task`` is replaced by an integer whose hash is that partition, so Catalyst knows the partitioning and later
    aggregations whose keys hold ``_task`` need no exchange.
    """
    values = _constant(_task_values(df, plan.tasks))
    return df.withColumn("_task", F.element_at(values, F.col("_task") + 1)).repartition(plan.tasks, "_task")


def combine_batches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pre-aggregate chunks of CHUNK_ROWS rows to (keys..., n, total): a hot (key, split) pair leaves a map task as few rows."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def chunk(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        g = pa.Table.from_batches(held).group_by(keys).aggregate([([], "count_all"), (value, "sum")])
        return pa.table([*[g[k] for k in keys], g["count_all"].cast(pa.int64()), g[f"{value}_sum"].cast(pa.float64())], names=[*keys, "n", "total"]).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from chunk(held)
                held, rows = [], 0
        if rows:
            yield from chunk(held)

    return df.select(*keys, F.col(value).cast("double").alias(value)).mapInArrow(run, schema)


def keyed_fiber_counts(rows: DataFrame, matching: DataFrame, keys: list[str], fiber: str, value: str, *, tasks: int | None = None) -> DataFrame:
    """Per key: rows, distinct non-null fibers, sum of values, joined with the matching side; balanced over tasks.

    ``matching`` should hold ``keys`` once per key; of several rows the largest, by its columns in order, is taken whole. Its
    other columns come back as given. Loads are planned by rows, which bounds what is routed, as rows are combined before. Result: keys, n_rows (0 for a
    key that only the matching side has), n_fibers, sum_value (null without values), has_rows, has_match and the
    matching columns. A null in a key column forms no key on either side of the rows; matching rows with a null key
    come back unmatched. Empty inputs give an empty result or unmatched rows. Further columns of ``rows`` are ignored;
    a matching column may be called like any column of ``rows`` but not like a result column.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = [f"_k{i}" for i in range(len(keys))]
    left = rows.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], F.col(fiber).alias("_f"), F.col(value).cast("double").alias("_v"))
    left = left.where(reduce(lambda a, b: a & b, [F.col(i).isNotNull() for i in ids]))
    plan = plan_loads(left, ids, tasks)
    extra = [c for c in matching.columns if c not in keys]
    xs = [f"_x{i}" for i in range(len(extra))]
    types = [matching.schema[c].dataType for c in extra]
    named = matching.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], *[F.col(c).alias(x) for c, x in zip(extra, xs)])
    no_key = reduce(lambda a, b: a | b, [F.col(i).isNull() for i in ids])
    # One whole record per key first, so that what follows carries plain columns through hash aggregations.
    right = named.where(~no_key).groupBy(*ids).agg(F.max(F.struct(F.lit(1).alias("_m"), *xs)).alias("_r")).select(*ids, *[F.col(f"_r.{x}").alias(x) for x in xs], "_r._m")
    combined = combine_batches(left, [*ids, "_f"], "_v")
    a = route(combined, plan, F.col("_f")).select(*ids, "_task", "_f", "n", "total", *[F.lit(None).cast(t).alias(x) for x, t in zip(xs, types)], F.lit(None).cast("int").alias("_m"))
    b = route(right, plan, None).select(*ids, "_task", F.lit(None).cast(left.schema["_f"].dataType).alias("_f"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total"), *xs, "_m")
    carried = [F.max(c).alias(c) for c in (*xs, "_m")]  # one matching row per key, so max only picks it
    both = exchange(a.unionByName(b), plan)
    fibers = both.groupBy("_task", *ids, "_f").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), *carried)
    shard = fibers.groupBy("_task", *ids).agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, F.col("_f"))).alias("d"), F.sum("total").alias("total"), *carried)
    whole = shard.groupBy(*ids).agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_fibers"), F.sum("total").alias("sum_value"), *carried)
    alone = named.where(no_key).select(*ids, F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_fibers"), F.lit(None).cast("double").alias("sum_value"), *xs, F.lit(1).alias("_m"))
    return whole.unionByName(alone).select(*[F.col(i).alias(k) for k, i in zip(keys, ids)], "n_rows", "n_fibers", "sum_value", (F.col("n_rows") > 0).alias("has_rows"), F.col("_m").isNotNull().alias("has_match"), *[F.col(x).alias(c) for c, x in zip(extra, xs)])
