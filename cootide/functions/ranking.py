"""Global ranks and dense ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cootide.session import materialize


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row in the order of the columns ``order``, which must not tie.

    A range exchange sorts; one small count per partition gives the offsets, so no task holds more than its range.
    Nulls sort first. An empty frame stays empty.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asc = [F.asc_nulls_first(c) for c in order]
    placed = materialize(df.repartitionByRange(partitions, *asc).sortWithinPartitions(*asc).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    lut = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.element_at(lut, (part + 1).cast("int")) + local).drop("_at")


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): every distinct non-null value with its 0-based position in ascending order."""
    return global_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)


BLOCK_BITS = 16


def running_sum(df: DataFrame, order: list[str], value: str, name: str, block: str | None = None) -> DataFrame:
    """Add the exclusive running sum of ``value`` in the order of the untied columns ``order``.

    Sums of fixed-size blocks of the global rank are summed first, those of blocks of blocks before them, so windows see
    one block of rows, one block of blocks, or one row per 2^32 rows. With ``block`` the number of a row's block is added.
    """
    ranked = global_rank(df, order, "_rank").withColumn("_block", F.shiftright("_rank", BLOCK_BITS))
    blocks = ranked.groupBy("_block").agg(F.sum(value).alias("_sum")).withColumn("_outer", F.shiftright("_block", BLOCK_BITS))
    every = Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)
    outer = blocks.groupBy("_outer").agg(F.sum("_sum").alias("_all")).select("_outer", F.coalesce(F.sum("_all").over(every), F.lit(0)).alias("_outer_start"))
    before = Window.partitionBy("_outer").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.join(outer, "_outer").select("_block", (F.col("_outer_start") + F.coalesce(F.sum("_sum").over(before), F.lit(0))).alias("_start"))
    inside = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.join(starts, "_block").withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.withColumn(block, F.col("_block")) if block else out
    return out.drop("_rank", "_block", "_start")
