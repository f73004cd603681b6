"""Uniform sample of fixed size from records that arrive in pieces: a distributed reservoir for huge k.

The reservoir is spread over slots; a record's slot is a hash of its key. For each arriving piece, with N records seen and
n new ones, the number X of new records in the next sample is hypergeometric; X is split over the slots of the new
records and the evictions over the slots of the sample, both multivariate hypergeometric. Within a slot the evicted are
chosen uniformly by hash and the piece's sample is inserted. Only counts per (piece, slot) reach the driver, which draws
those numbers; records are touched by built-in expressions and one grouped function over about k (1 + ln(N / k)) keys.

A record that is delivered again is the record of its first delivery. Every choice depends on hashes of the key and on
the seed, so a recomputed task chooses the same records. The slots work on keys alone; the columns of the chosen are
fetched by one join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cootide.session import materialize, release

SLOT_ROWS = 8192
MOST_CELLS = 500_000  # batches times slots
MOST_BATCHES = 50_000
_TOP = float(1 << 53)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement; for any sizes, by inversion around the mode."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    n = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (n + 2)))
    sd = math.sqrt(draws * (good / n) * (bad / n) * max(1, n - draws) / max(1, n - 1))
    reach = int(14 * sd) + 40
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    x = np.arange(a, b, dtype=np.float64)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logs - logs.max())
    return int(a + np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, b - a))


def split_draws(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``draws`` fall into each group."""
    out, left = np.zeros(len(sizes), np.int64), int(np.sum(sizes))
    for g, size in enumerate(sizes):
        if not draws:
            break
        left -= int(size)
        out[g] = hypergeometric(rng, int(size), left, draws)
        draws -= int(out[g])
    return out


@dataclass
class Replacement:
    """Numbers drawn for the pieces in order: insert[p, s] records of piece p enter slot s, evict[p, s] leave it."""

    insert: np.ndarray
    evict: np.ndarray
    occupancy: np.ndarray
    seen: int


def draw_replacements(counts: np.ndarray, k: int, seed: int, *, occupancy: np.ndarray | None = None, seen: int = 0, first_piece: int = 0) -> Replacement:
    """Draw for new records counted by (piece, slot), continuing from a reservoir of given slot occupancy."""
    pieces, slots = counts.shape
    occupancy = np.zeros(slots, np.int64) if occupancy is None else occupancy.copy()
    insert, evict = np.zeros_like(counts), np.zeros_like(counts)
    for p in range(pieces):
        rng = np.random.default_rng([seed, first_piece + p])
        new, held = int(counts[p].sum()), int(occupancy.sum())
        size = min(k, seen + new)
        x = hypergeometric(rng, new, seen, size)
        insert[p] = split_draws(rng, counts[p], x)
        evict[p] = split_draws(rng, occupancy, held + x - size)
        occupancy += insert[p] - evict[p]
        seen += new
    return Replacement(insert, evict, occupancy, seen)


def _unit(key: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") / _TOP


def _mix(ids: np.ndarray, salt: int) -> np.ndarray:
    x = ids.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batched(records: dict[int, int], most: int) -> tuple[list[int], list[int]]:
    """(pieces in order, batch of each): consecutive pieces share a batch only where there are more than ``most``."""
    order = sorted(records)
    if len(order) <= most:
        return order, list(range(len(order)))
    share, done, batch = sum(records.values()) / most, 0, []
    for p in order:
        batch.append(min(most - 1, int(done / share)))
        done += records[p]
    dense = {b: i for i, b in enumerate(dict.fromkeys(batch))}
    return order, [dense[b] for b in batch]


def _pruned(firsts: DataFrame, frame: DataFrame, seed: int) -> DataFrame:
    """First deliveries whose hash is below the threshold of their own batch and slot."""
    return firsts.join(frame, ["_batch", "_slot"]).where(F.col("_u") <= F.col("_limit")).drop("_limit")


def sample_records(df: DataFrame, key: str, piece: str, k: int, *, columns: list[str], seed: int = 7, slots: int | None = None, stats: dict | None = None) -> DataFrame:
    """A uniform sample of min(k, distinct keys) records of ``df``, read piece by piece: key, first_piece, columns.

    Pieces arrive in ascending order of the integer ``piece``; records without a piece arrive in a last one of their
    own (first_piece null). A key delivered several times is one record, of its first piece; should copies in that piece
    differ, each column takes its smallest value. Rows without a key name no record and are left out. Nulls in
    ``columns`` are kept. An empty table, or k = 0, gives an empty sample; with k at least the number of records all are
    returned. ``columns`` must not hold the key or a name that starts with an underscore; other columns of ``df`` are not
    read. The driver holds one number per piece and MOST_CELLS numbers at most for pieces and slots; where pieces are
    more than that allows, neighbouring ones arrive as one batch, which leaves every record equally likely. ``stats``
    receives the number of records that pass the pruning.
    """
    spark = df.sparkSession
    last = (1 << 62)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(piece).cast("long"), F.lit(last)).alias("_piece"), *columns)
    firsts = materialize(rows.groupBy("_id").agg(F.min("_piece").alias("_piece")))
    records = {r["_piece"]: r["n"] for r in firsts.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots or max(1, min(-(-k // SLOT_ROWS), MOST_CELLS // max(1, min(len(records), MOST_BATCHES))))
    order, batch = batched(records, max(1, min(MOST_BATCHES, MOST_CELLS // slots)))
    places = _frame(spark, {"_piece": order, "_batch": np.array(batch, np.int32)}, "_piece bigint, _batch int")
    slot = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(slots)).cast("int").alias("_slot")
    numbered = firsts.join(F.broadcast(places), "_piece").select("_id", "_piece", "_batch", slot, _unit(F.col("_id"), seed).alias("_u"))
    counts = _cells(numbered, max(batch, default=-1) + 1, slots)
    drawn = draw_replacements(counts, k, seed)

    # The inserted are the smallest hashes of their batch and slot, so a threshold on the hash with ample margin leaves
    # about k (1 + ln(N / k)) records. It is that of the record's first delivery, whatever arrives later.
    want = drawn.insert.astype(float)
    share = np.where((counts > 0) & (want > 0), (want + 10 * np.sqrt(want) + 60) / np.maximum(counts, 1), 0)
    at = np.indices(share.shape)
    while True:
        limits = _frame(spark, {"_batch": at[0].ravel().astype(np.int32), "_slot": at[1].ravel().astype(np.int32), "_limit": share.ravel()}, "_batch int, _slot int, _limit double")
        limits = F.broadcast(limits)  # at most MOST_CELLS rows
        passed = materialize(_pruned(numbered, limits, seed))
        left = _cells(passed, *counts.shape)
        short = left < drawn.insert
        if not short.any():
            break
        share[short] = 1.0  # ten standard deviations missed: take all of such a cell
        release(passed)
    if stats is not None:
        stats["passed"] = int(left.sum())
    insert, evict = drawn.insert, drawn.evict

    def replay(t: pa.Table) -> pa.Table:
        """One slot: insert each batch's sample and evict uniformly, batch by batch."""
        t = t.sort_by([("_batch", "ascending"), ("_u", "ascending"), ("_id", "ascending")])
        s = t["_slot"][0].as_py()
        ids, starts = t["_id"].to_numpy(), np.searchsorted(t["_batch"].to_numpy(), np.arange(len(insert) + 1))
        held = np.zeros(0, np.int64)  # positions in t
        for p in range(len(insert)):
            if evict[p, s]:
                held = held[np.argsort(_mix(ids[held], seed * 1009 + p + 1), kind="stable")[evict[p, s] :]]
            held = np.concatenate([held, np.arange(starts[p], starts[p] + insert[p, s])])
        return t.take(pa.array(held)).select(["_id", "_piece", "_batch"])

    chosen = passed.groupBy("_slot").applyInArrow(replay, "_id bigint, _piece bigint, _batch int")
    chosen = materialize(chosen.select("_id", "_piece"))
    # The records' columns: rows of every piece below its threshold hold the first delivery of all that were chosen.
    likely = rows.join(F.broadcast(places), "_piece").withColumns({"_slot": slot, "_u": _unit(F.col("_id"), seed)}).join(limits, ["_batch", "_slot"]).where(F.col("_u") <= F.col("_limit"))
    out = likely.select("_id", "_piece", *columns).join(chosen, ["_id", "_piece"]).groupBy("_id", "_piece").agg(*[F.min(c).alias(c) for c in columns])
    release(firsts), release(passed)
    return out.select(F.col("_id").alias(key), F.when(F.col("_piece") != last, F.col("_piece")).alias("first_piece"), *columns)


def _frame(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return spark.createDataFrame(pa.table({n: pa.array(columns[n], kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))}), schema)


def _cells(numbered: DataFrame, batches: int, slots: int) -> np.ndarray:
    """Records per (batch, slot); at most MOST_CELLS numbers."""
    out = np.zeros((batches, slots), np.int64)
    t = numbered.groupBy("_batch", "_slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out[t["_batch"].to_numpy(), t["_slot"].to_numpy()] = t["n"].to_numpy()
    return out
