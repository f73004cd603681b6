"""Mixing sources to target shares of the total size, with capped repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cootide.session import materialize


def source_name(source: Column | str) -> Column:
    """Spelling variants of a source are one source: blanks around and case do not count; blank is no source."""
    return F.nullif(F.lower(F.regexp_replace(source, r"^\s+|\s+\z", "")), F.lit(""))


def repetition_rates(sizes: dict[str, int], targets: list[tuple[str, str, float, int]], totals: dict[str, float] | None = None) -> list[tuple[str, str, float, float]]:
    """(mix, source, target share, rate) for each target, rates being copies per record.

    Without a given total the mix is as large as it can be with all its shares met exactly: the largest total at which
    no present source exceeds its cap. With a given total, scarce sources stop at their cap. A source without any size
    cannot contribute: its rate is 0 and the others keep their proportions.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        mine = [t for t in targets if t[0] == mix]
        usable = [t for t in mine if sizes.get(t[1], 0) > 0 and t[2] > 0 and t[3] > 0]
        total = (totals or {}).get(mix)
        if total is None:
            total = min((t[3] * sizes[t[1]] / t[2] for t in usable), default=0.0)
        for _, source, share, cap in mine:
            size = sizes.get(source, 0)
            rate = min(float(cap or 0), share * total / size) if (mix, source, share, cap) in usable else 0.0
            if cap and rate > cap - 1e-9:
                rate = float(cap)
            out.append((mix, source, share, rate))
    return out


def sized(docs: DataFrame, key: str, source: str, size: Column) -> DataFrame:
    """Key, normalised source and size of each record, written once: every later step reads these three columns."""
    return materialize(docs.select(F.col(key).alias("key"), source_name(source).alias("source"), size.cast("long").alias("size")))


def mix(records: DataFrame, targets: DataFrame, *, totals: dict[str, float] | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). records: key, source, size as of ``sized``; targets: mix_name, source, target_share, max_repeats.

    selection: mix_name, source, key, copy_no (from 1), size. A record comes out floor(rate) times plus once more if its
    hash, seeded by mix and seed, falls below the rate's fraction; so never more than max_repeats times.
    shares: per target the rate, the size and share reached and the records and copies used.
    Records of no source, or of one no mix names, are not selected; records of size 0 or null count nothing towards a
    share but are selected like others (null as 0); a null key is a record like any other key. Nulls in a target
    row void it; targets for the same source of a mix, e.g. in two spellings, add their shares under the larger cap.
    Records of one key each hash alike. ``targets`` holds a handful of rows per mix and is read by the driver.
    """
    spark = records.sparkSession
    wanted = targets.select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats").dropna().groupBy("mix_name", "source").agg(F.sum("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()
    wanted = [(r["mix_name"], r["source"], float(r["s"]), int(r["m"])) for r in wanted]
    named = records.where(F.col("source").isin([t[1] for t in wanted]) if wanted else F.lit(False)).withColumn("size", F.coalesce("size", F.lit(0)))
    sizes = {r["source"]: r["n"] for r in named.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    rates = repetition_rates(sizes, wanted, totals)
    plan = F.broadcast(spark.createDataFrame(rates, "mix_name string, source string, target_share double, rate double"))
    unit = F.shiftrightunsigned(F.xxhash64(F.col("mix_name"), F.col("key"), F.lit(seed)), 11).cast("double") / float(1 << 53)
    copies = (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    chosen = named.join(plan, "source").withColumn("copies", copies).where("copies > 0")
    selection = chosen.select("mix_name", "source", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "size")
    used = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("used_size"), F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"))
    totals_used = used.groupBy("mix_name").agg(F.sum("used_size").alias("all_size"))
    shares = plan.join(used, ["mix_name", "source"], "left").join(F.broadcast(totals_used), "mix_name", "left")
    shares = shares.select("mix_name", "source", "target_share", "rate", F.coalesce("used_size", F.lit(0)).alias("used_size"), F.coalesce(F.col("used_size") / F.nullif(F.col("all_size"), F.lit(0)), F.lit(0.0)).alias("reached_share"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    return selection, shares
