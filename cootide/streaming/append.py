"""Tensors that grow: nonzeros arrive as a stream and are merged batch by batch.

Coordinates are additive, so each micro-batch is reduced to one row per coordinate and appended as Parquet under its batch
number; writing a batch again replaces it, so a restarted query counts nothing twice. Readers sum duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cootide.core import SparseTensor


def append_stream(stream: DataFrame, modes: list[str], value: str, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps the tensor of a stream's rows in ``table``; rows with a null index or value are left out."""
    x = stream.select(*[F.col(c).cast("long").alias(f"i{m}") for m, c in enumerate(modes)], F.col(value).cast("double").alias("val")).dropna()
    keys = [f"i{m}" for m in range(len(modes))]

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum("val").alias("val")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return x.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_table(spark: SparkSession, table: str, nmodes: int) -> SparseTensor:
    """The tensor of all batches so far, one nonzero per coordinate."""
    x = SparseTensor.from_dataframe(spark.read.parquet(table), [f"i{m}" for m in range(nmodes)], "val")
    return x.sum_duplicates()


def windowed_slices(stream: DataFrame, time: str, mode: str, value: str, window: str, late: str) -> DataFrame:
    """window, i, nnz, total per time window of a stream, rows later than ``late`` behind left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(mode).cast("long").alias("i")).agg(F.count(F.lit(1)).alias("nnz"), F.sum(value).alias("total"))
