"""Incremental ingestion: upserts of micro-batches, index maintenance and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from marketloom.operators.index import postings
from marketloom.operators.upsert import last_wins


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str) -> DataStreamWriter:
    """Every micro-batch's last row per key, written to its own version folder; :func:`current` reads the latest of each key.

    Folders are named by the batch's number and overwritten, so a batch that is run again leaves one copy."""

    def write(batch: DataFrame, epoch: int) -> None:
        last_wins(batch, keys, order).withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return stream.writeStream.foreachBatch(write)


def current(spark, path: str, keys: list[str]) -> DataFrame:
    """The latest version of every key."""
    return last_wins(spark.read.parquet(path).drop("epoch"), keys, "_epoch").drop("_epoch")


def index_batches(stream: DataFrame, path: str) -> DataStreamWriter:
    """Postings of every micro-batch of ``(doc_id, tokens)`` as a part of an index; ``index.merged`` adds parts up."""

    def write(batch: DataFrame, epoch: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/part={epoch:012d}")

    return stream.writeStream.foreachBatch(write)


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, late: str = "1 day") -> DataFrame:
    """Counts per window and key; late events within the watermark still count."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    """Counts per session of a key: runs of events with no longer gaps."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = timed.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, however often it arrives within the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(make: Callable[[], DataStreamWriter], checkpoint: str) -> None:
    """Processes everything that is there and stops."""
    make().option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
