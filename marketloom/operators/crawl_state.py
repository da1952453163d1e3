"""The state of crawls from an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.filters import stale
from marketloom.operators.upsert import one_per_key


def item_key(keyword: Column, category: Column) -> Column:
    return F.coalesce(F.nullif(keyword, F.lit("")), category.cast("string"), F.lit("general"))


def item_type(keyword: Column) -> Column:
    return F.when(F.coalesce(keyword, F.lit("")) != "", "keyword").otherwise("category")


def log_status(status: Column) -> Column:
    return F.when(status == "running", "in_progress").when(status.isin("completed", "failed"), status).otherwise("pending")


def run_status(total: Column, errors: Column) -> Column:
    return F.when(total > 0, F.when(errors > 0, "partial").otherwise("completed")).otherwise("failed")


def progress(logs: DataFrame, key: list[str], started: str = "started_at", tie: str = "id") -> DataFrame:
    """The latest log row of every item."""
    return one_per_key(logs, key, [F.col(started).desc_nulls_last(), F.col(tie).desc()])


def queue(latest: DataFrame, now: Column, hours: float = 24, ended: str = "ended_at", status: str = "status") -> DataFrame:
    """Items with their place: in_progress, pending (never or long ago) or recently_completed."""
    place = F.when(F.col(status) == "in_progress", "in_progress").when(stale(F.col(ended), now, hours), "pending").otherwise("recently_completed")
    return latest.withColumn("place", place)


def pending_order(ended: str = "ended_at") -> list[Column]:
    """Never crawled first, then the oldest."""
    return [F.col(ended).asc_nulls_first()]


def recent(logs: DataFrame, now: Column, hours: float, status: str = "status", ended: str = "ended_at") -> DataFrame:
    return logs.where((F.col(status) == "completed") & (F.col(ended) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))))


def uncrawled(items: DataFrame, item: Column, logs: DataFrame, logged: Column) -> DataFrame:
    """Items that no recent log row names; keys are compared as strings."""
    done = logs.select(logged.cast("string").alias("_done")).where("_done is not null").distinct()
    return items.withColumn("_item", item.cast("string")).join(done, F.col("_item") == F.col("_done"), "left_anti").drop("_item")


def to_skip(items: DataFrame, item: Column, logs: DataFrame, logged: Column) -> DataFrame:
    """Items that a recent log row names."""
    done = logs.select(logged.cast("string").alias("_done")).where("_done is not null").distinct()
    return items.withColumn("_item", item.cast("string")).join(done, F.col("_item") == F.col("_done"), "left_semi").drop("_item")


def opened(runs: DataFrame, now: Column) -> DataFrame:
    """Log rows for runs ``(id, source_id, keyword, category_id)`` that begin now."""
    none = lambda t: F.lit(None).cast(t)
    return runs.select(
        "id", "source_id", "keyword", "category_id", F.lit("running").alias("status"), now.cast("timestamp").alias("started_at"), none("timestamp").alias("ended_at"),
        none("long").alias("total_items"), none("long").alias("new_items"), none("long").alias("updated_items"), none("long").alias("errors"),
    )


def closed(logs: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """``logs`` with the figures ``(id, total_items, new_items, updated_items, errors)`` of runs that end now, and their status."""
    names = ["total_items", "new_items", "updated_items", "errors"]
    right = counts.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in names))
    done = F.col("_id").isNotNull()
    out = logs.join(right, logs["id"] == right["_id"], "left")
    out = out.withColumns({c: F.when(done, F.col(f"_{c}")).otherwise(F.col(c)) for c in names} | {"status": F.when(done, run_status(F.col("_total_items"), F.col("_errors"))).otherwise(F.col("status")), "ended_at": F.when(done, now.cast("timestamp")).otherwise(F.col("ended_at"))})
    return out.select(*logs.columns)
