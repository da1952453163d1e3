"""Dashboard figures over products, brands and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(products: DataFrame, brands: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: products, brands, and platforms with products (all platforms if none has any)."""
    counts = distribution(products, sources, key).agg(F.count_if(F.col("n") > 0).alias("a"), F.count("*").alias("b"))
    n, m, (a, b) = products.count(), brands.count(), counts.first()
    return products.sparkSession.createDataFrame([(n, m, a or b)], "total_products long, total_brands long, active_platforms long")


def distribution(products: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """``(name, n)`` of every source, also of empty ones; products are counted before the join."""
    counts = products.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("c"))
    return sources.select("id", "name").join(counts, "id", "left").groupBy("name").agg(F.sum(F.coalesce("c", F.lit(0))).alias("n"))


def by_platform(products: DataFrame, platform: str = "platform") -> DataFrame:
    """``(platform, n)`` with missing platforms as 'unknown'."""
    return products.groupBy(F.coalesce(platform, F.lit("unknown")).alias("platform")).agg(F.count("*").alias("n"))


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their share of the total in percent, one decimal; 0 when the total is 0. Rows with 0 are dropped."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = F.round(F.col(n) * 100.0 / total, 1) if total else F.lit(0.0)
    return counts.withColumn("share", share).where(F.col(n) > 0)


def completed_windows(logs: DataFrame, now, key: str, status: str = "status", ended: str = "ended_at") -> DataFrame:
    """Per key the completed runs in all, of the last day and of the last week, in one pass."""
    done = F.col(status) == "completed"
    return logs.groupBy(key).agg(
        F.count_if(done).alias("total"),
        F.count_if(done & (F.col(ended) >= now - F.expr("interval 24 hours"))).alias("last_24h"),
        F.count_if(done & (F.col(ended) >= now - F.expr("interval 7 days"))).alias("last_week"),
    )


def run_totals(runs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One row: products and errors of all runs ``(source, products, errors)`` of some sources, 0 without any."""
    own = runs if sources is None else runs.where(F.col("source").isin(sources))
    return own.agg(F.coalesce(F.sum("products"), F.lit(0)).alias("total_products"), F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"))


def per_source(frames: dict[str, DataFrame]) -> DataFrame:
    """``(source, status, n, error)`` of a query over several sources; one that cannot be read is reported, not fatal."""
    rows = []
    for name, df in frames.items():
        try:
            rows.append((name, "ok", df.count(), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "failed", 0, str(e).splitlines()[0][:200]))
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "source string, status string, n long, error string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several sources, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
