"""Data-quality predicates and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PRICE = 1e9
SHORT_NAME = 10


def flags(df: DataFrame) -> DataFrame:
    """The rows of ``name, price, image_url, external_url`` with one flag per problem; a short name is noted but not bad."""
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    none = F.col("price").isNull() | F.isnan("price")
    web = lambda c: F.coalesce(F.col(c).startswith("http"), F.lit(False))
    out = df.withColumns(
        {
            "missing_name": blank,
            "short_name": ~blank & (F.length("name") < SHORT_NAME),
            "missing_price": none,
            "invalid_price": ~none & ((F.col("price") <= 0) | (F.col("price") > MOST_PRICE)),
            "missing_image": ~web("image_url"),
            "missing_url": ~web("external_url"),
        }
    )
    return out.withColumn("good", ~(F.col("missing_name") | F.col("missing_price") | F.col("invalid_price") | F.col("missing_image") | F.col("missing_url")))


NAMES = ["missing_name", "short_name", "missing_price", "invalid_price", "missing_image", "missing_url", "good"]


def report(df: DataFrame, *by: str) -> DataFrame:
    """Rows, counts of every problem and the percentage of good rows (null without rows), in one pass."""
    out = flags(df).groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(c)).alias(c) for c in NAMES))
    return out.withColumn("good_rate", F.round(F.try_divide(F.col("good") * 100.0, F.col("total")), 2))


def report_of_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The report over raw JSON lines (column ``value``); blank lines are skipped, unreadable ones count in the total only."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"))
    ok = parsed.where("r is not null and (r.name is not null or r.price is not null or r.image_url is not null or r.external_url is not null)").select("r.*")
    total = parsed.agg(F.count("*").alias("total"))
    rest = report(ok).drop("total", "good_rate")
    n = total.first()[0]
    return rest.withColumn("total", F.lit(n)).withColumn("good_rate", F.round(F.try_divide(F.col("good") * 100.0, F.lit(n)), 2))
