"""Per-key results where a few keys hold most records (problem 3).

Method: two-stage salted aggregation.  Rows per key are counted first; a key that holds more than a
share of all rows is heavy and gets salts in proportion to its size; partial results are computed
per key and salt and merged by the key.  The salt is a hash of the row's id, so a task that is run again
after a lost executor gives the same salts as the first time.

Scale: there are fewer than ``1 / HEAVY`` heavy keys whatever the data, so the table of heavy keys is
safe to broadcast.  The first stage combines before the shuffle and then sees at most about
``HEAVY`` of the rows of one key per task; the second stage sees a row per salt.

Defined results: a null key is a key of its own; prices that are null, not positive or NaN are counted but take no
part in sums; of rows with equal times the largest id is the latest, null times come first; rows
repeated whole count each time; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 0.02  # the share of all rows from which a key is heavy
SALTED, SALTS, KEY = "__marketloom_salt", "__marketloom_salts", "__marketloom_key"


def heavy_keys(df: DataFrame, *keys: str, share: float = HEAVY) -> DataFrame:
    """The keys and their numbers of salts, of the keys with over ``share`` of all rows; fewer than ``1 / share`` rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__marketloom_n"))
    total = df.count()  # of a Parquet table this reads the footers only
    return counts.where(F.col("__marketloom_n") > share * total).select(*keys, F.ceil(F.col("__marketloom_n") / max(1.0, share * total)).cast("int").alias(SALTS))


def salted(df: DataFrame, keys: list[str], row_id: str, share: float = HEAVY) -> DataFrame:
    """``df`` with a salt: 0 for light keys, for heavy ones spread by a hash of the row's id."""
    heavy = heavy_keys(df, *keys, share=share).select(*(F.col(k).alias(f"{KEY}{i}") for i, k in enumerate(keys)), SALTS)
    same = [df[k].eqNullSafe(heavy[f"{KEY}{i}"]) for i, k in enumerate(keys)]
    joined = df.join(F.broadcast(heavy), same, "left")
    salt = F.when(F.col(SALTS).isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.col(SALTS))).cast("int")
    return joined.withColumn(SALTED, salt).drop(SALTS, *(f"{KEY}{i}" for i in range(len(keys))))


def aggregated(df: DataFrame, keys: list[str], row_id: str, partial: list[Column], final: list[Column], share: float = HEAVY) -> DataFrame:
    """Two-stage aggregation: ``partial`` per key and salt, ``final`` over those by key."""
    first = salted(df, keys, row_id, share).groupBy(*keys, SALTED).agg(*partial)
    return first.groupBy(*keys).agg(*final)


def price_stats(df: DataFrame, key: str = "source_id", row_id: str = "record_id", price: str = "price", share: float = HEAVY) -> DataFrame:
    """Per key: rows, valid prices, and their least, greatest, sum and mean (exact decimal sums)."""
    valid = F.when((F.col(price) > 0) & ~F.isnan(price), F.col(price))
    exact = valid.cast("decimal(20,2)")
    out = aggregated(
        df,
        [key],
        row_id,
        [F.count("*").alias("n"), F.count(valid).alias("p"), F.min(valid).alias("lo"), F.max(valid).alias("hi"), F.sum(exact).alias("s")],
        [F.sum("n").alias("n_rows"), F.sum("p").alias("n_prices"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price"), F.sum("s").alias("_s")],
        share,
    )
    total = F.col("_s").cast("double")
    return out.select(key, "n_rows", "n_prices", "min_price", "max_price", total.alias("sum_price"), (total / F.when(F.col("n_prices") > 0, F.col("n_prices"))).alias("avg_price"))


def latest(df: DataFrame, keys: list[str], row_id: str, time: str, keep: list[str], share: float = HEAVY) -> DataFrame:
    """The latest row of every key: ``keys``, ``row_id``, ``time`` and the columns in ``keep``."""
    row = F.struct(F.col(time), F.col(row_id), *(F.col(c) for c in keep))
    out = aggregated(df, keys, row_id, [F.max(row).alias("_r")], [F.max("_r").alias("_r")], share)
    return out.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [time, row_id, *keep]))


def distinct_items(df: DataFrame, key: str = "source_id", item: str = "external_id", row_id: str = "record_id", share: float = HEAVY) -> DataFrame:
    """Per key: distinct items and rows of the most repeated item; heavy (key, item) pairs are salted too."""
    pairs = aggregated(df, [key, item], row_id, [F.count("*").alias("n")], [F.sum("n").alias("n")], share)
    # an item lies in one group by now, so a salt by item splits a heavy key without counting twice
    first = salted(pairs, [key], item, share).groupBy(key, SALTED).agg(F.count(item).alias("d"), F.max(F.when(F.col(item).isNotNull(), F.col("n"))).alias("m"))
    return first.groupBy(key).agg(F.sum("d").alias("n_items"), F.max("m").alias("most_rows"))
