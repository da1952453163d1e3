"""Deduplication, upserts and the splits between new and known rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return one_per_key(df, keys, [F.col(order).desc()])


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return one_per_key(df, keys, [F.col(order).asc()])


def matching(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join on null-safe keys."""
    right = b.select(*(F.col(k).alias(f"_r_{k}") for k in keys)).distinct()
    return a.join(right, [a[k].eqNullSafe(right[f"_r_{k}"]) for k in keys], how)


def new_rows(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return matching(batch, known, keys, "left_anti")


def known_rows(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return matching(batch, known, keys, "left_semi")


def upsert(known: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``known`` with the batch's rows inserted or put in their place; the batch's last row of a key wins."""
    fresh = last_wins(batch, keys, order).select(*known.columns)
    return new_rows(known, fresh, keys).unionByName(fresh)


def upsert_counts(known: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys of a batch are inserted and how many updated."""
    fresh = batch.select(*keys).distinct()
    have = known.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.lit(1).alias("_have")).distinct()
    both = fresh.join(have, [fresh[k].eqNullSafe(have[f"_r_{k}"]) for k in keys], "left")
    return both.agg(F.count_if(F.col("_have").isNull()).alias("inserted"), F.count_if(F.col("_have").isNotNull()).alias("updated"))


def update_columns(known: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``known`` with only some columns taken from the batch where the key exists, other keys inserted."""
    right = batch.select(*(F.col(c).alias(f"_n_{c}") for c in known.columns), F.lit(True).alias("_new"))
    both = known.withColumn("_old", F.lit(True)).join(right, [known[k].eqNullSafe(right[f"_n_{k}"]) for k in keys], "full")
    has_new = F.coalesce("_new", F.lit(False))
    has_old = F.coalesce("_old", F.lit(False))
    return both.select(*(F.when(has_new & (~has_old | F.lit(c in columns)), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in known.columns))


def insert_ignore(known: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``known`` with the batch's rows of unknown keys, the first of each key."""
    return known.unionByName(new_rows(first_wins(batch, keys, order), known, keys).select(*known.columns))


def marked(df: DataFrame, where: Column, column: str, now: Column) -> DataFrame:
    """A time column set to now for some rows."""
    return df.withColumn(column, F.when(where, now).otherwise(F.col(column)))
