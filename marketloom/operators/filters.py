"""Predicates and scans of product tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.platforms import expanded


def cleaned(df: DataFrame) -> DataFrame:
    """Curated defaults: trimmed non-empty external ids, descriptions of at most 200 characters, three
    images, missing counts 0, missing availability true."""
    out = df.withColumn("external_id", F.trim(F.col("external_id").cast("string"))).where("external_id <> ''")
    return out.withColumns(
        {
            "description": F.substring("description", 1, 200),
            "images": F.slice(F.coalesce("images", F.array().cast("array<string>")), 1, 3),
            "review_count": F.coalesce("review_count", F.lit(0)),
            "sold_count": F.coalesce("sold_count", F.lit(0)),
            "available": F.coalesce("available", F.lit(True)),
        }
    )


def positive_price(price: Column) -> Column:
    return (price > 0) & ~F.isnan(price)


def on_platforms(name: Column, platforms: Iterable[str]) -> Column:
    """Whether a shop's name is one of the requested ones in any spelling; null names are not."""
    names = expanded(list(platforms))
    return F.coalesce(F.lower(name).isin(names) | name.isin(names), F.lit(False))


def price_between(price: Column, low: float | None = None, high: float | None = None) -> Column:
    """An inclusive range; null prices are outside as soon as a bound is given."""
    out = F.lit(True)
    if low is not None:
        out = out & (price >= float(low))
    if high is not None:
        out = out & (price <= float(high))
    return F.coalesce(out, F.lit(False))


def with_ids(df: DataFrame, ids: DataFrame, column: str = "id", wanted: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids; ids that are no integers are dropped."""
    asked = ids.select(F.col(wanted).try_cast("long").alias("_id")).where("_id is not null").distinct()
    return df.join(asked, df[column].cast("long") == asked["_id"], "left_semi")


def substring_search(df: DataFrame, text: str, name: str, order: str, limit: int, price: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """The first rows (by ``order``) whose name contains a text, ignoring case; null prices pass the range."""
    keep = F.lower(F.col(name)).contains(text.lower())
    if price:
        keep = keep & (F.col(price).isNull() | price_between(F.col(price), low, high))
    return df.where(keep).orderBy(order).limit(limit)


def applies_to(targets: Column, source: str) -> Column:
    """Whether a list of sources holds 'all' or the source; everything applies to the source 'all'; null lists to none."""
    if source == "all":
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(targets, F.array(F.lit("all"), F.lit(source))), F.lit(False))


def stale(ts: Column, now: Column, hours: float) -> Column:
    """Never, or longer ago than some hours."""
    return ts.isNull() | (ts < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600)))


def of_source(source_id: Column, wanted: int) -> Column:
    """A source's own rows and those of no source."""
    return source_id.isNull() | (source_id == wanted)


def named_with_image(df: DataFrame) -> DataFrame:
    return df.where("coalesce(name, '') <> '' and coalesce(image_url, '') <> ''")
