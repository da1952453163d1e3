"""Product listings, details and price-comparison groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import first_truthy, prefix_key


def with_source(products: DataFrame, sources: DataFrame) -> DataFrame:
    """Products with the name of their source, null where there is none."""
    return products.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("platform")), "source_id", "left")


def latest(products: DataFrame, sources: DataFrame, limit: int = 50, product_id: str = "id") -> DataFrame:
    """The newest products by id; the limit runs before the join."""
    newest = products.orderBy(F.col(product_id).desc()).limit(limit)
    return with_source(newest, sources).orderBy(F.col(product_id).desc())


def detail(products: DataFrame, sources: DataFrame, wanted: int, product_id: str = "id") -> DataFrame:
    """One product by id, no row if it is missing."""
    return with_source(products.where(F.col(product_id) == wanted), sources)


def comparable(products: DataFrame) -> DataFrame:
    """Products with the key of their comparison group; those without a name are left out."""
    return products.withColumn("group_key", prefix_key(first_truthy(F.col("name_normalized"), F.col("name")))).where("group_key <> ''")


def group_figures(order: str) -> list[Column]:
    """The aggregates of a group: the best offer is the cheapest one with a positive price, the later one (by
    ``order``) of equals, or the first item; name and image are the first item's; a missing rating is 0 in the mean."""
    seq = F.col(order)
    valid = (F.col("price") > 0) & ~F.isnan("price")
    item = F.struct(F.col("name").alias("name"), F.col("image_url").alias("image_url"), F.col("price").alias("price"), F.col("platform").alias("platform"))
    return [
        F.min_by(item, seq).alias("first"),
        F.min_by(item, F.when(valid, F.struct(F.col("price"), -seq))).alias("best"),
        F.avg(F.coalesce(F.when(~F.isnan("rating"), F.col("rating")), F.lit(0.0))).alias("mean_rating"),
        F.sum(F.coalesce("review_count", F.lit(0))).alias("total_reviews"),
        F.count("*").alias("n_offers"),
    ]


def group_columns() -> list[Column]:
    """The columns of a group from its aggregates; a mean rating of 0 is null."""
    best = F.coalesce("best", "first")
    return [
        F.col("group_key"),
        F.col("first.name").alias("canonical_name"),
        F.col("first.image_url").alias("image_url"),
        F.coalesce(F.when(~F.isnan(best["price"]), best["price"]), F.lit(0.0)).alias("best_price"),
        best["platform"].alias("best_platform"),
        F.nullif("mean_rating", F.lit(0.0)).alias("avg_rating"),
        F.col("total_reviews"),
        F.col("n_offers"),
    ]


def price_groups(products: DataFrame, order: str) -> DataFrame:
    """Products with equal first 50 characters of the name as one group.

    Needs ``name, name_normalized, price, platform, image_url, rating, review_count``.  Partial aggregates only: a group of any
    size costs its figures; its offers are the rows of :func:`price_offers`."""
    return comparable(products).groupBy("group_key").agg(*group_figures(order)).select(*group_columns())


def offer_columns() -> list[Column]:
    return [
        F.col("platform"), F.coalesce(F.when(~F.isnan("price"), F.col("price")), F.lit(0.0)).alias("price"), F.col("original_price"), F.col("discount_percent"),
        F.coalesce("external_url", F.lit("")).alias("url"), F.col("available"), F.col("id"),
    ]


def price_offers(products: DataFrame, order: str) -> DataFrame:
    """The offers of all groups in ascending order of price, one row each; the range sort splits a hot group."""
    return comparable(products).select("group_key", F.col(order).alias("seq"), *offer_columns()).orderBy("group_key", "price", "seq")


def page_groups(products: DataFrame, order: str) -> DataFrame:
    """The groups of one page of results with their offers and ids as arrays, in the order of the results."""
    offer = F.struct(F.col(order).alias("seq"), *offer_columns())
    out = comparable(products).groupBy("group_key").agg(*group_figures(order), F.array_sort(F.collect_list(offer)).alias("offers"))
    return out.select(*group_columns(), "offers", F.transform("offers", lambda o: o["id"]).alias("product_ids"))


def savings(products: DataFrame) -> DataFrame:
    """Per comparison group its offers and the spread of prices if there are several, else 0; without collecting the offers."""
    key = prefix_key(first_truthy(F.col("name_normalized"), F.col("name")))
    price = F.coalesce(F.when(~F.isnan("price"), F.col("price")), F.lit(0.0))
    out = products.withColumn("group_key", key).where("group_key <> ''").groupBy("group_key").agg(F.count("*").alias("n_offers"), F.min(price).alias("low"), F.max(price).alias("high"))
    return out.select("group_key", "n_offers", F.when(F.col("n_offers") > 1, F.col("high") - F.col("low")).otherwise(0.0).alias("savings"))


def offers_by_price(offers: Column) -> Column:
    """Offers in ascending order of price."""
    return F.array_sort(offers, lambda a, b: F.when(a["price"] < b["price"], -1).when(a["price"] > b["price"], 1).otherwise(0))


def image_list(image: Column, images: Column) -> Column:
    """The main image and the others, each once, in first-seen order, without empty ones."""
    every = F.concat(F.array(image), F.coalesce(images, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_figures(total: Column, number: int, limit: int) -> Column:
    """Total, page, limit and number of pages."""
    return F.struct(total.alias("total"), F.lit(number).alias("page"), F.lit(limit).alias("limit"), F.ceil(total / limit).alias("pages"))


def enriched(results: DataFrame, *stores: DataFrame, key: str = "doc_id", columns: list[str]) -> DataFrame:
    """Results with the columns of the first store that knows their key; unmatched results keep nulls."""
    out = results
    for n, store in enumerate(stores):
        out = out.join(store.select(key, *(F.col(c).alias(f"_{n}_{c}") for c in columns)), key, "left")
    chosen = [F.coalesce(*(F.col(f"_{n}_{c}") for n in range(len(stores)))).alias(c) for c in columns]
    return out.select(*results.columns, *chosen)


def overridden(results: DataFrame, products: DataFrame, key: str = "doc_id") -> DataFrame:
    """Products of results: a result's own name and price go before those of its product unless they are empty or 0.

    Results ``(doc_id, score, name, price)`` without a product keep what they have."""
    own = results.select(key, "score", F.col("name").alias("_name"), F.col("price").alias("_price"))
    out = own.join(products, key, "left")
    price = F.when((F.col("_price") != 0) & ~F.isnan("_price"), F.col("_price"))
    return out.withColumns({"name": first_truthy(F.col("_name"), F.col("name")), "price": F.coalesce(price, F.col("price"))}).drop("_name", "_price")


# What a console shows for a result without a product.
NO_NAME, NO_PRICE = "Unknown (DB lookup failed)", "N/A"


def with_placeholder(results: DataFrame, products: DataFrame, key: str = "doc_id") -> DataFrame:
    """``results`` with ``name`` and ``shown_price`` of their products, placeholders for those without one."""
    known = products.select(key, F.col("name").alias("_name"), F.col("price").cast("decimal(20,2)").cast("string").alias("_price"), F.lit(True).alias("_known"))
    out = results.join(known, key, "left")
    show = lambda c, none: F.when(F.col("_known"), F.col(c)).otherwise(none)
    return out.withColumns({"name": show("_name", NO_NAME), "shown_price": show("_price", NO_PRICE)}).drop("_name", "_price", "_known")


def numbered(results: DataFrame, order: list[Column], partition: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Results with their rank numbers, per partition or of the first ``limit`` results.

    One of the two is required: numbers of all rows would be one task's work."""
    if not partition and limit is None:
        raise ValueError("number results per partition or up to a limit")
    first = results if limit is None or partition else results.orderBy(*order).limit(limit)
    out = first.withColumn("number", F.row_number().over((W.partitionBy(*partition) if partition else W).orderBy(*order)))
    return out if limit is None or not partition else out.where(F.col("number") <= limit)
