"""Landed files: JSON lines, shop responses, sitemaps and listing pages.

Fetching is not the engine's task; everything starts from files that some crawler has landed.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.parse import absolute_url, digits_price, discount_percent, first_match, flatten_specs, original_if_higher, rating, sold_count
from marketloom.functions.text import first_truthy
from marketloom.operators.upsert import first_wins, new_rows, one_per_key

RECORD = "source_id int, external_id string, external_url string, name string, price string, image_url string, brand_raw string, category_raw string, crawled_at timestamp"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines; blank and unreadable lines are dropped, prices may be numbers or strings."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).withColumn("price", F.col("price").try_cast("double"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (column ``value``) without blank ones, unreadable ones kept."""
    return spark.read.text(path).where(F.trim("value") != "")


def append_new(batch: DataFrame, known: DataFrame, path: str, keys: list[str] = ["source_id", "external_id"], order: str = "crawled_at") -> int:
    """Appends the rows with a positive price and an unknown key as JSON lines; returns how many."""
    fresh = new_rows(first_wins(batch.where("price > 0 and not isnan(price)"), keys, order), known, keys).persist()
    n = fresh.count()
    fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def run_report(df: DataFrame, path: str) -> None:
    """The figures of a run as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def partitioned_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, fetch: int = 1000) -> DataFrame:
    """A database table read in parallel ranges of a column, in fetches of some rows."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


# --- responses of shops -------------------------------------------------------------------------

PAGED = """data array<struct<id: string, name: string, url_path: string, price: double, original_price: double, discount_rate: double, brand_name: string,
 rating_average: double, review_count: bigint, quantity_sold: struct<value: bigint>, thumbnail_url: string, short_description: string,
 specifications: array<struct<attributes: array<struct<name: string, value: string>>>>>>, paging struct<current_page: int, last_page: int>"""


def paged_products(responses: DataFrame, base: str) -> DataFrame:
    """Products of a paged listing API: column ``value`` has one response each."""
    items = responses.select(F.explode(F.from_json("value", PAGED)["data"]).alias("p")).where("p.price > 0")
    return items.select(
        F.col("p.id").alias("external_id"),
        absolute_url(F.col("p.url_path"), base).alias("external_url"),
        F.col("p.name").alias("name"),
        F.col("p.price").alias("price"),
        original_if_higher(F.col("p.original_price"), F.col("p.price")).alias("original_price"),
        F.coalesce("p.discount_rate", F.lit(0.0)).alias("discount_percent"),
        F.col("p.brand_name").alias("brand"),
        F.col("p.rating_average").alias("rating"),
        F.coalesce("p.review_count", F.lit(0)).alias("review_count"),
        F.coalesce("p.quantity_sold.value", F.lit(0)).alias("sold_count"),
        F.col("p.thumbnail_url").alias("image_url"),
        F.substring("p.short_description", 1, 200).alias("description"),
        F.coalesce(flatten_specs(F.col("p.specifications")), F.create_map().cast("map<string,string>")).alias("specs"),
    )


GRAPH = """data struct<products: array<struct<general: struct<product_id: string, name: string, url_path: string, manufacturer: string,
 categories: array<struct<name: string>>>, filterable: struct<price: double, special_price: double, thumbnail: string>>>>"""


def graph_products(responses: DataFrame, base: str, images: str) -> DataFrame:
    """Products of a graph API: the special price if there is one, the first category's name."""
    items = responses.select(F.explode(F.from_json("value", GRAPH)["data"]["products"]).alias("p"))
    price = F.when(F.col("p.filterable.special_price") > 0, F.col("p.filterable.special_price")).otherwise(F.col("p.filterable.price"))
    full = F.col("p.filterable.price")
    return items.where(price > 0).select(
        F.col("p.general.product_id").alias("external_id"),
        absolute_url(F.col("p.general.url_path"), base).alias("external_url"),
        F.col("p.general.name").alias("name"),
        price.alias("price"),
        original_if_higher(full, price).alias("original_price"),
        discount_percent(full, price).alias("discount_percent"),
        F.col("p.general.manufacturer").alias("brand"),
        F.get(F.col("p.general.categories"), F.lit(0))["name"].alias("category"),
        absolute_url(F.col("p.filterable.thumbnail"), images).alias("image_url"),
    )


AJAX = """mods struct<listItems: array<struct<itemId: string, nid: string, name: string, price: string, originalPrice: string, discount: string, brandName: string,
 ratingScore: string, review: string, itemSoldCntShow: string, image: string, itemUrl: string>>>"""


def ajax_products(responses: DataFrame, base: str) -> DataFrame:
    """Products of an ajax listing: all values are strings; unreadable responses give no rows."""
    items = responses.select(F.explode(F.from_json("value", AJAX)["mods"]["listItems"]).alias("p"))
    price = digits_price(F.regexp_replace("p.price", r"\.[0-9]{1,2}$", ""))
    full = digits_price(F.regexp_replace("p.originalPrice", r"\.[0-9]{1,2}$", ""))
    return items.where(price > 0).select(
        first_truthy(F.col("p.itemId"), F.col("p.nid")).alias("external_id"),
        absolute_url(F.col("p.itemUrl"), base).alias("external_url"),
        F.col("p.name").alias("name"),
        price.alias("price"),
        original_if_higher(full, price).alias("original_price"),
        F.col("p.brandName").alias("brand"),
        F.col("p.ratingScore").try_cast("double").alias("rating"),
        F.coalesce(F.col("p.review").try_cast("long"), F.lit(0)).alias("review_count"),
        sold_count(F.col("p.itemSoldCntShow")).alias("sold_count"),
        F.col("p.image").alias("image_url"),
    )


ADS = "ads array<struct<list_id: string, subject: string, price: double, image: string, category_name: string>>"


def classified_ads(responses: DataFrame, base: str) -> DataFrame:
    """Products of a listing of classified ads; ads state no brand."""
    items = responses.select(F.explode(F.from_json("value", ADS)["ads"]).alias("p")).where("p.price > 0")
    url = F.concat(F.lit(base.rstrip("/") + "/"), F.col("p.list_id"), F.lit(".htm"))
    return items.select(F.col("p.list_id").alias("external_id"), url.alias("external_url"), F.col("p.subject").alias("name"), F.col("p.price").alias("price"), F.col("p.image").alias("image_url"), F.lit(None).cast("string").alias("brand"), F.col("p.category_name").alias("category"))


# --- sitemaps -----------------------------------------------------------------------------------


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(loc, lastmod, changefreq, priority)`` of url sets; empty locations are dropped."""
    schema = "loc string, lastmod string, changefreq string, priority double"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).withColumn("loc", F.trim("loc")).where("loc <> ''")


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """``(loc)`` of the sitemaps that an index names."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("loc")).where("loc <> ''")


def sitemap_texts(documents: DataFrame) -> DataFrame:
    """``(kind, loc)`` and the other columns of whole XML documents in column ``value``: those of an index if it is one, else those of the url set."""
    of_index = F.expr("xpath(value, '/*[local-name()=\"sitemapindex\"]/*[local-name()=\"sitemap\"]/*[local-name()=\"loc\"]/text()')")
    of_set = F.expr("xpath(value, '/*[local-name()=\"urlset\"]/*[local-name()=\"url\"]/*[local-name()=\"loc\"]/text()')")
    kind = F.when(F.size(of_index) > 0, "index").otherwise("urls")
    locs = F.when(F.size(of_index) > 0, of_index).otherwise(of_set)
    others = [c for c in documents.columns if c not in ("value", "kind", "loc")]
    return documents.select(*others, kind.alias("kind"), F.explode(locs).alias("loc")).withColumn("loc", F.trim("loc")).where("loc <> ''")


def distinct_urls(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("loc")
    for s in sets[1:]:
        out = out.unionByName(s.select("loc"))
    return out.distinct()


# --- listing pages ------------------------------------------------------------------------------


class Elements(HTMLParser):
    """Elements of a page with their attributes, texts, and parents."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[dict] = []
        self.open: list[int] = []
        self.end: list[int] = []  # the number of the first element after each one's inner elements; 0 while it is open

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.all.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": [], "up": self.open[-1] if self.open else -1})
        self.end.append(len(self.all) if tag in self.VOID else 0)
        if tag not in self.VOID:
            self.open.append(len(self.all) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.all[self.open[k]]["tag"] == tag:
                for i in self.open[k:]:
                    self.end[i] = len(self.all)
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.all[i]["text"].append(data)

    def text(self, i: int) -> str:
        return " ".join("".join(self.all[i]["text"]).split())


def chosen(page: Elements, selector: str) -> list[int]:
    """The elements that a simple selector ('tag.class[attribute]', parts optional) selects."""
    head, _, attribute = selector.rstrip("]").partition("[")
    tag, *classes = head.split(".")
    return [
        i
        for i, e in enumerate(page.all)
        if (not tag or e["tag"] == tag) and set(classes) <= set(e["attrs"].get("class", "").split()) and (not attribute or attribute in e["attrs"])
    ]


def inside(page: Elements, i: int) -> range:
    """An element and those inside it; one that was never closed reaches to the end of the page."""
    return range(i, page.end[i] or len(page.all))


def page_items(html: str, selectors: list[str]) -> list[dict]:
    """The items of a listing page by the first selector that yields any: attributes first, then texts."""
    page = Elements()
    page.feed(html)
    for selector in selectors:
        out = []
        for i in chosen(page, selector):
            inner = inside(page, i)
            attrs = page.all[i]["attrs"]
            link = next((page.all[j]["attrs"] for j in inner if page.all[j]["tag"] == "a" and page.all[j]["attrs"].get("href")), {})
            image = next((page.all[j]["attrs"] for j in inner if page.all[j]["tag"] == "img"), {})
            by_class = lambda c: next((page.text(j) for j in inner if c in page.all[j]["attrs"].get("class", "")), "")
            name = attrs.get("data-name") or next((page.text(j) for j in inner if page.all[j]["tag"] in ("h2", "h3")), "") or by_class("name")
            if name and (link.get("href") or attrs.get("data-id")):
                out.append(
                    {
                        "external_id": attrs.get("data-id") or attrs.get("data-productid") or "",
                        "href": link.get("href", ""),
                        "name": name,
                        "price": attrs.get("data-price") or by_class("price"),
                        "brand": attrs.get("data-brand", ""),
                        "image": image.get("data-src") or image.get("src", ""),
                        "rating": next((page.all[j]["attrs"].get("style", "") for j in inner if "width:" in page.all[j]["attrs"].get("style", "")), "") or by_class("rating"),
                    }
                )
        if out:
            return out
    return []


PRICE_TEXT = r"[0-9]{1,3}(?:[.,][0-9]{3})+\s*(?:₫|đ|VND)"


def page_links(html: str) -> list[dict]:
    """Links with a text whose element, or one of three around it of under 500 characters, shows a price."""
    import re

    page = Elements()
    page.feed(html)
    out = []
    for i in chosen(page, "a[href]"):
        at = i
        for _ in range(4):
            text = page.text(at)
            if len(text) < 500 and (m := re.search(PRICE_TEXT, text)):
                name = page.all[i]["attrs"].get("title") or page.text(i)
                if name:
                    out.append({"href": page.all[i]["attrs"]["href"], "name": name, "price": m[0]})
                break
            at = page.all[at]["up"]
            if at < 0:
                break
    return out


ITEM = "external_id string, href string, name string, price string, brand string, image string, rating string"


def html_items(pages: DataFrame, selectors: list[str], base: str, html: str = "html") -> DataFrame:
    """Products of listing pages: ids from attributes or the address, prices from their digits, no rows without a price."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for h in b[html] if h for r in page_items(h, selectors)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM.split(", ")])

    raw = pages.select(html).mapInPandas(run, ITEM)
    ids = first_truthy(F.col("external_id"), first_match(F.col("href"), [r"-p?([0-9]+)\.html", r"-([0-9]+)$", r"/([^/]+)\.html"]))
    out = raw.select(ids.alias("external_id"), absolute_url(F.col("href"), base).alias("external_url"), "name", digits_price(F.col("price")).alias("price"), F.nullif("brand", F.lit("")).alias("brand"), absolute_url(F.col("image"), base).alias("image_url"), rating(F.col("rating")).alias("rating"))
    return out.where("price > 0 and external_id is not null")


def html_links(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """``(external_url, name, price)`` of priced links on any page, each address once: the smallest name, then price."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for h in b[html] if h for r in page_links(h)]
            yield pd.DataFrame(rows, columns=["href", "name", "price"])

    raw = pages.select(html).mapInPandas(run, "href string, name string, price string")
    priced = raw.select(absolute_url(F.col("href"), base).alias("external_url"), "name", digits_price(F.col("price")).alias("price"))
    return one_per_key(priced, ["external_url"], [F.col("name").asc(), F.col("price").asc()])


# Where pages of sources state a category id, in the order they are tried.
CATEGORY_IDS = {
    "cellphones": [
        r'"currentCategoryId"\s*:\s*"?([0-9]+)"?',
        r'"categoryId"\s*:\s*"?([0-9]+)"?',
        r'category_id\\?"\s*:\s*\\?"?([0-9]+)\\?"?',
        r'"id"\s*:\s*([0-9]+),\s*"name"[^}]+Mobile',
    ],
    "dienmayxanh": [
        r"\bcateID\s*=\s*[\"']?([1-9][0-9]*)",
        r"<[^>]*\bid=[\"']?hdCateId[\"']?[^>]*\bvalue=[\"']?([^\"'\s>]+)",
        r"<[^>]*\bvalue=[\"']?([^\"'\s>]+)[\"']?[^>]*\bid=[\"']?hdCateId\b",
        r'class="[^"]*__cate_([0-9]+)',
    ],
}
CATEGORY_IDS["thegioididong"] = CATEGORY_IDS["dienmayxanh"]


def category_id(html: Column, source: str = "cellphones") -> Column:
    """The category id that a page of a source states, by the first of its patterns that matches, else null."""
    return first_match(html, CATEGORY_IDS.get(source, CATEGORY_IDS["cellphones"]))


# --- keywords and categories --------------------------------------------------------------------


def keywords(df: DataFrame, source: str, now: Column, category: str | None = None, hours: float | None = None) -> DataFrame:
    """Active keywords of a source, by priority and text; with ``hours`` only stale ones."""
    from marketloom.operators.filters import applies_to, stale

    out = df.where(F.coalesce("is_active", F.lit(True)) & applies_to(F.col("applies_to"), source))
    if category:
        out = out.where(F.col("category") == category)
    if hours is not None:
        out = out.where(stale(F.col("last_crawled_at"), now, hours))
    return out.orderBy("priority", "keyword")


def categories(df: DataFrame, source_id: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Active categories, a source's own and those of all; without those of ``done(category_id)``."""
    from marketloom.operators.filters import of_source

    out = df.where("is_active")
    if source_id is not None:
        out = out.where(of_source(F.col("source_id"), source_id))
    if done is not None:
        out = out.join(done.select(F.col("category_id").cast("string").alias("_d")).distinct(), F.col("id").cast("string") == F.col("_d"), "left_anti")
    return out
