"""Queries of operators whose input is given here or written by the query itself: every shape that an operator tells apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.engine import Engine, request_from
from marketloom.functions import display, parse, text
from marketloom.operators import catalog, crawl_state, filters, index, platforms, quality, ranking, segmentation, stats, tree, upsert
from marketloom.plans.queries import BM25, LOGS, NAMED, SPACE, TOP, logs
from marketloom.plans.registry import oracle_sql, queries, query  # noqa: F401
from marketloom.session import scratch, table
from marketloom.sources import landed, vectors


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """A SQL table of literal rows."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names}))"


# --- values read from strings, every shape --------------------------------------------------------

SOLD = [("1,2k", 1200), ("1.5K", 1500), ("345", 345), ("Đã bán 2k", 2000), ("3,25k đã bán", 3250), ("12,5", 13), ("abc", 0), ("", 0), (None, 0)]
PRICES = [("15.990.000₫", 15990000.0), ("19.5", 195.0), ("Liên hệ", 0.0), ("", 0.0), (None, 0.0), ("1 200 đ", 1200.0), ("12,000 - 15,000", 1200015000.0)]
PRODUCT_IDS = [
    ("https://tiki.vn/noi-p123.html", "tiki", "123"), ("https://tiki.vn/p77.html?x", "tiki", "77"), ("https://www.lazada.vn/products/a-i55-s6.html", "lazada", "55"),
    ("https://www.lazada.vn/a-i9.html", "lazada", "9"), ("https://www.dienmayxanh.com/tivi/x-44", "dienmayxanh", "44"), ("https://cellphones.com.vn/iphone-15.html", "cellphones", "iphone-15"),
    ("https://cellphones.com.vn/", "cellphones", None), ("https://tiki.vn/a", "tiki", None), ("https://x.example/p1.html", "x", None), (None, "tiki", None),
]


@query(f"SELECT written, CAST(n AS BIGINT) AS n FROM {values(SOLD, 'written, n')}")
def sold_count_shapes(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, SOLD, "written string, want long").select("written", parse.sold_count(F.col("written")).alias("n"))


@query(f"SELECT written, CAST(price AS DOUBLE) AS price FROM {values(PRICES, 'written, price')}")
def price_shapes(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, PRICES, "written string, want double").select("written", parse.digits_price(F.col("written")).alias("price"))


@query(f"SELECT * FROM {values(PRODUCT_IDS, 'url, platform, product')}")
def product_id_shapes(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, PRODUCT_IDS, "url string, platform string, want string").select("url", "platform", parse.product_id(F.col("url"), F.col("platform")).alias("product"))


NAMED_PLATFORMS = [
    ("Tiki ", None, "tiki"), (None, "https://Shopee.vn/x", "shopee"), ("unknown", "https://www.fahasa.com/a", "fahasa"), ("NULL", "https://x.example", "null"), ("Điện Máy Xanh", None, "dienmayxanh"),
    ("the gioi di dong", "https://tiki.vn/a", "thegioididong"), ("cell phones", None, "cellphones"), ("", "https://cellphoneS.com.vn/a.html", "cellphones"), (None, None, "unknown"), ("Chợ Lạ", "https://tiki.vn", "chợ lạ"),
]


@query(f"SELECT * FROM {values(NAMED_PLATFORMS, 'platform, url, normal')}")
def platform_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = given(spark, NAMED_PLATFORMS, "platform string, url string, want string")
    return rows.select("platform", "url", platforms.normalized(F.col("platform"), F.col("url")).alias("normal"))


ALIASED = [(1, "Điện Máy Xanh"), (2, "dienmayxanh"), (3, "Thế Giới Di Động"), (4, "Tiki"), (5, None), (6, "dien may xanh")]


@query(f"SELECT id, platform FROM {values(ALIASED, 'id, platform')} WHERE lower(platform) IN ('điện máy xanh', 'dienmayxanh', 'tiki')")
def platform_filter_aliases(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, ALIASED, "id int, platform string").where(filters.on_platforms(F.col("platform"), ["DienMayXanh", "TIKI"]))


SLUGGED = [("dien-thoai", "lazada", "dien-thoai-di-dong"), ("dong-ho", "cellphones", "do-choi-cong-nghe/dong-ho-thong-minh"), ("tablet", "tiki", "1789"), ("may-giat", "shopee", "may-giat"), ("x", "other", "x"), ("tivi", None, "tivi")]


@query(f"SELECT * FROM {values(SLUGGED, 'slug, source, own')}")
def source_slugs(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, SLUGGED, "slug string, source string, want string").select("slug", "source", platforms.source_slug(F.col("slug"), F.col("source")).alias("own"))


CATEGORY_PAGES = [
    ("cellphones", '<script>{"currentCategoryId": "3", "categoryId": 9}</script>', "3"), ("cellphones", '{"categoryId":12}', "12"), ("cellphones", '{\\"category_id\\":\\"7\\"}', "7"), ("cellphones", "<p>", None),
    ("dienmayxanh", "<script>var cateID = 42;</script>", "42"), ("dienmayxanh", "<input type='hidden' id='hdCateId' value='1942'/>", "1942"), ("dienmayxanh", '<input value="5" id="hdCateId">', "5"),
    ("thegioididong", '<ul class="listproduct __cate_522 x">', "522"), ("thegioididong", "<script>cateID = 0</script>", None),
]


@query(f"SELECT * FROM {values(CATEGORY_PAGES, 'source, html, category')}")
def category_ids(spark: SparkSession, d: str) -> DataFrame:
    own = F.lit(None).cast("string")
    for source in landed.CATEGORY_IDS:
        own = F.when(F.col("source") == source, landed.category_id(F.col("html"), source)).otherwise(own)
    return given(spark, CATEGORY_PAGES, "source string, html string, want string").select("source", "html", own.alias("category"))


@query("SELECT crawl_id, url_encode(category) AS encoded, regexp_replace('/' || category || '//', '^/+|/+$', '', 'g') AS trimmed FROM crawled_products".replace("url_encode(category)", "replace(replace(replace(replace(replace(url_encode(category), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"))
def uri_parts(spark: SparkSession, d: str) -> DataFrame:
    """Categories as a part of an address, and slugs without slashes at their ends."""
    slug = F.concat(F.lit("/"), "category", F.lit("//"))
    return table(spark, d, "crawled_products").select("crawl_id", parse.uri_component(F.col("category")).alias("encoded"), parse.trimmed_slug(slug).alias("trimmed"))


# Fixed value of the SQL: the shops' product pages.
PAGES = {"tiki": r"/p[0-9]+\.html|tiki\.vn/[^/]+-p[0-9]+", "lazada": r"/products/.*-i[0-9]+|lazada\.vn/.*\.html", "dienmayxanh": r"dienmayxanh\.com/[^/]+$|/[a-z0-9-]+-[0-9]+$", "cellphones": r"cellphones\.com\.vn/[^/]+\.html$", "other": ".*"}


@query("SELECT crawl_id, " + ", ".join(f"regexp_matches(url, '{p}') AS {n}" for n, p in PAGES.items()) + " FROM (SELECT crawl_id, CASE crawl_id % 3 WHEN 0 THEN external_url WHEN 1 THEN 'https://tiki.vn/a-p' || crawl_id ELSE 'https://cellphones.com.vn/b-' || crawl_id END AS url FROM crawled_products)")
def product_pages(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("crawl_id") % 3 == 0, F.col("external_url")).when(F.col("crawl_id") % 3 == 1, F.concat(F.lit("https://tiki.vn/a-p"), "crawl_id")).otherwise(F.concat(F.lit("https://cellphones.com.vn/b-"), "crawl_id"))
    return table(spark, d, "crawled_products").select("crawl_id", *(platforms.product_pages(url, n).alias(n) for n in PAGES))


@query("SELECT record_id, price * 1000000 AS millions, 'passage: ' || name AS passage FROM landed_products")
def display_inputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "landed_products").select("record_id", display.millions(F.col("price")).alias("millions"), text.prefixed(F.col("name")).alias("passage"))


@query("SELECT record_id, CAST(epoch_us(crawled_at) - 5400000000 AS BIGINT) AS before_us, (CAST(epoch_us(TIMESTAMP '2026-01-01') AS BIGINT) - epoch_us(crawled_at)) / 1000.0 AS age_ms FROM landed_products")
def time_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2026-01-01 00:00:00").cast("timestamp")
    at = F.col("crawled_at").cast("timestamp")
    return table(spark, d, "landed_products").select("record_id", F.unix_micros(parse.hours_before(at, 1.5)).alias("before_us"), parse.millis_between(at, end).alias("age_ms"))


# --- words ----------------------------------------------------------------------------------------

PAIRS = f"""
  docs AS {NAMED}, e AS (SELECT doc_id, i, tokens[i] AS a, tokens[i + 1] AS b FROM docs, unnest(generate_series(1, len(tokens))) AS t(i)),
  n AS (SELECT a, b, count(*) AS n FROM e WHERE regexp_full_match(a, '\\p{{L}}+') AND regexp_full_match(b, '\\p{{L}}+') GROUP BY 1, 2),
  l AS (SELECT a, sum(n) AS n_a FROM n GROUP BY 1), r AS (SELECT b, sum(n) AS n_b FROM n GROUP BY 1), s AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM n),
  pairs AS (SELECT * FROM (SELECT a, b, n, round(ln(n * total / (n_a * n_b)) / ln(total / n), 6) AS npmi FROM n JOIN l USING (a) JOIN r USING (b), s WHERE n >= {segmentation.LEAST}) WHERE npmi >= {segmentation.BOUND})"""


def names_tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus(table(spark, d, "product_items"), "id", "name_normalized")


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def compounds(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of syllables that are one word, learned from the names."""
    return segmentation.compounds(names_tokens(spark, d))


@query(f"WITH {PAIRS} SELECT doc_id, coalesce(trim(string_agg(e.a || CASE WHEN npmi IS NULL THEN ' ' ELSE '_' END, '' ORDER BY i)), '') AS words FROM docs LEFT JOIN e USING (doc_id) LEFT JOIN pairs ON e.a = pairs.a AND e.b = pairs.b GROUP BY doc_id")
def segmented_names(spark: SparkSession, d: str) -> DataFrame:
    docs = names_tokens(spark, d)
    return segmentation.segmented(docs, segmentation.compounds(docs)).select("doc_id", F.array_join("tokens", " ").alias("words"))


# --- files ----------------------------------------------------------------------------------------


@query("SELECT 2 * count(*) + (SELECT count(*) FROM brands) AS total, count(*) FILTER (price IS NULL AND coalesce(name, image_url, external_url) IS NOT NULL) AS missing_price FROM landed_products")
def quality_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quality of raw lines: unreadable ones count as lines without values, blank ones do not count."""
    path = scratch(spark, "raw")
    rows = table(spark, d, "landed_products").select(F.explode(F.array(F.to_json(F.struct("name", "price", "image_url", "external_url")), F.lit('{"name": '), F.lit("  "))).alias("value"))
    rows.unionByName(table(spark, d, "brands").select(F.lit("not json").alias("value"))).write.text(path)
    return quality.report_of_lines(landed.lines(spark, path), "name string, price double, image_url string, external_url string").select("total", "missing_price")


@query(
    """WITH fresh AS (SELECT * FROM landed_products WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY record_id) = 1)
    SELECT source_id, external_id, price FROM fresh UNION ALL
    SELECT coalesce(source_id, 0) + 1000, external_id, price FROM fresh WHERE source_id IS NOT NULL AND external_id IS NOT NULL"""
)
def append_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended as JSON lines; the second one holds the first again and the same rows of other sources."""
    path = scratch(spark, "appended")
    rows = table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "price")
    known = rows.limit(0)
    landed.append_new(rows, known, path, order="record_id")
    other = rows.where("source_id is not null and external_id is not null").withColumn("source_id", F.col("source_id") + 1000)
    landed.append_new(rows.unionByName(other), spark.read.schema(rows.schema).json(path), path, order="record_id")
    return spark.read.schema(rows.schema).json(path).select("source_id", "external_id", "price")


@query("SELECT CAST(count(*) AS BIGINT) AS total_products, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS total_errors FROM landed_products WHERE source_id IN (1, 2, 3)")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a run per source, written as a JSON file, and their totals over three sources."""
    path = scratch(spark, "report")
    runs = table(spark, d, "landed_products").groupBy(F.col("source_id").cast("string").alias("source")).agg(F.count("*").alias("products"), F.count_if(F.col("price").isNull()).alias("errors"))
    landed.run_report(runs, path)
    return stats.run_totals(spark.read.schema("source string, products long, errors long").json(path), ["1", "2", "3"])


@query("SELECT DISTINCT trim(external_url) AS loc FROM crawled_products WHERE trim(external_url) <> ''")
def sitemap_traversal(spark: SparkSession, d: str) -> DataFrame:
    """An index of sitemaps and the sitemaps it names, read as XML files."""
    path = scratch(spark, "sitemaps")
    entry = F.concat(F.lit("<url><loc> "), F.replace(F.replace(F.col("external_url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc><priority>0.5</priority></url>"))
    sets = table(spark, d, "crawled_products").where("external_url is not null").groupBy(F.expr("crawl_id div 20000").alias("part"))  # a sitemap holds 50,000 addresses at most
    sets.agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("value")).write.partitionBy("part").text(path + "/sets")
    parts = [r["part"] for r in spark.read.text(path + "/sets").select("part").distinct().collect()]
    index_ = "".join(f"<sitemap><loc>{path}/sets/part={n}</loc></sitemap>" for n in parts)
    given(spark, [(f"<sitemapindex>{index_}</sitemapindex>",)], "value string").coalesce(1).write.text(path + "/index")
    named = [r["loc"] for r in landed.sitemap_index(spark, path + "/index").collect()]  # as many as an index names
    return landed.distinct_urls(*(landed.sitemap_urls(spark, p) for p in named))


def toy_encoder(texts: list[str]) -> np.ndarray:
    """Letter counts as vectors, for want of a model."""
    return np.array([[t.count(c) for c in "aeiou"] for t in texts], np.float32)


@query("SELECT CAST(id AS BIGINT) AS doc_id, name_normalized AS name, 5 AS dimensions FROM product_items WHERE name_normalized <> ''")
def vector_collection(spark: SparkSession, d: str) -> DataFrame:
    """The names encoded into a new collection, an earlier one dropped."""
    path = scratch(spark, "vectors")
    vectors.create(spark, path)
    out = vectors.build(table(spark, d, "product_items"), path, "id", "name_normalized", toy_encoder)
    return out.select("doc_id", "name", F.size("embedding").alias("dimensions"))


@query("SELECT CAST(id AS BIGINT) AS doc_id, name_normalized AS name FROM product_items WHERE name_normalized <> '' ORDER BY 1 LIMIT 500")
def vector_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first rows with a text, as many as are asked for."""
    return vectors.scanned(table(spark, d, "product_items"), "id", "name_normalized", 500)


@query("SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN -round(CAST(embedding[1] AS DOUBLE), 6) ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings UNION ALL SELECT vec_id + 10000000, round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE vec_id % 5 = 0")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A third of the vectors replaced by their opposites, some added."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), "embedding")
    turned = own.where("doc_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = own.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    out = vectors.upserted(own, turned.unionByName(added))
    return out.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT DISTINCT CAST(vec_id AS BIGINT) AS doc_id FROM embeddings")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"))
    return vectors.ids(own.unionByName(own))


@query("SELECT CAST(0 AS BIGINT) AS n_before, count(*) AS n_after, FALSE AS there FROM embeddings")
def vector_create_drop(spark: SparkSession, d: str) -> DataFrame:
    """A collection that is made, filled, found there by a second call, and dropped."""
    path = scratch(spark, "collection")
    before = vectors.create(spark, path).count()
    table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"), F.lit("x").alias("name"), "embedding").write.mode("append").parquet(path)
    after = vectors.create(spark, path).count()
    vectors.drop(spark, path)
    return given(spark, [(before, after, vectors.exists(spark, path))], "n_before long, n_after long, there boolean")


@query("SELECT 'brands' AS name UNION ALL SELECT 'sources'")
def list_tables(spark: SparkSession, d: str) -> DataFrame:
    names = ["brands", "sources"]
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"__listed_{n}")
    found = [n.removeprefix("__listed_") for n in Engine(table(spark, d, "product_items")).tables() if n.startswith("__listed_")]
    for n in names:
        spark.catalog.dropTempView(f"__listed_{n}")
    return given(spark, [(n,) for n in found], "name string")


# --- catalogue ------------------------------------------------------------------------------------


@query("SELECT id, name FROM product_items WHERE coalesce(name, '') <> '' AND coalesce(image_url, '') <> ''")
def shown_items(spark: SparkSession, d: str) -> DataFrame:
    return filters.named_with_image(table(spark, d, "product_items")).select("id", "name")


RESULTS = "(SELECT CAST(id AS BIGINT) AS doc_id, 1.0 / CAST(id AS BIGINT) AS score, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' END AS name, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 5.0 ELSE 0.0 END AS price FROM product_items)"


def some_results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("long")
    name = F.when(i % 3 == 0, "own").when(i % 3 == 1, "")
    return table(spark, d, "product_items").select(i.alias("doc_id"), (1.0 / i).alias("score"), name.alias("name"), F.when(i % 2 == 0, 5.0).otherwise(0.0).alias("price"))


@query(f"SELECT r.doc_id, coalesce(nullif(r.name, ''), nullif(p.name, '')) AS name, coalesce(nullif(r.price, 0), p.price) AS price FROM {RESULTS} r LEFT JOIN (SELECT record_id AS doc_id, name, price FROM landed_products WHERE record_id % 7 > 0) p USING (doc_id)")
def display_overrides(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "landed_products").where("record_id % 7 > 0").select(F.col("record_id").alias("doc_id"), "name", "price")
    return catalog.overridden(some_results(spark, d), products).select("doc_id", "name", "price")


@query(f"SELECT r.doc_id, CASE WHEN p.doc_id IS NULL THEN 'Unknown (DB lookup failed)' ELSE p.name END AS name, CASE WHEN p.doc_id IS NULL THEN 'N/A' ELSE CAST(CAST(p.price AS DECIMAL(20, 2)) AS VARCHAR) END AS shown_price FROM {RESULTS} r LEFT JOIN (SELECT record_id AS doc_id, name, price FROM landed_products WHERE record_id % 7 > 0) p USING (doc_id)")
def console_placeholders(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "landed_products").where("record_id % 7 > 0").select(F.col("record_id").alias("doc_id"), "name", "price")
    return catalog.with_placeholder(some_results(spark, d).select("doc_id"), products)


@query("SELECT platform, id, CAST(row_number() OVER (PARTITION BY platform ORDER BY price DESC NULLS LAST, CAST(id AS BIGINT)) AS INT) AS number FROM product_items")
def numbered_results(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("price").desc_nulls_last(), F.col("id").cast("long")]
    return catalog.numbered(table(spark, d, "product_items").select("platform", "id", "price"), order, ["platform"]).drop("price")


@query(f"WITH {BM25} SELECT t.rank, t.doc_id, p.name, p.price FROM (SELECT *, {TOP} AS rank FROM text_scores WHERE query_id = 50) t JOIN (SELECT CAST(id AS BIGINT) AS doc_id, name, price FROM product_items) p USING (doc_id) WHERE rank <= 50")
def search_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The search of an address's parameters, joined with its products."""
    return Engine(table(spark, d, "product_items")).find({"query": "Nồi cơm điện", "method": "bm25", "limit": "50"}).select("rank", "doc_id", "name", "price")


@query("SELECT CAST(id AS BIGINT) AS doc_id, name FROM product_items WHERE contains(lower(name), 'nồi cơm') AND (price IS NULL OR price <= 900000) ORDER BY 1 LIMIT 30")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid search without vectors falls back to names that hold the text."""
    return Engine(table(spark, d, "product_items")).find({"query": "nồi cơm", "method": "hybrid", "limit": "30", "max_price": "900000"}).select("doc_id", "name")


# --- crawl state ----------------------------------------------------------------------------------

KEYWORDS = [
    ("tivi", "tv", True, ["all"], 2, None), ("nồi", "kitchen", True, ["tiki", "lazada"], 1, "2025-01-01 00:00:00"), ("quạt", "home", None, ["tiki"], 1, "2025-01-09 12:00:00"), ("loa", "tv", True, ["lazada"], 1, None),
    ("máy", "tv", False, ["all"], 0, None), ("đèn", "home", True, None, 0, None), ("bàn", "home", True, [], 0, None),
]


def keyword_table(spark: SparkSession) -> DataFrame:
    rows = given(spark, KEYWORDS, "keyword string, category string, is_active boolean, applies_to array<string>, priority int, last string")
    return rows.withColumn("last_crawled_at", F.col("last").cast("timestamp"))


@query("SELECT * FROM (VALUES (1, 'nồi'), (2, 'tivi')) AS v(number, keyword)")
def keyword_scan(spark: SparkSession, d: str) -> DataFrame:
    """Active stale keywords of a source, numbered in their order."""
    out = landed.keywords(keyword_table(spark), "tiki", F.lit("2025-01-10 00:00:00").cast("timestamp"), hours=24)
    return catalog.numbered(out, [F.col("priority"), F.col("keyword")], limit=100).select("number", "keyword")


@query("SELECT * FROM (VALUES ('tivi', TRUE, TRUE), ('nồi', TRUE, TRUE), ('quạt', TRUE, TRUE), ('loa', FALSE, TRUE), ('máy', TRUE, TRUE), ('đèn', FALSE, TRUE), ('bàn', FALSE, TRUE)) AS v(keyword, tiki, every)")
def keyword_targets(spark: SparkSession, d: str) -> DataFrame:
    return keyword_table(spark).select("keyword", filters.applies_to(F.col("applies_to"), "tiki").alias("tiki"), filters.applies_to(F.col("applies_to"), "all").alias("every"))


@query("SELECT id, CASE WHEN type = 'html' THEN CAST(1767225600000000 AS BIGINT) ELSE epoch_us(last_crawled_at) END AS crawled_us FROM sources")
def marked_crawled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").withColumn("last_crawled_at", F.col("last_crawled_at").cast("timestamp"))
    out = upsert.marked(rows, F.col("type") == "html", "last_crawled_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select("id", F.unix_micros("last_crawled_at").alias("crawled_us"))


@query(
    """SELECT s.id, CASE WHEN s.id % 2 = 1 THEN 'running' WHEN coalesce(n, 0) = 0 THEN 'failed' WHEN e > 0 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN s.id % 2 = 0 THEN coalesce(n, 0) END AS total_items, s.id % 2 = 0 AS ended
    FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (price IS NULL) AS e FROM landed_products GROUP BY 1) c ON c.source_id = s.id"""
)
def crawl_log(spark: SparkSession, d: str) -> DataFrame:
    """A run opened for every source and closed for those with an even id, with its figures and status."""
    runs = table(spark, d, "sources").select(F.col("id").cast("long").alias("id"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("keyword"), F.col("id").cast("string").alias("category_id"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    counts = table(spark, d, "landed_products").groupBy(F.col("source_id").cast("long").alias("id")).agg(F.count("*").alias("total_items"), F.count_if(F.col("price").isNull()).alias("errors"))
    counts = runs.where("id % 2 = 0").select("id").join(counts, "id", "left").select("id", F.coalesce("total_items", F.lit(0)).alias("total_items"), F.lit(0).cast("long").alias("new_items"), F.lit(0).cast("long").alias("updated_items"), F.coalesce("errors", F.lit(0)).alias("errors"))
    out = crawl_state.closed(crawl_state.opened(runs, now), counts, now)
    return out.select(F.col("id").cast("int").alias("id"), "status", "total_items", F.col("ended_at").isNotNull().alias("ended"))


@query("SELECT * FROM (VALUES (5, 0, 'completed'), (5, 1, 'partial'), (0, 0, 'failed'), (0, 3, 'failed')) AS v(total, errors, status)")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    rows = given(spark, [(5, 0), (5, 1), (0, 0), (0, 3)], "total int, errors int")
    return rows.select("total", "errors", crawl_state.run_status(F.col("total"), F.col("errors")).alias("status"))


@query("SELECT * FROM (VALUES ('a', 'c1', 'a', 'keyword'), ('', 'c1', 'c1', 'category'), (NULL, 'c1', 'c1', 'category'), (NULL, NULL, 'general', 'category')) AS v(keyword, category_id, item, kind)")
def item_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = given(spark, [("a", "c1"), ("", "c1"), (None, "c1"), (None, None)], "keyword string, category_id string")
    return rows.select("keyword", "category_id", crawl_state.item_key(F.col("keyword"), F.col("category_id")).alias("item"), crawl_state.item_type(F.col("keyword")).alias("kind"))


@query(f"SELECT item, CAST(row_number() OVER (ORDER BY ended_at NULLS FIRST, item) AS INT) AS number FROM (SELECT * FROM {LOGS} QUALIFY row_number() OVER (PARTITION BY item ORDER BY started_at DESC, id DESC) = 1) ORDER BY 2 LIMIT 100")
def pending_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred items to crawl: never crawled ones, then the oldest."""
    rows, _ = logs(spark, d)
    return catalog.numbered(crawl_state.progress(rows, ["item"]), [*crawl_state.pending_order(), F.col("item")], limit=100).select("item", "number")


# --- trees and the index on disk ------------------------------------------------------------------


@query("SELECT CAST(id AS VARCHAR) AS id, CAST(parent_id AS VARCHAR) AS parent_id FROM categories")
def nested_categories(spark: SparkSession, d: str) -> DataFrame:
    """Top categories with their children inside, taken apart again."""
    rows = table(spark, d, "categories")
    node = lambda *more: F.struct("id", "name", "slug", "level", *more)
    inner = rows.where("parent_id is not null").groupBy("parent_id").agg(F.collect_list(node()).alias("children"))
    top = rows.where("parent_id is null").join(inner.withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left").select("id", "name", "slug", "level", "children")
    return tree.with_fallback(top, "none").select("id", "parent_id")


@query("SELECT * FROM (VALUES ('lazada', CAST(20 AS BIGINT)), ('dienmayxanh', CAST(29 AS BIGINT)), ('cellphones', CAST(10 AS BIGINT)), ('other', CAST(0 AS BIGINT))) AS v(source, n)")
def static_categories(spark: SparkSession, d: str) -> DataFrame:
    """The fixed categories of sources that answered with none."""
    none = given(spark, [], "id string, name string, slug string, level int")
    return given(spark, [(s, tree.with_fallback(none, s).count()) for s in ("lazada", "dienmayxanh", "cellphones", "other")], "source string, n long")


@query(f"SELECT count(DISTINCT term) AS n_terms, CAST(0 AS BIGINT) AS n_out_of_order, CAST(0 AS BIGINT) AS n_overlaps FROM (SELECT unnest(tokens) AS term FROM {NAMED})")
def index_order(spark: SparkSession, d: str) -> DataFrame:
    """The terms of an index on disk: in code-point order within its files, whose ranges of terms do not overlap but at one term."""
    path = scratch(spark, "ordered-index")
    index.write(index.build(names_tokens(spark, d)), path)
    rows = index.read(spark, path).postings.select("term", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    after = rows.select("file", (F.col("row") - 1).alias("row"), F.col("term").alias("next"))
    wrong = rows.join(after, ["file", "row"]).agg(F.count_if(F.col("next") < F.col("term")).alias("n"))
    spans = rows.groupBy("file").agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("low", "high").collect()  # a row per file
    overlaps = sum(b["low"] < a["high"] for a, b in zip(spans, spans[1:]))
    out = rows.agg(F.countDistinct("term")).first()[0], wrong.first()[0], overlaps
    return given(spark, [out], "n_terms long, n_out_of_order long, n_overlaps long")
