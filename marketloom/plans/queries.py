"""The queries of the core, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import display, parse, text
from marketloom.operators import catalog, crawl_state, evaluation, filters, index, platforms, quality, ranking, skewed_keys, stats, tree, unit_conversion, upsert
from marketloom.plans.registry import oracle_sql, queries, query  # noqa: F401
from marketloom.session import reliable_dir, scratch, table
from marketloom.sources import landed
from marketloom.streaming import ingest


@query(
    """
    SELECT source_id, external_id, epoch_us(crawled_at) AS crawled_us, record_id, price FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY crawled_at DESC NULLS LAST, record_id DESC) AS rn FROM landed_products
    ) WHERE rn = 1
    """
)
def p3_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "crawled_at", "price")
    out = skewed_keys.latest(rows, ["source_id", "external_id"], "record_id", "crawled_at", ["price"])
    return out.select("source_id", "external_id", F.unix_micros("crawled_at").alias("crawled_us"), "record_id", "price")


@query(
    """
    SELECT source_id, count(*) AS n_rows, count(p) AS n_prices, min(p) AS min_price, max(p) AS max_price,
           CAST(sum(CAST(p AS DECIMAL(20, 2))) AS DOUBLE) AS sum_price, CAST(sum(CAST(p AS DECIMAL(20, 2))) AS DOUBLE) / nullif(count(p), 0) AS avg_price
    FROM (SELECT source_id, CASE WHEN price > 0 AND NOT isnan(price) THEN price END AS p FROM landed_products) GROUP BY source_id
    """
)
def p3_price_stats(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.price_stats(table(spark, d, "landed_products").select("record_id", "source_id", "price"))


@query(
    """
    SELECT source_id, CAST(count(external_id) AS BIGINT) AS n_items, max(CASE WHEN external_id IS NOT NULL THEN n END) AS most_rows
    FROM (SELECT source_id, external_id, count(*) AS n FROM landed_products GROUP BY 1, 2) GROUP BY source_id
    """
)
def p3_distinct_items(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.distinct_items(table(spark, d, "landed_products").select("record_id", "source_id", "external_id"))


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_conversion.found(table(spark, d, "crawled_products"))


@query()
def p4_flagged(spark: SparkSession, d: str) -> DataFrame:
    return unit_conversion.flagged(table(spark, d, "crawled_products"))


@query()
def p4_inferred(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture makes of all specifications without their units, beside what they state."""
    out = unit_conversion.inferred(table(spark, d, "crawled_products"))
    return out.withColumn("right", F.abs(F.col("amount") - F.col("stated")) <= 0.01 * F.col("stated"))


# --- index and ranking --------------------------------------------------------------------------

SEARCHES = {50: "nồi cơm điện", 100: "điện thoại 128gb đen", 150: "máy hút bụi bụi", 200: "kettle xyzzy", 250: "xyzzy"}
NAMED = "(SELECT CAST(id AS BIGINT) AS doc_id, list_filter(regexp_split_to_array(name_normalized, '[\\t\\n\\x0B\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+'), lambda t: t <> '') AS tokens FROM product_items WHERE name_normalized IS NOT NULL AND name_normalized <> '')"
POSTS = f"(SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM {NAMED}) GROUP BY 1, 2)"
ASKED = "(SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(string_split(q, ' ')) AS term FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in SEARCHES.items()) + ") AS v(query_id, q)) GROUP BY 1, 2)"
BM25 = f"""
  docs AS {NAMED}, posts AS {POSTS}, asked AS {ASKED},
  st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
  df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
  text_scores AS (
    SELECT query_id, doc_id, sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))) AS score
    FROM posts JOIN asked USING (term) JOIN df USING (term) JOIN docs USING (doc_id), st GROUP BY 1, 2)"""
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"
VECTOR = """
  probes AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
  vector_scores AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, probes)"""
FUSED = f"""
  v AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM (SELECT *, {TOP} AS rn FROM vector_scores WHERE query_id IN (50, 100, 150, 200, 250)) WHERE rn <= 20),
  t AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM (SELECT *, {TOP} AS rn FROM text_scores) WHERE rn <= 20),
  vs AS (SELECT query_id, doc_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM v),
  ts AS (SELECT query_id, doc_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM t),
  fused AS (SELECT coalesce(vs.query_id, ts.query_id) AS query_id, coalesce(vs.doc_id, ts.doc_id) AS doc_id, 0.5 * coalesce(vs.s, 0) + 0.5 * coalesce(ts.s, 0) AS score
            FROM vs FULL JOIN ts ON vs.query_id = ts.query_id AND vs.doc_id = ts.doc_id)"""


def names_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the product names, made of them here."""
    return index.build(index.corpus(table(spark, d, "product_items"), "id", "name_normalized"))


def stored_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the product names on disk, written once for a table as it is."""
    path = f"{reliable_dir(spark)}/names-index-{index.digest(spark, f'{d}/product_items.parquet')}"
    return index.persisted(spark, path, lambda: names_index(spark, d))


def searched(spark: SparkSession, d: str, of: list[int] | None = None) -> DataFrame:
    """The scores of some or all searches, from the postings of their terms on disk."""
    asked = {q: t for q, t in SEARCHES.items() if of is None or q in of}
    return ranking.bm25_scores(stored_index(spark, d), ranking.query_rows(asked))


def probed(spark: SparkSession, d: str, k: int, of: list[int] | None = None) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50, or of some vectors."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.where("doc_id % 50 = 0") if of is None else vectors.where(F.col("doc_id").isin(of))
    return ranking.nearest(vectors, asked.withColumnRenamed("doc_id", "query_id"), k)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM text_scores WHERE query_id = 50) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.top(searched(spark, d, [50]), 10)).drop("query_id")


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM text_scores) WHERE rank <= 10")
def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.top(searched(spark, d), 10))


@query(f"WITH {VECTOR} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM vector_scores) WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probed(spark, d, 10))


@query(f"WITH {BM25}, {VECTOR}, {FUSED} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM fused) WHERE rank <= 10")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.fused(probed(spark, d, 20, list(SEARCHES)), ranking.top(searched(spark, d), 20), 10))


CHEAP = "price <= 500000"
PRICED = "(SELECT CAST(id AS BIGINT) AS doc_id FROM product_items WHERE price <= 500000)"


def priced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").select(F.col("id").cast("long").alias("doc_id"), "price")


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM text_scores WHERE doc_id IN {PRICED}) WHERE rank <= 10")
def search_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.filtered_top(searched(spark, d), priced(spark, d), F.expr(CHEAP), 10, "pre"))


@query(
    f"WITH {BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, {TOP} AS rank FROM (SELECT *, {TOP} AS rn FROM text_scores) WHERE rn <= 200 AND doc_id IN {PRICED}) WHERE rank <= 10"
)
def search_postfilter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.filtered_top(searched(spark, d), priced(spark, d), F.expr(CHEAP), 10, "post"))


# The same searches with every product whose id is divisible by 50 as a query, against all products.
ITEMS_ASKED = f"(SELECT query_id, term, count(*) AS weight FROM (SELECT doc_id AS query_id, unnest(tokens) AS term FROM {NAMED} WHERE doc_id % 50 = 0) GROUP BY 1, 2)"
ITEMS_BM25 = BM25.replace(ASKED, ITEMS_ASKED)
ITEMS_FUSED = FUSED.replace(" WHERE query_id IN (50, 100, 150, 200, 250)", "")


def items_searched(spark: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    docs = index.corpus(table(spark, d, "product_items"), "id", "name_normalized")
    return ranking.bm25_many(docs, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), k, among)


@query(f"WITH {ITEMS_BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM text_scores) WHERE rank <= 10")
def bm25_all_queries(spark: SparkSession, d: str) -> DataFrame:
    return rounded(items_searched(spark, d, 10))


@query(f"WITH {ITEMS_BM25}, {VECTOR}, {ITEMS_FUSED} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM fused) WHERE rank <= 10")
def hybrid_all_queries(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.fused(probed(spark, d, 20), items_searched(spark, d, 20), 10))


@query(f"WITH {ITEMS_BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, {TOP} AS rank FROM text_scores WHERE doc_id IN {PRICED}) WHERE rank <= 10")
def prefilter_all_queries(spark: SparkSession, d: str) -> DataFrame:
    return rounded(items_searched(spark, d, 10, priced(spark, d).where(CHEAP)))


@query(
    f"WITH {ITEMS_BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, {TOP} AS rank FROM (SELECT *, {TOP} AS rn FROM text_scores) WHERE rn <= 200 AND doc_id IN {PRICED}) WHERE rank <= 10"
)
def postfilter_all_queries(spark: SparkSession, d: str) -> DataFrame:
    deep = items_searched(spark, d, ranking.fetch_depth(10, True))
    return rounded(ranking.filtered_top(deep.drop("rank"), priced(spark, d), F.expr(CHEAP), 10, "post"))


@query(f"SELECT * FROM {POSTS}")
def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return names_index(spark, d).postings.drop("dl")


@query(f"WITH posts AS {POSTS}, st AS (SELECT count(*) AS n FROM {NAMED}) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM posts, st GROUP BY term")
def term_df_idf(spark: SparkSession, d: str) -> DataFrame:
    own = names_index(spark, d)
    n = F.lit(own.stats.first()["n_docs"])
    return index.frequencies(own.postings).select("term", "df", F.round(ranking.idf(n, F.col("df")), 6).alias("idf"))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS total_length, round(avg(len(tokens)), 9) AS avgdl FROM {NAMED}")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return names_index(spark, d).stats.withColumn("avgdl", F.round("avgdl", 9))


@query(f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS dl FROM {NAMED}")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return names_index(spark, d).lengths


@query(f"SELECT doc_id, tf FROM {POSTS} WHERE term = 'điện'")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A term's postings from an index on disk."""
    return index.lookup(stored_index(spark, d), "điện")


@query(f"SELECT term, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM {POSTS} GROUP BY 1, 2")
def index_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of a corpus indexed apart and merged."""
    items = table(spark, d, "product_items")
    parts = [index.postings(index.corpus(items.where(c), "id", "name_normalized")) for c in ("platform < 'm'", "platform >= 'm' or platform is null")]
    return index.merged(*parts)


# --- products, sources and statistics -----------------------------------------------------------


@query("SELECT id, price, platform FROM product_items WHERE lower(platform) IN ('góc trăng non', 'sàn hàng me') AND price >= 100000 AND price <= 2000000")
def platform_price_filter(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "product_items")
    keep = filters.on_platforms(F.col("platform"), ["Góc Trăng Non", "sàn hàng me"]) & filters.price_between(F.col("price"), 100_000, 2_000_000)
    return items.where(keep).select("id", "price", "platform")


@query("SELECT CAST(id AS BIGINT) AS doc_id, name FROM product_items WHERE contains(lower(name), 'tivi') AND (price IS NULL OR (price >= 1000000 AND price <= 9000000)) ORDER BY 1 LIMIT 20")
def substring_fallback(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "product_items").withColumn("doc_id", F.col("id").cast("long"))
    return filters.substring_search(items, "Tivi", "name", "doc_id", 20, "price", 1e6, 9e6).select("doc_id", "name")


@query("SELECT p.record_id, p.name, p.price, s.name AS platform FROM (SELECT * FROM landed_products ORDER BY record_id DESC LIMIT 50) p LEFT JOIN sources s ON p.source_id = s.id")
def latest_products(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.latest(table(spark, d, "landed_products").select("record_id", "name", "price", "source_id"), table(spark, d, "sources"), 50, "record_id")
    return out.select("record_id", "name", "price", "platform")


@query("SELECT p.record_id, p.name, p.price, s.name AS platform FROM landed_products p LEFT JOIN sources s ON p.source_id = s.id WHERE record_id = 77")
def product_detail(spark: SparkSession, d: str) -> DataFrame:
    return catalog.detail(table(spark, d, "landed_products"), table(spark, d, "sources"), 77, "record_id").select("record_id", "name", "price", "platform")


@query("SELECT id, name FROM product_items WHERE CAST(id AS BIGINT) IN (3, 5, 7)")
def id_membership(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("3",), ("5",), ("x",), ("7",), ("5",), (None,)], "id string")
    return filters.with_ids(table(spark, d, "product_items"), ids).select("id", "name")


DISTRIBUTION = "(SELECT s.name, count(p.record_id) AS n FROM sources s LEFT JOIN landed_products p ON p.source_id = s.id GROUP BY s.name)"


@query(f"SELECT * FROM {DISTRIBUTION}")
def platform_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(spark, d, "landed_products"), table(spark, d, "sources"))


@query(f"SELECT (SELECT count(*) FROM landed_products) AS total_products, (SELECT count(*) FROM brands) AS total_brands, (SELECT coalesce(nullif(count(*) FILTER (n > 0), 0), count(*)) FROM {DISTRIBUTION}) AS active_platforms")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(table(spark, d, "landed_products"), table(spark, d, "brands"), table(spark, d, "sources"))


@query(f"SELECT name, n, round(100.0 * n / (SELECT sum(n) FROM {DISTRIBUTION}), 1) AS share FROM {DISTRIBUTION} WHERE n > 0")
def platform_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.shares(stats.distribution(table(spark, d, "landed_products"), table(spark, d, "sources")))


@query("SELECT coalesce(platform, 'unknown') AS platform, count(*) AS n FROM product_items GROUP BY 1")
def platform_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_platform(table(spark, d, "product_items"))


GROUP_KEY = "trim(substring(lower(coalesce(nullif(name_normalized, ''), nullif(name, ''))), 1, 50))"


@query(
    f"""
    WITH p AS (SELECT *, CAST(id AS BIGINT) AS seq, {GROUP_KEY} AS group_key FROM product_items),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY seq) AS f, row_number() OVER (PARTITION BY group_key ORDER BY (price > 0) IS TRUE DESC, CASE WHEN price > 0 THEN price END, CASE WHEN price > 0 THEN -seq ELSE seq END) AS b FROM p WHERE group_key <> '')
    SELECT group_key, max(name) FILTER (f = 1) AS canonical_name, coalesce(max(price) FILTER (b = 1), 0) AS best_price, max(platform) FILTER (b = 1) AS best_platform,
           round(nullif(avg(coalesce(rating, 0)), 0), 6) AS avg_rating, CAST(sum(coalesce(review_count, 0)) AS BIGINT) AS total_reviews, count(*) AS n_offers
    FROM r GROUP BY group_key
    """
)
def price_compare_groups(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.price_groups(table(spark, d, "product_items").withColumn("seq", F.col("id").cast("long")), "seq")
    return out.select("group_key", "canonical_name", "best_price", "best_platform", F.round("avg_rating", 6).alias("avg_rating"), "total_reviews", "n_offers")


@query(f"SELECT {GROUP_KEY} AS group_key, count(*) AS n_offers, CASE WHEN count(*) > 1 THEN max(coalesce(price, 0)) - min(coalesce(price, 0)) ELSE 0 END AS savings FROM product_items WHERE {GROUP_KEY} <> '' GROUP BY 1")
def price_savings(spark: SparkSession, d: str) -> DataFrame:
    return catalog.savings(table(spark, d, "product_items"))


@query(f"SELECT {GROUP_KEY} AS group_key, id, coalesce(price, 0) AS price, coalesce(external_url, '') AS url FROM product_items WHERE {GROUP_KEY} <> ''")
def price_offers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.price_offers(table(spark, d, "product_items").withColumn("seq", F.col("id").cast("long")), "seq").select("group_key", "id", "price", "url")


@query(
    f"""SELECT {GROUP_KEY} AS group_key, string_agg(id, ',' ORDER BY CAST(id AS BIGINT)) AS product_ids, string_agg(CAST(CAST(coalesce(price, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY coalesce(price, 0)) AS prices
    FROM (SELECT * FROM product_items ORDER BY CAST(id AS BIGINT) DESC LIMIT 50) WHERE {GROUP_KEY} <> '' GROUP BY 1"""
)
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of one page of 50 results."""
    page = table(spark, d, "product_items").withColumn("seq", F.col("id").cast("long")).orderBy(F.col("seq").desc()).limit(50)
    offers = catalog.offers_by_price(F.col("offers"))
    prices = F.array_join(F.transform(offers, lambda o: o["price"].cast("long").cast("string")), ",")
    return catalog.page_groups(page, "seq").select("group_key", F.array_join("product_ids", ",").alias("product_ids"), prices.alias("prices"))


@query(
    "SELECT id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS pictures FROM (SELECT id, list_filter(list_prepend(image_url, coalesce(images, [])), lambda x: x IS NOT NULL AND x <> '') AS l FROM product_items)"
)
def image_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").select("id", F.array_join(catalog.image_list(F.col("image_url"), F.col("images")), "|").alias("pictures"))


@query("SELECT CAST(id AS BIGINT) AS doc_id FROM product_items ORDER BY 1 LIMIT 25 OFFSET 50")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page(table(spark, d, "product_items").select(F.col("id").cast("long").alias("doc_id")), [F.col("doc_id")], 3, 25)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM product_items")
def page_figures(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "product_items").agg(F.count("*").alias("t")).select(catalog.page_figures(F.col("t"), 3, 25).alias("f"))
    return out.select("f.total", "f.pages")


@query(
    """
    SELECT r.record_id, coalesce(p.name, c.name) AS name FROM landed_products r
    LEFT JOIN (SELECT external_id, min(name) AS name FROM product_items GROUP BY 1) p USING (external_id) LEFT JOIN (SELECT external_id, min(name) AS name FROM crawled_products GROUP BY 1) c USING (external_id)
    """
)
def second_choice_enrichment(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "landed_products").select("record_id", "external_id")
    stores = [table(spark, d, t).groupBy("external_id").agg(F.min("name").alias("name")) for t in ("product_items", "crawled_products")]
    return catalog.enriched(results, *stores, key="external_id", columns=["name"]).select("record_id", "name")


FLAGS = """
    SELECT *, coalesce(trim(name) = '', true) AS missing_name, coalesce(trim(name) <> '', false) AND length(name) < 10 AS short_name, price IS NULL AS missing_price,
           price IS NOT NULL AND (price <= 0 OR price > 1000000000) AS invalid_price, NOT coalesce(starts_with(image_url, 'http'), false) AS missing_image, NOT coalesce(starts_with(external_url, 'http'), false) AS missing_url
    FROM landed_products"""
COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in quality.NAMES[:-1])
GOOD = "NOT (missing_name OR missing_price OR invalid_price OR missing_image OR missing_url)"
RATE = f"count(*) FILTER ({GOOD}) AS good, round(100.0 * count(*) FILTER ({GOOD}) / count(*), 2) AS good_rate"


@query(f"SELECT {COUNTS}, {RATE} FROM ({FLAGS})")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(table(spark, d, "landed_products"))


@query(f"SELECT source_id, {COUNTS}, {RATE} FROM ({FLAGS}) GROUP BY source_id")
def quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(table(spark, d, "landed_products"), "source_id")


@query("SELECT crawl_id, trim(external_id) AS external_id, substring(description, 1, 200) AS description, len(coalesce(images, [])[1:3]) AS n_images, coalesce(review_count, 0) AS review_count, coalesce(available, true) AS available FROM crawled_products WHERE trim(external_id) <> ''")
def cleaned_defaults(spark: SparkSession, d: str) -> DataFrame:
    out = filters.cleaned(table(spark, d, "crawled_products"))
    return out.select("crawl_id", "external_id", "description", F.size("images").cast("long").alias("n_images"), "review_count", "available")


# --- upserts and crawl state --------------------------------------------------------------------

def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The landed rows before and from the middle of their time."""
    rows = table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "price", "name", "crawled_at")
    low, high = rows.agg(F.min(F.unix_micros("crawled_at")), F.max(F.unix_micros("crawled_at"))).first()
    middle = F.lit((low + high) // 2)
    return rows.where(F.unix_micros("crawled_at") < middle), rows.where(F.unix_micros("crawled_at") >= middle)


SPLIT = "WITH m AS (SELECT (epoch_us(min(crawled_at)) + epoch_us(max(crawled_at))) // 2 AS cut_us FROM landed_products), early AS (SELECT l.* FROM landed_products l, m WHERE epoch_us(crawled_at) < cut_us), late AS (SELECT l.* FROM landed_products l, m WHERE epoch_us(crawled_at) >= cut_us)"
LAST = "QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY record_id DESC) = 1"


@query(f"SELECT record_id, source_id, external_id, price FROM landed_products {LAST}")
def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return upsert.last_wins(table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "price"), ["source_id", "external_id"], "record_id")


@query("SELECT record_id, source_id, external_id, price FROM landed_products QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY record_id) = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return upsert.first_wins(table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "price"), ["source_id", "external_id"], "record_id")


@query(
    f"""{SPLIT}, known AS (SELECT * FROM early {LAST}), fresh AS (SELECT * FROM late {LAST})
    SELECT record_id, source_id, external_id, price FROM fresh UNION ALL
    SELECT record_id, source_id, external_id, price FROM known k WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.source_id IS NOT DISTINCT FROM k.source_id AND f.external_id IS NOT DISTINCT FROM k.external_id)"""
)
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    early, late = halves(spark, d)
    keys = ["source_id", "external_id"]
    return upsert.upsert(upsert.last_wins(early, keys, "record_id"), late, keys, "record_id").select("record_id", *keys, "price")


@query(
    f"""{SPLIT}, known AS (SELECT * FROM early {LAST}), fresh AS (SELECT * FROM late {LAST})
    SELECT coalesce(k.source_id, f.source_id) AS source_id, coalesce(k.external_id, f.external_id) AS external_id, CASE WHEN f.record_id IS NULL THEN k.price ELSE f.price END AS price, coalesce(k.record_id, f.record_id) AS record_id
    FROM known k FULL JOIN fresh f ON k.source_id = f.source_id AND k.external_id = f.external_id"""
)
def upsert_price_only(spark: SparkSession, d: str) -> DataFrame:
    early, late = halves(spark, d)
    keys = ["source_id", "external_id"]
    out = upsert.update_columns(upsert.last_wins(early, keys, "record_id"), upsert.last_wins(late, keys, "record_id"), keys, ["price", "crawled_at"])
    return out.select(*keys, "price", "record_id")


@query(f"{SPLIT} SELECT count(*) FILTER (k.s IS NULL) AS inserted, count(*) FILTER (k.s IS NOT NULL) AS updated FROM (SELECT DISTINCT source_id, external_id FROM late) f LEFT JOIN (SELECT DISTINCT source_id AS s, external_id AS e FROM early) k ON f.source_id = k.s AND f.external_id = k.e")
def new_vs_existing_counts(spark: SparkSession, d: str) -> DataFrame:
    early, late = halves(spark, d)
    return upsert.upsert_counts(early, late, ["source_id", "external_id"])


@query(f"{SPLIT} SELECT record_id FROM late WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.source_id = late.source_id AND e.external_id = late.external_id) QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY record_id) = 1 UNION ALL SELECT record_id FROM early")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    early, late = halves(spark, d)
    return upsert.insert_ignore(early, late, ["source_id", "external_id"], "record_id").select("record_id")


@query(f"{SPLIT} SELECT record_id FROM late WHERE price > 0 AND NOT EXISTS (SELECT 1 FROM early e WHERE e.source_id = late.source_id AND e.external_id = late.external_id) QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY crawled_at, record_id) = 1")
def landed_anti(spark: SparkSession, d: str) -> DataFrame:
    early, late = halves(spark, d)
    keys = ["source_id", "external_id"]
    priced_ = late.where(filters.positive_price(F.col("price")))
    return upsert.one_per_key(upsert.new_rows(priced_, early, keys), keys, [F.col("crawled_at"), F.col("record_id")]).select("record_id")


LOGS = "(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS item, ts AS started_at, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'in_progress' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_type <> 'view' THEN ts END AS ended_at FROM events)"
NOW = "(SELECT max(ts) FROM events)"


def logs(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    """The event table as a crawl log, and its last time."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("new")
    out = e.select(F.col("event_id").alias("id"), crawl_state.item_key(F.col("user_id").cast("string"), F.lit(None)).alias("item"), F.col("ts").alias("started_at"), crawl_state.log_status(status).alias("status"), F.when(F.col("event_type") != "view", F.col("ts")).alias("ended_at"))
    return out, F.lit(e.agg(F.max("ts")).first()[0])


@query(f"SELECT item, id, status FROM {LOGS} QUALIFY row_number() OVER (PARTITION BY item ORDER BY started_at DESC, id DESC) = 1")
def latest_log_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = logs(spark, d)
    return crawl_state.progress(rows, ["item"]).select("item", "id", "status")


@query(
    f"""SELECT item, CASE WHEN status = 'in_progress' THEN 'in_progress' WHEN ended_at IS NULL OR ended_at < {NOW} - INTERVAL 24 HOUR THEN 'pending' ELSE 'recently_completed' END AS place
    FROM (SELECT * FROM {LOGS} QUALIFY row_number() OVER (PARTITION BY item ORDER BY started_at DESC, id DESC) = 1)"""
)
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    rows, now = logs(spark, d)
    return crawl_state.queue(crawl_state.progress(rows, ["item"]), now, 24).select("item", "place")


RECENT = f"(SELECT item FROM {LOGS} WHERE status = 'completed' AND ended_at >= {NOW} - INTERVAL 24 HOUR)"


@query(f"SELECT id, name FROM categories WHERE CAST(id AS VARCHAR) NOT IN {RECENT}")
def uncrawled_anti(spark: SparkSession, d: str) -> DataFrame:
    rows, now = logs(spark, d)
    return crawl_state.uncrawled(table(spark, d, "categories"), F.col("id"), crawl_state.recent(rows, now, 24), F.col("item")).select("id", "name")


@query(f"SELECT id, name FROM categories WHERE CAST(id AS VARCHAR) IN {RECENT}")
def should_skip_semi(spark: SparkSession, d: str) -> DataFrame:
    rows, now = logs(spark, d)
    return crawl_state.to_skip(table(spark, d, "categories"), F.col("id"), crawl_state.recent(rows, now, 24), F.col("item")).select("id", "name")


@query("SELECT lower(name) AS keyword FROM brands WHERE lower(name) NOT IN (SELECT lower(trim(brand_raw)) FROM landed_products WHERE brand_raw IS NOT NULL)")
def uncrawled_keywords(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "landed_products").select(F.lower(F.trim("brand_raw")).alias("k"))
    return crawl_state.uncrawled(table(spark, d, "brands"), F.lower("name"), seen, F.col("k")).select(F.lower("name").alias("keyword"))


@query(
    f"""SELECT item, count(*) FILTER (status = 'completed') AS total, count(*) FILTER (status = 'completed' AND ended_at >= {NOW} - INTERVAL 24 HOUR) AS last_24h,
    count(*) FILTER (status = 'completed' AND ended_at >= {NOW} - INTERVAL 7 DAY) AS last_week FROM {LOGS} GROUP BY item"""
)
def crawl_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, now = logs(spark, d)
    return stats.completed_windows(rows, now, "item")


# --- functions over columns ---------------------------------------------------------------------

SPACE = "[\\t\\n\\x0B\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
NORMAL = f"trim(regexp_replace(regexp_replace(lower(name), '{SPACE}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'))"


@query(f"SELECT crawl_id, {NORMAL} AS normal FROM crawled_products")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_products").select("crawl_id", text.normalize_name(F.col("name")).alias("normal"))


@query(
    f"""SELECT crawl_id, CASE WHEN name IS NOT NULL THEN lpad(lower(hex(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END))), 16, '0') END AS hash FROM (
      SELECT crawl_id, name, list_reduce(list_transform(list_filter(string_split(coalesce({NORMAL}, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM crawled_products)"""
)
def name_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_products").select("crawl_id", text.name_hash(F.col("name")).alias("hash"))


@query("SELECT crawl_id, coalesce(TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS DOUBLE), 0) AS price FROM (SELECT crawl_id, CAST(CAST(price AS BIGINT) AS VARCHAR) || '.000₫' AS v FROM crawled_products)")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.col("price").cast("long").cast("string"), F.lit(".000₫"))
    return table(spark, d, "crawled_products").select("crawl_id", parse.digits_price(written).alias("price"))


@query("SELECT crawl_id, CASE WHEN sold_count IS NULL THEN 0 ELSE CAST(floor((sold_count // 1000) * 1000 + ((sold_count % 1000) // 100) * 100 + 0.5) AS BIGINT) END AS sold FROM crawled_products")
def sold_count_parse(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.expr("sold_count div 1000").cast("string"), F.lit(","), F.expr("(sold_count % 1000) div 100").cast("string"), F.lit("k đã bán"))
    return table(spark, d, "crawled_products").select("crawl_id", parse.sold_count(written).alias("sold"))


@query("SELECT crawl_id, CASE WHEN crawl_id % 2 = 0 THEN (CAST(round(rating * 20) AS INT) / 100.0) * 5 WHEN rating <= 5 THEN rating END AS stars FROM crawled_products")
def rating_parse(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("crawl_id") % 2 == 0, F.concat(F.lit("width: "), F.round(F.col("rating") * 20).cast("int").cast("string"), F.lit("%"))).otherwise(F.col("rating").cast("string"))
    return table(spark, d, "crawled_products").select("crawl_id", parse.rating(written).alias("stars"))


@query("SELECT crawl_id, CASE WHEN original_price > price AND price > 0 THEN CAST(floor((original_price - price) / original_price * 100 + 0.5) AS INT) ELSE 0 END AS off, CASE WHEN original_price > price THEN original_price END AS original FROM crawled_products")
def discounts(spark: SparkSession, d: str) -> DataFrame:
    o, p = F.col("original_price"), F.col("price")
    return table(spark, d, "crawled_products").select("crawl_id", parse.discount_percent(o, p).alias("off"), parse.original_if_higher(o, p).alias("original"))


@query("SELECT c.crawl_id, arg_min(s.name, s.id) AS platform FROM crawled_products c LEFT JOIN sources s ON contains(lower(c.external_url), lower(s.host)) GROUP BY c.crawl_id")
def url_platform_detect(spark: SparkSession, d: str) -> DataFrame:
    """The shop by the part of the address that occurs first in the list of shops (a fixed table)."""
    hosts = {r["name"]: [r["host"].lower()] for r in table(spark, d, "sources").where("host is not null").orderBy("id").collect()}
    return table(spark, d, "crawled_products").select("crawl_id", platforms.from_url(F.col("external_url"), hosts).alias("platform"))


@query("SELECT id, coalesce(nullif(lower(trim(CASE WHEN platform IS NULL OR lower(platform) IN ('unknown', 'null', 'none', '') THEN coalesce(NULL, platform) ELSE platform END)), ''), 'unknown') AS platform FROM product_items")
def platform_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").select("id", platforms.normalized(F.col("platform"), F.col("external_url")).alias("platform"))


@query("SELECT crawl_id, coalesce(nullif(regexp_extract(external_url, '-p([0-9]+)\\.html', 1), ''), nullif(regexp_extract(external_url, '/p([0-9]+)\\.html', 1), '')) AS product, nullif(regexp_extract(external_url, '/([^/]+)\\.html$', 1), '') AS page FROM crawled_products")
def url_product_id(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("external_url")
    return table(spark, d, "crawled_products").select("crawl_id", parse.product_id(url, F.lit("tiki")).alias("product"), parse.product_id(url, F.lit("cellphones")).alias("page"))


@query("SELECT crawl_id, nullif(translate(CASE WHEN regexp_extract(external_url, '/([^/]+)\\.html', 1) <> '' THEN regexp_extract(external_url, '/([^/]+)\\.html', 1) ELSE replace(list_extract(string_split(external_url, '/'), -1), '.html', '') END, '-', '_'), '') AS slug FROM crawled_products")
def slug_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_products").select("crawl_id", parse.slug_id(F.col("external_url")).alias("slug"))


@query("SELECT crawl_id, CASE crawl_id % 4 WHEN 0 THEN external_url WHEN 1 THEN 'https:' || regexp_replace(external_url, '^https:', '') WHEN 2 THEN 'https://x.example' || regexp_replace(external_url, '^https://[^/]+', '') ELSE 'https://x.example/' || regexp_replace(external_url, '^https://[^/]+/', '') END AS url FROM crawled_products WHERE external_url IS NULL OR regexp_matches(external_url, '^https://[^/]+/') UNION ALL SELECT crawl_id, NULL FROM crawled_products WHERE NOT regexp_matches(external_url, '^https://[^/]+/')")
def absolute_url(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as pages write them: whole, without the scheme, from the root, relative; those of another form are given as none."""
    url, kind = F.when(F.col("external_url").rlike("^https://[^/]+/"), F.col("external_url")), F.col("crawl_id") % 4
    bare = F.when(kind == 0, url).when(kind == 1, F.regexp_replace(url, "^https:", "")).when(kind == 2, F.regexp_replace(url, "^https://[^/]+", "")).otherwise(F.regexp_replace(url, "^https://[^/]+/", ""))
    return table(spark, d, "crawled_products").select("crawl_id", parse.absolute_url(bare, "https://x.example").alias("url"))


@query("SELECT DISTINCT external_url AS loc FROM (SELECT external_url FROM crawled_products UNION ALL SELECT external_url FROM product_items UNION ALL SELECT external_url FROM landed_products) WHERE external_url <> ''")
def sitemap_distinct(spark: SparkSession, d: str) -> DataFrame:
    sets = [table(spark, d, t).select(F.col("external_url").alias("loc")).where("loc <> ''") for t in ("crawled_products", "product_items", "landed_products")]
    return landed.distinct_urls(*sets)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT crawl_id, CAST(json_extract(metadata, '$.trang') AS BIGINT) AS page, CAST(json_extract(metadata, '$.vi_tri') AS BIGINT) AS place FROM crawled_products")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("metadata")
    return table(spark, d, "crawled_products").select("crawl_id", F.try_variant_get(v, "$.trang", "long").alias("page"), F.try_variant_get(v, "$.vi_tri", "long").alias("place"))


@query("SELECT crawl_id, unnest(map_keys(specs)) AS key, unnest(map_values(specs)) AS value FROM crawled_products")
def specs_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Specifications grouped as shops send them, flattened to a map, one row per entry."""
    entries = F.transform(F.map_entries("specs"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    groups = F.array(F.struct(entries.alias("attributes")))
    return table(spark, d, "crawled_products").select("crawl_id", F.explode(parse.flatten_specs(groups)).alias("key", "value"))


@query("SELECT doc_id, trim(x) AS part FROM (SELECT doc_id, unnest(string_split(title, ' ')) AS x FROM documents WHERE title IS NOT NULL)")
def csv_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(parse.csv_list(F.regexp_replace("title", " ", " , "))).alias("part"))


@query("SELECT crawl_id, CASE WHEN price IS NULL OR price = 0 THEN 'Liên hệ' ELSE replace(format('{:,}', CAST(round(price) AS BIGINT)), ',', '.') || ' ₫' END AS shown FROM crawled_products")
def price_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_products").select("crawl_id", display.price_text(F.col("price")).alias("shown"))


@query(
    "SELECT crawl_id, CASE WHEN sold_count >= 1000000 THEN printf('%.1fM', round(sold_count / 1000000, 1)) WHEN sold_count >= 1000 THEN printf('%.1fK', round(sold_count / 1000, 1)) ELSE CAST(sold_count AS VARCHAR) END AS shown FROM crawled_products"
)
def compact_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_products").select("crawl_id", display.compact_number(F.col("sold_count")).alias("shown"))


NAMES = "CASE lower(platform) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.PLATFORM_NAMES.items()) + " ELSE upper(platform[1]) || platform[2:] END"


@query(f"SELECT id, CASE WHEN coalesce(platform, '') = '' THEN 'Unknown' ELSE {NAMES} END AS shown FROM (SELECT id, platform FROM product_items UNION ALL SELECT 'x' || row_number() OVER (), p FROM unnest(['TIKI', 'dienmayxanh', 'thegioididong', 'Unknown', 'chợ lạ', '', NULL]) AS t(p))")
def platform_display(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([(f"x{n}", p) for n, p in enumerate(["TIKI", "dienmayxanh", "thegioididong", "Unknown", "chợ lạ", "", None], 1)], "id string, platform string")
    return table(spark, d, "product_items").select("id", "platform").unionByName(more).select("id", display.platform_name(F.col("platform")).alias("shown"))


@query("SELECT record_id, strftime(crawled_at, '%d/%m/%Y') AS shown FROM landed_products")
def date_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "landed_products").select("record_id", display.date_text(F.col("crawled_at")).alias("shown"))


# --- landed sources -----------------------------------------------------------------------------


def escaped(c: str) -> Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@query("SELECT crawl_id, trim(external_url) AS loc FROM crawled_products WHERE external_url IS NOT NULL AND trim(external_url) <> ''")
def sitemap_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every address in a sitemap of its own, parsed again."""
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), escaped("external_url"), F.lit("</loc></url></urlset>"))
    docs = table(spark, d, "crawled_products").select("crawl_id", xml.alias("value"))
    return landed.sitemap_texts(docs).select("crawl_id", "loc")


@query("SELECT CAST(crawl_id AS VARCHAR) AS external_id, CAST(CAST(price AS BIGINT) AS DOUBLE) AS price FROM crawled_products WHERE abs(trunc(price)) > 0 AND regexp_matches(name, '[^\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')".replace("CAST(CAST(price AS BIGINT)", "CAST(CAST(abs(trunc(price)) AS BIGINT)"))
def html_items(spark: SparkSession, d: str) -> DataFrame:
    """Every product in a listing page of its own, parsed again."""
    page = F.concat(
        F.lit('<div class="list"><li class="item" data-id="'), F.col("crawl_id"), F.lit('"><a href="'), F.coalesce(escaped("external_url"), F.lit("")), F.lit('"><h3>'), F.coalesce(escaped("name"), F.lit("")),
        F.lit('</h3></a><strong class="price">'), F.coalesce(F.col("price").cast("long").cast("string"), F.lit("")), F.lit("₫</strong></li></div>"),
    )
    return landed.html_items(table(spark, d, "crawled_products").select(page.alias("html")), ["li.product[data-id]", "li.item[data-id]"], "https://shop.example").select("external_id", "price")


# The text of a link: white space of any kind is one space.
SHOWN = "trim(regexp_replace(name, '[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))"


@query(
    f"""
    WITH links AS (
      SELECT CASE WHEN starts_with(external_url, 'http') THEN external_url ELSE 'https://shop.example/' || external_url END AS external_url, {SHOWN} AS name, CAST(CAST(price AS BIGINT) AS DOUBLE) AS price
      FROM crawled_products WHERE {SHOWN} <> '' AND external_url IS NOT NULL AND price >= 1000)
    SELECT external_url, name, price FROM (SELECT *, row_number() OVER (PARTITION BY external_url ORDER BY encode(name), price) AS rn FROM links) WHERE rn = 1
    """
)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """The priced links of all named rows with an address, also of addresses with several names and prices."""
    rows = table(spark, d, "crawled_products")
    shown = F.coalesce(F.concat(F.translate(F.format_number(F.col("price").cast("long"), 0), ",", "."), F.lit("₫")), F.lit(""))
    page = F.concat(F.lit("<div><a"), F.coalesce(F.concat(F.lit(' href="'), escaped("external_url"), F.lit('"')), F.lit("")), F.lit(">"), F.coalesce(escaped("name"), F.lit("")), F.lit("</a> <b>"), shown, F.lit("</b></div>"))
    return landed.html_links(rows.select(page.alias("html")), "https://shop.example").select("external_url", "name", "price")


@query(
    """
    SELECT CAST(crawl_id AS VARCHAR) AS external_id, p AS price, CASE WHEN o > p THEN o END AS original_price, category
    FROM (SELECT *, coalesce(original_price, price) AS o, CASE WHEN price > 0 THEN price ELSE coalesce(original_price, price) END AS p FROM crawled_products) WHERE p > 0
    """
)
def graph_api(spark: SparkSession, d: str) -> DataFrame:
    """Every row in a response of a graph API, also those without a price of their own or with one above the original."""
    general = F.struct(F.col("crawl_id").cast("string").alias("product_id"), "name", F.col("external_url").alias("url_path"), F.col("brand").alias("manufacturer"), F.array(F.struct(F.col("category").alias("name"))).alias("categories"))
    prices = F.struct(F.coalesce("original_price", "price").alias("price"), F.col("price").alias("special_price"), F.col("image_url").alias("thumbnail"))
    item = F.struct(general.alias("general"), prices.alias("filterable"))
    docs = table(spark, d, "crawled_products").select(F.to_json(F.struct(F.struct(F.array(item).alias("products")).alias("data"))).alias("value"))
    return landed.graph_products(docs, "https://shop.example", "https://img.example").select("external_id", "price", "original_price", "category")


@query("SELECT source_id, external_id, name, price FROM landed_products")
def landed_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The landed rows written as JSON lines, with blank and broken lines between, and read again."""
    path = scratch(spark, "lines")
    rows = table(spark, d, "landed_products")
    line = F.to_json(F.struct("source_id", "external_id", "external_url", "name", "price", "image_url", "brand_raw", "category_raw", "crawled_at"))
    lines = rows.select(F.explode(F.array(line, F.lit(""), F.lit('{"source_id": 1, "name": '))).alias("value"))
    lines.write.text(path)
    return landed.records(spark, path).select("source_id", "external_id", "name", "price")


@query("SELECT CAST(crawl_id AS VARCHAR) AS external_id, price, CASE WHEN original_price > price THEN original_price END AS original_price, coalesce(sold_count, 0) AS sold_count, coalesce(review_count, 0) AS review_count FROM crawled_products WHERE price > 0")
def paged_api(spark: SparkSession, d: str) -> DataFrame:
    """Every product in a response of a paged listing, parsed again."""
    item = F.struct(F.col("crawl_id").cast("string").alias("id"), "name", F.col("external_url").alias("url_path"), "price", "original_price", "review_count", F.struct(F.col("sold_count").alias("value")).alias("quantity_sold"))
    docs = table(spark, d, "crawled_products").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("value"))
    return landed.paged_products(docs, "https://shop.example").select("external_id", "price", "original_price", "sold_count", "review_count")


@query("SELECT CAST(crawl_id AS VARCHAR) AS external_id, CAST(CAST(abs(trunc(price)) AS BIGINT) AS DOUBLE) AS price, CAST(crawl_id % 7 AS DOUBLE) AS rating FROM crawled_products WHERE abs(trunc(price)) > 0")
def ajax_api(spark: SparkSession, d: str) -> DataFrame:
    """Every product in an ajax response of strings, parsed again."""
    item = F.struct(F.lit("").alias("itemId"), F.col("crawl_id").cast("string").alias("nid"), "name", F.concat(F.translate(F.format_number(F.col("price").cast("long"), 0), ",", "."), F.lit(" ₫")).alias("price"), (F.col("crawl_id") % 7).cast("string").alias("ratingScore"), F.col("external_url").alias("itemUrl"))
    docs = table(spark, d, "crawled_products").select(F.to_json(F.struct(F.struct(F.array(item).alias("listItems")).alias("mods"))).alias("value"))
    return landed.ajax_products(docs.unionByName(spark.createDataFrame([("<html>blocked",), (None,)], "value string")), "https://shop.example").select("external_id", "price", "rating")


@query("SELECT CAST(crawl_id AS VARCHAR) AS external_id, 'https://ads.example/' || crawl_id || '.htm' AS external_url, price FROM crawled_products WHERE price > 0")
def classified_api(spark: SparkSession, d: str) -> DataFrame:
    """Every product in a response of classified ads, parsed again."""
    item = F.struct(F.col("crawl_id").cast("string").alias("list_id"), F.col("name").alias("subject"), "price", F.col("image_url").alias("image"), F.col("category").alias("category_name"))
    docs = table(spark, d, "crawled_products").select(F.to_json(F.struct(F.array(item).alias("ads"))).alias("value"))
    return landed.classified_ads(docs, "https://ads.example").select("external_id", "external_url", "price")


@query("SELECT 'crawled' AS source, 'ok' AS status, count(*) AS n FROM crawled_products UNION ALL SELECT 'landed', 'ok', count(*) FROM landed_products")
def multi_source_status(spark: SparkSession, d: str) -> DataFrame:
    out = stats.per_source({"crawled": table(spark, d, "crawled_products"), "landed": table(spark, d, "landed_products")})
    return out.select("source", "status", "n")


# --- extensions ---------------------------------------------------------------------------------


@query("SELECT platform, category, count(*) AS n, CAST(grouping(platform) * 2 + grouping(category) AS BIGINT) AS level FROM product_items GROUP BY CUBE (platform, category)")
def platform_category_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").cube("platform", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("platform", "category", "n", "level")


@query("SELECT external_id FROM product_items INTERSECT SELECT external_id FROM crawled_products")
def shared_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").select("external_id").intersect(table(spark, d, "crawled_products").select("external_id"))


@query("SELECT external_id FROM product_items EXCEPT ALL SELECT external_id FROM crawled_products")
def missing_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_items").select("external_id").exceptAll(table(spark, d, "crawled_products").select("external_id"))


# --- trees and evaluation -----------------------------------------------------------------------

TREE = "WITH RECURSIVE t AS (SELECT id, name, parent_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, c.name, c.parent_id, t.depth + 1, t.path || '/' || c.id FROM categories c JOIN t ON c.parent_id = t.id)"


@query(f"{TREE} SELECT id, name, parent_id, depth, path FROM t")
def tree_flatten(spark: SparkSession, d: str) -> DataFrame:
    return tree.flattened(table(spark, d, "categories")).withColumn("path", F.array_join("path", "/"))


@query("SELECT id, name FROM categories WHERE id NOT IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL)")
def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return tree.leaves(table(spark, d, "categories")).select("id", "name")


@query(f"{TREE} SELECT count(*) AS n_nodes FROM t")
def tree_count(spark: SparkSession, d: str) -> DataFrame:
    return tree.node_count(table(spark, d, "categories"))


@query(f"{TREE} SELECT CAST(id AS VARCHAR) AS id FROM t")
def tree_ids(spark: SparkSession, d: str) -> DataFrame:
    return tree.all_ids(table(spark, d, "categories"))


@query(
    "SELECT id, slug FROM (SELECT *, id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) AS inner_ FROM categories) WHERE NOT inner_ OR level = 0 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY inner_, id) = 1"
)
def crawl_targets(spark: SparkSession, d: str) -> DataFrame:
    return tree.crawl_targets(table(spark, d, "categories")).select("id", "slug")


@query("SELECT id, name FROM categories WHERE is_active AND (source_id IS NULL OR source_id = 2)")
def active_categories(spark: SparkSession, d: str) -> DataFrame:
    return landed.categories(table(spark, d, "categories"), 2).select("id", "name")


JUDGED = {50: (["nồi cơm", "1,2", "điện"], ["nồi cơm", "rice cooker"]), 100: (["điện thoại", "128gb", "đen"], ["điện thoại", "phone"]), 150: (["máy hút bụi", "kw"], ["hút bụi", "vacuum"])}
JUDGED_SQL = "(VALUES " + ", ".join(f"({q}, {a!r}, {b!r})" for q, (a, b) in JUDGED.items()) + ") AS j(query_id, exact, broad)"
RELEVANCE = """
  judged AS (SELECT t.query_id, t.rank, len(list_filter(exact, lambda p: contains(lower(name), p))) / len(exact) AS relevance
             FROM (SELECT *, {top} AS rank FROM text_scores) t JOIN {judged} USING (query_id) JOIN (SELECT CAST(id AS BIGINT) AS doc_id, name FROM product_items) USING (doc_id) WHERE rank <= 10),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS best FROM judged)""".format(top=TOP, judged=JUDGED_SQL)
METRICS = """SELECT query_id, count(*) FILTER (relevance >= 0.5) / 10.0 AS p10, coalesce(max(CASE WHEN relevance >= 0.5 THEN 1.0 / rank END), 0) AS mrr,
  CASE WHEN sum((pow(2, relevance) - 1) / log2(best + 1)) > 0 THEN sum((pow(2, relevance) - 1) / log2(rank + 1)) / sum((pow(2, relevance) - 1) / log2(best + 1)) ELSE 0 END AS ndcg FROM ordered GROUP BY query_id"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The best ten names of each judged search with their relevance."""
    found = ranking.top(searched(spark, d), 10)
    phrases = spark.createDataFrame([(q, a, b) for q, (a, b) in JUDGED.items()], "query_id int, exact array<string>, broad array<string>")
    names = table(spark, d, "product_items").select(F.col("id").cast("long").alias("doc_id"), "name")
    rows = found.join(F.broadcast(phrases), "query_id").join(names, "doc_id", "left")
    return rows.select("query_id", "rank", "name", evaluation.relevance("bm25", F.col("name"), F.col("exact"), F.col("broad")).alias("relevance"), evaluation.relevance("hybrid", F.col("name"), F.col("exact"), F.col("broad")).alias("mixed"))


@query(f"WITH {BM25}, {RELEVANCE} SELECT query_id, round(p10, 6) AS p10, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({METRICS})")
def eval_p10_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.metrics(judged(spark, d), "query_id")
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("p10", "mrr", "ndcg")))


@query(f"WITH {BM25}, {RELEVANCE} SELECT 'bm25' AS method, round(avg(p10), 6) AS p10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({METRICS})")
def eval_by_method(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.by_method(evaluation.metrics(judged(spark, d).withColumn("method", F.lit("bm25")), "method", "query_id"))
    return out.select("method", *(F.round(c, 6).alias(c) for c in ("p10", "mrr", "ndcg")))


@query("SELECT CAST(id AS BIGINT) AS doc_id, len(list_filter(['nồi cơm', 'điện', '1,2'], lambda p: contains(lower(name), p))) / 3 AS share, CAST(contains(lower(name), 'nồi cơm') OR contains(lower(name), 'rice cooker') AS DOUBLE) AS hit FROM product_items")
def phrase_relevance(spark: SparkSession, d: str) -> DataFrame:
    broad = F.array(*(F.lit(p) for p in JUDGED[50][1]))
    items = table(spark, d, "product_items")
    return items.select(F.col("id").cast("long").alias("doc_id"), text.phrase_share(F.col("name"), F.array(F.lit("nồi cơm"), F.lit("điện"), F.lit("1,2"))).alias("share"), text.any_phrase(F.col("name"), broad).alias("hit"))


# --- streams ------------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, counted per day and type; the complete result after all of it."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(event_folder(spark, d))
    counts = ingest.windowed_counts(stream, "ts", "event_type", "1 day")
    path = scratch(spark, "windowed")
    writer = counts.select(F.unix_micros("start").alias("start_us"), "event_type", "n").writeStream.outputMode("complete")
    ingest.run_once(lambda: writer.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(path + "/out")), path + "/checkpoint")
    return spark.read.parquet(path + "/out")


def event_folder(spark: SparkSession, d: str) -> str:
    """A folder with the events for a file stream, which reads folders only."""
    path = scratch(spark, "events")
    table(spark, d, "events").write.parquet(path)
    return path


@query("SELECT record_id, source_id, external_id, price FROM landed_products QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY record_id DESC) = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The landed rows as micro-batches, upserted one by one."""
    base = scratch(spark, "upsert")
    rows = table(spark, d, "landed_products").select("record_id", "source_id", "external_id", "price")
    middle = rows.agg(F.expr("(min(record_id) + max(record_id)) div 2")).first()[0] or 0
    for part in (F.col("record_id") <= middle, F.col("record_id") > middle):  # files are read in the order they were written
        rows.where(part).repartition(2, "source_id", "external_id").write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(base + "/in")
    ingest.run_once(lambda: ingest.upsert_batches(stream, base + "/out", ["source_id", "external_id"], "record_id"), base + "/checkpoint")
    return ingest.current(spark, base + "/out", ["source_id", "external_id"])


@query(f"SELECT * FROM {POSTS}")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """An inverted index kept by micro-batches."""
    base = scratch(spark, "index-parts")
    docs = index.corpus(table(spark, d, "product_items"), "id", "name_normalized")
    docs.repartition(4, "doc_id").write.parquet(base + "/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(base + "/in")
    ingest.run_once(lambda: ingest.index_batches(stream, base + "/out"), base + "/checkpoint")
    return index.merged(spark.read.parquet(base + "/out").drop("part"))
