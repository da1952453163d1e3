"""The queries of the problems tagged llm, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import canonical_values, format_duplicates, leaked_passages, plain_text, same_product, window_packing, wrong_encoding
from marketloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values.found(table(spark, d, "landed_products"), table(spark, d, "brands"), table(spark, d, "categories"))


def p1_misses(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values.misses(table(spark, d, "landed_products"), table(spark, d, "brands"), table(spark, d, "categories"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.pairs(format_duplicates.members(table(spark, d, "crawled_products")))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapsed(table(spark, d, "crawled_products")).select("crawl_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return same_product.pairs(same_product.grouped(table(spark, d, "crawled_products"), table(spark, d, "brands")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return same_product.grouped(table(spark, d, "crawled_products"), table(spark, d, "brands"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    names = plain_text.masked_rows(table(spark, d, "crawled_products"), "crawled_products", "crawl_id", "name")
    return names.unionByName(plain_text.masked_rows(table(spark, d, "product_items"), "product_items", "id", "name_normalized"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.with_plain_text(table(spark, d, "crawled_products").select("crawl_id", "name"), "name").select("crawl_id", "plain", "changed")


def tokenizer() -> str:
    """The rank file of a public tokenizer; MARKETLOOM_TOKENIZER names another one."""
    return os.environ.get("MARKETLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return window_packing.packed(table(spark, d, "documents"), tokenizer())


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return window_packing.fill(p7_containers(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return window_packing.violations(p7_containers(spark, d))


def names(spark: SparkSession, d: str) -> np.ndarray:
    return leaked_passages.lexicon(table(spark, d, "brands"), table(spark, d, "sources"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages.passages(table(spark, d, "documents"), table(spark, d, "eval_items"), names(spark, d))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages.by_item(p8_found(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.found(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.restored(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# All runs of twelve words of every document against those of every item.
P8_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}]+') AS words FROM documents UNION ALL
  SELECT 'i', item_id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}]+') FROM eval_items),
runs AS (SELECT side, id, array_to_string(words[i:i + 11], ' ') AS run FROM w, unnest(generate_series(1, len(words) - 11)) AS t(i))
SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM runs d JOIN runs i ON d.run = i.run WHERE d.side = 'd' AND i.side = 'i'
"""
# Equal letters and digits in any order and equal addresses; for anagrams at one address, which these tables do not have, it is too wide.
P2_KEYS = r"""
WITH c AS (
  SELECT crawl_id, list_sort(string_split(regexp_replace(lower(name), '[^\p{L}\p{N}\p{M}]', '', 'g'), '')) AS letters,
    regexp_replace(lower(string_split(external_url, '?')[1]), '[^\p{L}\p{N}]', '', 'g') AS path,
    list_sort(list_filter(list_transform(string_split(lower(coalesce(string_split(external_url, '?')[2], '')), '&'), lambda p: regexp_replace(p, '[^\p{L}\p{N}=]', '', 'g')), lambda p: p <> '')) AS tail
  FROM crawled_products WHERE name IS NOT NULL AND external_url IS NOT NULL)
"""
P2_SQL = P2_KEYS + "SELECT a.crawl_id AS id_a, b.crawl_id AS id_b FROM c a JOIN c b ON a.path = b.path AND a.letters = b.letters AND a.tail = b.tail AND a.crawl_id < b.crawl_id"
P2_RECORDS_SQL = P2_KEYS + """SELECT min(crawl_id) AS crawl_id, count(*) AS copies FROM c GROUP BY path, letters, tail
UNION ALL SELECT crawl_id, 1 FROM crawled_products WHERE name IS NULL OR external_url IS NULL"""
P8_ITEMS_SQL = f"SELECT item_id, count(*) AS n_docs FROM ({P8_SQL}) GROUP BY item_id"
# What every packing must keep to: all documents, no container too full, none split that fits.
P7_SQL = "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_too_full, CAST(0 AS BIGINT) AS n_split_needlessly, CAST(0 AS BIGINT) AS n_gaps FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_records": P2_RECORDS_SQL, "p7_invariants": P7_SQL, "p8_found": P8_SQL, "p8_items": P8_ITEMS_SQL}
