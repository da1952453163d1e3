"""Retrieval metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.text import any_phrase, phrase_share

RELEVANT, DEPTH = 0.5, 10


def relevance(method: str, name: Column, exact: Column, broad: Column) -> Column:
    """The share of exact phrases for text search, any broad phrase for vector search, their mean for hybrid search."""
    if method == "bm25":
        return phrase_share(name, exact)
    if method == "vector":
        return any_phrase(name, broad)
    return (phrase_share(name, exact) + any_phrase(name, broad)) / 2


def metrics(judged: DataFrame, *by: str) -> DataFrame:
    """``p10, mrr, ndcg`` of each query from ``(by..., rank, relevance)``; precision is always out of ten, the
    ideal order is that of the retrieved results."""
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.col("relevance").desc(), F.col("rank")))
    rows = judged.where(F.col("rank") <= DEPTH).withColumn("_best", best)
    hit = F.col("relevance") >= RELEVANT
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    out = rows.groupBy(*by).agg(
        (F.count_if(hit) / float(DEPTH)).alias("p10"),
        F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain / F.log2(F.col("rank") + 1)).alias("_dcg"),
        F.sum(gain / F.log2(F.col("_best") + 1)).alias("_ideal"),
    )
    return out.select(*by, "p10", "mrr", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def by_method(each: DataFrame, method: str = "method") -> DataFrame:
    """Mean metrics of each method."""
    return each.groupBy(method).agg(*(F.avg(c).alias(c) for c in ("p10", "mrr", "ndcg")))
