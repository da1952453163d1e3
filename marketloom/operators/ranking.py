"""BM25, vector and hybrid ranking of many queries at once.

Queries are a small table or list; postings meet the query terms in a join that prunes to the
terms asked for.  Ties go to the smaller document id.  Filters run before ranking ('pre', exact)
or after it with over-fetching ('post').
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators.index import Index
from marketloom.session import cut

K1, B = 1.5, 0.75
OVER_FETCH, MOST_FETCHED = 20, 1000
MOST_LITERALS = 1000


def query_rows(queries: dict[int, str]) -> list[tuple[int, str, int]]:
    """``(query_id, term, weight)`` of lower-cased queries; a repeated term weighs as often as it occurs."""
    return [(q, t, n) for q, text in queries.items() for t, n in Counter(text.lower().split()).items()]


def query_terms(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """The same as a table; it is part of the plan, so reading it runs no job."""
    rows = query_rows(queries)
    kinds = (pa.int32(), pa.string(), pa.int64())
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], kinds[k]) for k, c in enumerate(("query_id", "term", "weight"))}))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """The part of a term's score that its document decides; the other factor is the idf."""
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def top(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best ``k`` rows of each query with their ranks; scores equal to nine places are ties."""
    w = W.partitionBy("query_id").orderBy(F.round(by, 9).desc(), F.col("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_scores(index: Index, terms: DataFrame | list[tuple[int, str, int]], k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document with a query term; a missing length counts as 0.

    ``terms`` are the rows of :func:`query_rows` or a table of such.  Up to MOST_LITERALS rows become literals that reach the
    scan, so that only row groups with the terms are read; a longer table is joined, and its size decides how.
    The document frequencies are those of the whole corpus."""
    spark = index.postings.sparkSession
    rows = terms if isinstance(terms, list) else [tuple(r) for r in terms.select("query_id", "term", "weight").limit(MOST_LITERALS + 1).collect()]
    few = len(rows) <= MOST_LITERALS
    table = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("query_id", pa.int64()), ("term", pa.string()), ("weight", pa.int64())))})) if few or isinstance(terms, list) else terms
    wanted = F.col("term").isin(sorted({r[1] for r in rows})) if few else None
    asked = index.postings.where(wanted) if few else index.postings.join(table.select("term").distinct(), "term", "left_semi")
    if index.lexicon is not None:
        df = index.lexicon.where(wanted) if few else index.lexicon
    else:
        df = asked.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = map(F.lit, index.size())
    weighted = table.join(df, "term").select("query_id", "term", (F.col("weight") * idf(n, F.col("df"))).alias("weight"))
    hits = asked.join(F.broadcast(weighted) if few else weighted, "term")  # a row per term of the request
    if "dl" not in hits.columns:
        hits = hits.join(index.lengths, "doc_id", "left")
    each = term_score(F.col("tf"), F.coalesce("dl", F.lit(0)), avgdl, k1, b) * F.col("weight")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(each).alias("score"))


def bm25(index: Index, terms: DataFrame, k: int = 10) -> DataFrame:
    return top(bm25_scores(index, terms), k)


def bm25_many(docs: DataFrame, queries: DataFrame, k: int = 10, among: DataFrame | None = None, block: int = 1024, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best documents ``(doc_id, tokens)`` of as many queries ``(query_id, tokens)`` as there are.

    As :func:`nearest`, queries go in blocks of a fixed number and each partition keeps its ``k`` best per
    query, so that pairs of queries and documents are never shuffled.  ``among`` has the ``doc_id`` of the
    documents that may be found; frequencies and lengths are those of the whole corpus."""
    one = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    frequency = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    n = queries.count()
    number = max(1, -(-n // block))
    rows = weights.join(frequency, "term").select(F.pmod(F.xxhash64("query_id"), F.lit(number)).alias("_part"), "query_id", "term", (F.col("weight") * idf(F.lit(float(one["n"])), F.col("df"))).alias("weight"))
    rows = cut(rows)
    lean = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "tokens")
    if among is not None:
        lean = cut(lean.join(among.select("doc_id"), "doc_id", "left_semi"))
    parts = []
    for part in range(number):
        asked = rows.where(F.col("_part") == part).select("query_id", "term", "weight").toArrow()
        if asked.num_rows:
            parts.append(bm25_block(lean, asked, float(one["avgdl"]), k, k1, b))
    if not parts:
        return lean.limit(0).select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, k)


def bm25_block(docs: DataFrame, asked: pa.Table, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """Candidates ``(query_id, doc_id, score)`` of one block of queries ``(query_id, term, weight)``, the idf being in the weight."""
    ids, query = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
    terms = pc.unique(asked.column("term").combine_chunks())
    term = pc.index_in(asked.column("term").combine_chunks(), terms).to_numpy()
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((ids, terms.to_pylist(), begin, query[order], asked.column("weight").to_numpy()[order]))

    def scores(own: pa.Array, known: pa.Array) -> np.ndarray:
        """A row per document, a column per query."""
        width, start, of, weight = len(shared.value[0]), *shared.value[2:]
        size = pc.list_value_length(own).to_numpy()
        place = pc.fill_null(pc.index_in(own.flatten(), known), -1).to_numpy()
        doc = np.repeat(np.arange(len(own)), size)[place >= 0]
        pair, tf = np.unique(doc * len(known) + place[place >= 0], return_counts=True)
        doc, place = pair // len(known), pair % len(known)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / avgdl))
        many = start[place + 1] - start[place]
        at = np.repeat(start[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(np.repeat(doc, many) * width + of[at], np.repeat(part, many) * weight[at], len(own) * width).reshape(-1, width)

    def best(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, d, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((d, -np.round(s, 9), q))
        q, d, s = q[order], d[order], s[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[kept], d[kept], s[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value[1], pa.string())
        width = len(shared.value[0])
        floor = np.zeros(width)  # the k-th best so far
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        waiting = 0
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                docs = batch.column("doc_id").to_numpy()
                score = scores(batch.column("tokens"), known)
                d, q = np.nonzero((score > 0) & (score >= floor - 1e-8))
                found.append((q, docs[d], score[d, q]))
                waiting += len(q)
                if waiting > 4 * k * width or waiting > 4_000_000:
                    found, waiting = [best(found)], 0
                    count = np.bincount(found[0][0], minlength=width)
                    last = np.cumsum(count) - 1
                    floor = np.where(count >= k, found[0][2][np.maximum(last, 0)], 0.0)
        q, d, s = best(found)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

    return docs.mapInArrow(run, "query_id long, doc_id long, score double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: exact nearest vectors ``(doc_id, embedding)`` by cosine of queries ``(query_id, embedding)``.

    Queries go in blocks of a fixed number; each batch of vectors is one matrix product per block and
    keeps its ``k`` best per query, so that only candidates are shuffled.  Vectors without length score 0."""
    n = queries.count()
    numbered = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))))
    parts = []
    for part in range(max(1, -(-n // block))):
        rows = numbered.where(F.col("_part") == part).select("query_id", "embedding").collect()
        if rows:
            parts.append(nearest_block(vectors, [r[0] for r in rows], [r[1] for r in rows], k))
    if not parts:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, k)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def nearest_block(vectors: DataFrame, ids: list[int], probes: list[list[float]], k: int) -> DataFrame:
    """Candidates ``(query_id, doc_id, score)`` of one block of queries: the best ``k`` of every task, kept while its batches pass."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), unit(np.array(probes, np.float64)).T))

    def best(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        q, d, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((d, -np.round(s, 9), q))
        q, d, s = q[order], d[order], s[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return [(q[first], d[first], s[first])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, probe = shared.value
        floor = np.full(len(query), -2.0)  # the k-th best so far
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("embedding")
            own = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            docs = b.column("doc_id").to_numpy()
            score = np.round(unit(own) @ probe, 12)
            if len(score) > k:  # the k best of each column, and what ties with the last of them
                least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
                d, q = np.nonzero(score >= np.maximum(least, floor)[None, :] - 2e-9)
            else:
                d, q = np.nonzero(score >= floor[None, :] - 2e-9)
            kept = best([*kept, (q, docs[d], score[d, q])])
            count = np.bincount(kept[0][0], minlength=len(query))
            floor = np.where(count >= k, kept[0][2][np.maximum(np.cumsum(count) - 1, 0)], -2.0)
        q, d, s = kept[0]
        yield pa.RecordBatch.from_arrays([pa.array(query[q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

    lean = vectors.where("embedding is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "embedding")
    return lean.mapInArrow(run, "query_id long, doc_id long, score double")


def scaled(scores: DataFrame, name: str) -> DataFrame:
    """Scores of each query scaled to [0, 1]; 1 where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.select("query_id", "doc_id", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))


def fused(vector_top: DataFrame, text_top: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """``alpha`` of the scaled vector score and the rest of the scaled text score; a missing one is 0."""
    both = scaled(vector_top, "v").join(scaled(text_top, "t"), ["query_id", "doc_id"], "full")
    v, t = F.coalesce("v", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return top(both.select("query_id", "doc_id", (alpha * v + (1 - alpha) * t).alias("score")), k)


def hybrid(vector_all: DataFrame, text_all: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """Both engines' best ``2 k``, fused."""
    return fused(top(vector_all, 2 * k), top(text_all, 2 * k), k, alpha)


def fetch_depth(limit: int, filtered: bool) -> int:
    """How many results to rank before a filter runs on them."""
    return min(limit * OVER_FETCH, MOST_FETCHED) if filtered else limit


def filtered_top(scores: DataFrame, products: DataFrame, condition: Column, k: int, mode: str = "pre") -> DataFrame:
    """The best ``k`` results that satisfy a condition on their products.

    'pre' filters all scored documents and then ranks; 'post' ranks, over-fetches and filters, so it
    can come out short."""
    allowed = products.where(condition).select("doc_id")
    if mode == "pre":
        return top(scores.join(allowed, "doc_id", "left_semi"), k)
    ranked = top(scores, fetch_depth(k, True)).drop("rank")
    return top(ranked.join(allowed, "doc_id", "left_semi"), k)
