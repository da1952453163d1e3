"""One object over a product catalogue: search, listings, statistics and maintenance.

Everything it returns is a lazy DataFrame; the caller decides what to collect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.text import tokens
from marketloom.operators import catalog, evaluation, filters, index, quality, ranking, segmentation, stats
from marketloom.session import ship
from marketloom.sources import vectors


@dataclass(frozen=True)
class Request:
    """A search: text, number of results, share of the vector score, platforms and inclusive price bounds."""

    query: str
    top_k: int = 10
    alpha: float = 0.5
    platforms: list[str] = field(default_factory=list)
    min_price: float | None = None
    max_price: float | None = None

    @property
    def filtered(self) -> bool:
        return bool(self.platforms) or self.min_price is not None or self.max_price is not None


class Engine:
    """``products`` needs id, name, name_normalized, price and platform; ``vectors`` (doc_id, embedding) and
    ``encode`` (a query's vector) are needed for vector and hybrid search only."""

    def __init__(self, products: DataFrame, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None, path: str | None = None, mode: str = "pre", tokenizer: Callable[[Column], Column] = tokens, compounds: DataFrame | None = None) -> None:
        self.spark: SparkSession = products.sparkSession
        ship(self.spark)
        self.products = products.withColumn("doc_id", F.col("id").cast("long"))
        self.vectors, self.encode, self.path, self.mode, self.tokenizer, self.compounds = vectors, encode, path, mode, tokenizer, compounds

    # --- index ------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        docs = index.corpus(self.products, "doc_id", "name_normalized", self.tokenizer)
        return docs if self.compounds is None else segmentation.segmented(docs, self.compounds)

    def terms(self, r: Request) -> list[tuple[int, str, int]]:
        """The terms of a query, segmented as the names are."""
        if self.compounds is None:
            return ranking.query_rows({0: r.query})
        asked = index.corpus(self.spark.createDataFrame([(0, r.query.lower())], "id long, text string"), "id", "text", self.tokenizer)
        return ranking.query_rows({0: " ".join(t for row in segmentation.segmented(asked, self.compounds).collect() for t in row["tokens"])})

    def build_index(self) -> index.Index:
        """Builds the index, on disk if the engine has a path."""
        own = index.build(self.documents())
        if not self.path:
            return own
        index.write(own, self.path)
        return index.read(self.spark, self.path)

    def index(self, terms: list[str]) -> index.Index:
        """The index on disk, or one of the given terms made from the names."""
        if self.path:
            return index.read(self.spark, self.path)
        docs = self.documents()
        return index.Index(index.postings(docs, terms, with_length=True), index.lengths(docs), index.stats(docs))

    # --- search -----------------------------------------------------------------------------------

    def condition(self, r: Request) -> Column:
        keep = filters.price_between(F.col("price"), r.min_price, r.max_price)
        return keep & filters.on_platforms(F.col("platform"), r.platforms) if r.platforms else keep

    def ranked(self, scores: DataFrame, r: Request, depth: int) -> DataFrame:
        if not r.filtered:
            return ranking.top(scores, depth)
        return ranking.filtered_top(scores, self.products, self.condition(r), depth, self.mode)

    def bm25_scores(self, r: Request) -> DataFrame:
        terms = self.terms(r)
        return ranking.bm25_scores(self.index([t for _, t, _ in terms]), terms)

    def vector_top(self, r: Request, depth: int) -> DataFrame:
        if self.vectors is None or self.encode is None:
            raise ValueError("vector search needs vectors and an encoder")
        probe = self.spark.createDataFrame([(0, [float(x) for x in self.encode(f"query: {r.query}")])], "query_id long, embedding array<float>")
        if r.filtered and self.mode == "pre":
            allowed = self.vectors.join(self.products.where(self.condition(r)).select("doc_id"), "doc_id", "left_semi")
            return ranking.nearest(allowed, probe, depth)
        found = ranking.nearest(self.vectors, probe, ranking.fetch_depth(depth, r.filtered))
        return self.ranked(found.drop("rank"), r, depth) if r.filtered else found

    def search(self, r: Request, method: str = "hybrid") -> DataFrame:
        """``(rank, doc_id, score)`` and the product's columns, by 'bm25', 'vector' or 'hybrid'."""
        if method == "bm25":
            hits = self.ranked(self.bm25_scores(r), r, r.top_k)
        elif method == "vector":
            hits = self.vector_top(r, r.top_k)
        elif method == "hybrid":
            hits = ranking.fused(self.vector_top(r, 2 * r.top_k), self.ranked(self.bm25_scores(r), r, 2 * r.top_k), r.top_k, r.alpha)
        else:
            raise ValueError(f"no such method: {method}")
        return hits.drop("query_id").join(self.products, "doc_id").orderBy("rank")

    def ready(self, method: str) -> bool:
        return method == "bm25" or method in ("vector", "hybrid") and self.vectors is not None and self.encode is not None

    def find(self, params: dict[str, str]) -> DataFrame:
        """The search that the parameters of an address ask for: ``query, limit, method, alpha, platforms, min_price, max_price``.

        Without what the method needs, or with an index that cannot be read, it is a search for names that hold the text."""
        r, method = request_from(params), params.get("method", "hybrid")
        if self.ready(method):
            try:
                return self.search(r, method)
            except (AnalysisException, ValueError):
                pass
        return self.substring(r)

    def substring(self, r: Request) -> DataFrame:
        """Names that contain the text, without an index."""
        rows = self.products.where(filters.on_platforms(F.col("platform"), r.platforms)) if r.platforms else self.products
        return filters.substring_search(rows, r.query, "name", "doc_id", r.top_k, "price", r.min_price, r.max_price)

    # --- listings and figures -----------------------------------------------------------------------

    def latest(self, limit: int = 50) -> DataFrame:
        return self.products.orderBy(F.col("doc_id").desc()).limit(limit)

    def detail(self, doc_id: int) -> DataFrame:
        return self.products.where(F.col("doc_id") == doc_id)

    def groups(self) -> DataFrame:
        return catalog.price_groups(self.products, "doc_id")

    def stats(self, brands: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
        return stats.totals(self.products, brands, sources, key)

    def learn_compounds(self) -> DataFrame:
        """The compounds of the names, to be given to an engine that segments its names and queries by them."""
        return segmentation.compounds(index.corpus(self.products, "doc_id", "name_normalized", self.tokenizer))

    def build_vectors(self, path: str, encoder: Callable[[list[str]], object], limit: int | None = None) -> DataFrame:
        """The collection of the names' vectors, an earlier one at the path dropped; searches use it from then on."""
        self.vectors = vectors.build(self.products, path, "doc_id", "name_normalized", encoder, limit)
        return self.vectors

    def quality(self, *by: str) -> DataFrame:
        return quality.report(self.products, *by)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def evaluate(self, judged: dict[str, tuple[list[str], list[str]]], methods: tuple[str, ...] = ("bm25",)) -> DataFrame:
        """Mean metrics of each method over queries with their exact and broad phrases."""
        out: DataFrame | None = None
        for method in methods:
            for n, (query, (exact, broad)) in enumerate(judged.items()):
                hits = self.search(Request(query, evaluation.DEPTH), method)
                score = evaluation.relevance(method, F.col("name"), F.array(*map(F.lit, exact)), F.array(*map(F.lit, broad)))
                rows = hits.select(F.lit(method).alias("method"), F.lit(n).alias("query"), "rank", score.alias("relevance"))
                out = rows if out is None else out.unionByName(rows)
        return evaluation.by_method(evaluation.metrics(out, "method", "query"))


def request_from(params: dict[str, str]) -> Request:
    """A request from the string parameters of an address: platforms are separated by commas."""
    number = lambda k: float(params[k]) if params.get(k) not in (None, "") else None
    names = [p.strip() for p in params.get("platforms", "").split(",") if p.strip()]
    return Request(params["query"], int(params.get("limit", 50)), float(params.get("alpha", 0.5)), names, number("min_price"), number("max_price"))


