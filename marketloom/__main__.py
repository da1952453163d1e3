"""``python -m marketloom index|search|latest|quality|stats FOLDER [...]`` over a folder of tables."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from marketloom.engine import Engine, Request
from marketloom.session import local_session, table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="marketloom", description=__doc__)
    p.add_argument("command", choices=["index", "search", "latest", "quality", "stats"])
    p.add_argument("folder", help="a folder with product_items.parquet, brands.parquet and sources.parquet")
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--index", help="where the index is, or is to be written")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--platforms", default="")
    p.add_argument("--min-price", type=float)
    p.add_argument("--max-price", type=float)
    p.add_argument("--method", default="bm25", choices=["bm25", "vector", "hybrid"])
    p.add_argument("--alpha", type=float, default=0.5)
    p.add_argument("--vectors", help="a Parquet table (doc_id, embedding), for vector and hybrid search")
    p.add_argument("--encoder", help="module:function that makes a query's vector, for vector and hybrid search")
    a = p.parse_args(argv)
    spark = local_session()
    vectors = encode = None
    if a.vectors and a.encoder:
        module, _, name = a.encoder.partition(":")
        vectors, encode = spark.read.parquet(a.vectors), getattr(importlib.import_module(module), name)
    engine = Engine(table(spark, a.folder, "product_items"), vectors, encode, path=a.index)
    if a.command == "index":
        engine.build_index().stats.show()
    elif a.command == "search":
        names = [x.strip() for x in a.platforms.split(",") if x.strip()]
        if not engine.ready(a.method):
            p.error(f"{a.method} search needs --vectors and --encoder")
        request = Request(a.query, a.limit, a.alpha, names, a.min_price, a.max_price)
        engine.search(request, a.method).select("rank", "score", "doc_id", "name", "price", "platform").show(a.limit, False)
    elif a.command == "latest":
        engine.latest(a.limit).select("doc_id", "name", "price", "platform").show(a.limit, False)
    elif a.command == "quality":
        engine.quality().show()
    else:
        shops = table(spark, a.folder, "sources").select(F.lower("name").alias("id"), "name")
        engine.stats(table(spark, a.folder, "brands"), shops, "platform").show()
        engine.products.groupBy("platform").count().orderBy("count", ascending=False).show(100, False)


if __name__ == "__main__":
    main()
