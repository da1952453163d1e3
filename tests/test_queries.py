"""All queries against their SQL on the smallest tables, and the layout of the repository."""

import ast
import datetime as dt
import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (dt.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v).tz_localize(None))
    return float(f"{float(v):.9g}") if isinstance(v, (int, float, np.number)) else v


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE:
        assert normal(got) == normal(duck.execute(ORACLE[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "doc_id", "score"]


def test_nothing_outside_imports_llm():
    for f in [*ROOT.glob("marketloom/**/*.py"), *ROOT.glob("tests/*.py"), *ROOT.glob("*.py")]:
        if "llm" in f.relative_to(ROOT).parts or f.name in ("__spark_entry__.py",):
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), f


def test_lookup_prunes(spark, tmp_path):
    """A term's postings come from a scan with its filter pushed down; a projection reads its columns only."""
    from marketloom.operators import index
    from marketloom.plans.queries import names_index
    from marketloom.session import table

    index.write(names_index(spark, FOLDER), str(tmp_path))
    plan = index.lookup(index.read(spark, str(tmp_path)), "điện")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term" in plan
    lean = QUERIES["platform_counts"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<platform:string>" in lean
    assert table(spark, FOLDER, "sources").count() == 60


@pytest.mark.parametrize("name", ["bm25_all_queries", "hybrid_all_queries", "prefilter_all_queries", "postfilter_all_queries"])
def test_every_fiftieth_product_is_a_query(spark, duck, name):
    asked = duck.execute("SELECT CAST(id AS BIGINT) FROM product_items WHERE CAST(id AS BIGINT) % 50 = 0 AND trim(name_normalized) <> ''").fetchall()
    got = {r["query_id"] for r in QUERIES[name](spark, FOLDER).select("query_id").distinct().collect()}
    assert asked and {a for (a,) in asked} <= got
