import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.operators import catalog, crawl_state, evaluation, filters, index, quality, ranking, skewed_keys, stats, tree, unit_conversion, upsert

T = dt.datetime


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def own(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "c c c c d_e"), (6, "a")], "doc_id long, text string")
    return index.build(index.corpus(df, "doc_id", "text"))


def test_index(spark, own, tmp_path):
    assert rows(own.postings.select("term", "doc_id", "tf")) == [("a", 1, 2), ("a", 6, 1), ("b", 1, 1), ("b", 2, 1), ("c", 2, 1), ("c", 5, 4), ("d_e", 5, 1)]
    assert own.stats.first().asDict() == {"n_docs": 4, "total_length": 11, "avgdl": 2.75}
    index.write(own, str(tmp_path))
    back = index.read(spark, str(tmp_path))
    assert rows(index.lookup(back, "c")) == [(2, 1), (5, 4)] and index.lookup(back, "zz").count() == 0
    terms = [r["term"] for r in back.postings.coalesce(1).collect()]
    assert terms == sorted(terms)
    assert rows(index.merged(own.postings.where("doc_id < 3"), own.postings.where("doc_id >= 3"))) == rows(own.postings.drop("dl"))
    empty = index.build(index.corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text"))
    assert empty.stats.first().asDict() == {"n_docs": 0, "total_length": 0, "avgdl": 0.0}


def test_bm25_of_many_queries(spark):
    """Blocks of one query, several partitions: the same as scores of all pairs, ranked."""
    docs = spark.createDataFrame([(i, [w for j, w in enumerate("a b c d e".split()) if i * 7 % (j + 2) == 0 for _ in range(1 + i % (j + 1))]) for i in range(60)], "doc_id long, tokens array<string>").repartition(3)
    asked = docs.where("doc_id % 12 = 0").withColumnRenamed("doc_id", "query_id")
    terms = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    own = index.build(docs)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())
    assert key(ranking.bm25_many(docs, asked, 4, block=1)) == key(ranking.bm25(own, terms, 4)) != []
    few = docs.where("doc_id % 3 = 1").select("doc_id")
    assert key(ranking.bm25_many(docs, asked, 4, few)) == key(ranking.filtered_top(ranking.bm25_scores(own, terms), docs, F.expr("doc_id % 3 = 1"), 4))
    assert ranking.bm25_many(docs, asked.limit(0), 4).count() == 0


def test_bm25_by_formula(spark, own):
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.bm25(own, ranking.query_terms(spark, {1: "A a zz", 2: "c"})).collect()}
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    part = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2.75))
    want = {(1, 1): 2 * part(2, 3), (1, 6): 2 * part(1, 1), (2, 2): part(1, 2), (2, 5): part(4, 5)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    joined = index.Index(own.postings.drop("dl"), own.lengths.where("doc_id <> 6"), own.stats)
    without = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.bm25(joined, ranking.query_terms(spark, {1: "A a zz", 2: "c"})).collect()}
    assert math.isclose(without[1, 1], want[1, 1]) and math.isclose(without[1, 6], 2 * part(1, 0))  # a missing length is 0
    pruned = index.postings(index.corpus(spark.createDataFrame([(1, "a b")], "i long, t string"), "i", "t"), ["b"])
    assert rows(pruned) == [("b", 1, 1)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.6, 0.8]), (5, None)], "doc_id long, embedding array<float>")
    q = v.where("doc_id in (1, 4)").withColumnRenamed("doc_id", "query_id")
    got = [(r["query_id"], r["doc_id"], round(r["score"], 5)) for r in ranking.nearest(v, q, 2, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 2, 1.0), (4, 4, 1.0), (4, 1, 0.6)]
    assert ranking.nearest(v, q.limit(0)).count() == 0
    cos = v.select("doc_id", ranking.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).where("doc_id = 3").first()["s"]
    assert cos == 0.0


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (2, 10, 0.3)], "query_id int, doc_id long, score double")
    t = spark.createDataFrame([(1, 11, 7.0), (1, 12, 7.0)], "query_id int, doc_id long, score double")
    got = {(r["query_id"], r["doc_id"]): (round(r["score"], 6), r["rank"]) for r in ranking.hybrid(v, t, 10, 0.5).collect()}
    assert got == {(1, 10): (0.5, 1), (1, 11): (0.5, 2), (1, 12): (0.5, 3), (2, 10): (0.5, 1)}
    assert ranking.hybrid(v.limit(0), t, 10, 0.0).count() == 2
    assert ranking.fetch_depth(10, True) == 200 and ranking.fetch_depth(100, True) == 1000 and ranking.fetch_depth(7, False) == 7


def test_filter_modes(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(300)], "query_id int, doc_id long, score double")
    p = spark.createDataFrame([(i, float(i)) for i in range(300)], "doc_id long, price double")
    pre = {r["doc_id"] for r in ranking.filtered_top(s, p, F.col("price") < 105, 10, "pre").collect()}
    post = {r["doc_id"] for r in ranking.filtered_top(s, p, F.col("price") < 105, 10, "post").collect()}
    assert pre == set(range(95, 105)) and post == set(range(100, 105))


def test_filters(spark):
    df = spark.createDataFrame([(1, "Tiki", 5.0, "A tv"), (2, None, None, "B TV"), (3, "Điện máy xanh", 50.0, None), (4, "x", 7.0, "tv")], "id long, platform string, price double, name string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(df.where(filters.on_platforms(F.col("platform"), ["TIKI", "dienmayxanh"]))) == [1, 3]
    assert ids(df.where(filters.price_between(F.col("price"), 0, 10))) == [1, 4]
    assert ids(df.where(filters.price_between(F.col("price")))) == [1, 2, 3, 4]
    assert ids(filters.substring_search(df, "Tv", "name", "id", 2, "price", 6, 10)) == [2, 4]
    assert ids(filters.with_ids(df, spark.createDataFrame([("1",), ("x",), (None,)], "id string"))) == [1]
    now = F.lit(T(2025, 1, 2)).cast("timestamp")
    assert one_col(spark, filters.stale(F.lit(T(2025, 1, 1)).cast("timestamp"), now, 24)) is False
    assert one_col(spark, filters.stale(F.lit(None).cast("timestamp"), now, 24)) is True
    assert one_col(spark, filters.applies_to(F.lit(None).cast("array<string>"), "tiki")) is False
    assert one_col(spark, filters.applies_to(F.array(F.lit("all")), "tiki")) is True


def one_col(spark, c):
    return spark.range(1).select(c.alias("r")).first()["r"]


def test_price_groups(spark):
    schema = "seq long, id string, name string, name_normalized string, price double, original_price double, discount_percent double, platform string, external_url string, image_url string, available boolean, rating double, review_count long"
    data = [
        (1, "1", "A X", "a x", 0.0, None, None, "p1", None, "i1", True, None, None), (2, "2", "A X", "a x", 5.0, None, None, "p2", "u", "i2", None, 4.0, 3), (3, "3", "a x", None, 5.0, None, None, "p3", "u", "i3", True, 2.0, 1),
        (4, "4", " ", "", 1.0, None, None, "p", None, None, None, None, None), (5, "5", "Lone", "lone", None, None, None, "p", None, "i", None, None, None),
    ]
    df = spark.createDataFrame(data, schema)
    assert rows(catalog.price_groups(df, "seq").select("group_key", "best_platform", "n_offers")) == [("a x", "p3", 3), ("lone", "p", 1)]
    assert [(r["group_key"], r["id"]) for r in catalog.price_offers(df, "seq").collect()] == [("a x", "1"), ("a x", "2"), ("a x", "3"), ("lone", "5")]
    out = {r["group_key"]: r for r in catalog.page_groups(df, "seq").collect()}
    assert set(out) == {"a x", "lone"}
    g = out["a x"]
    assert (g["canonical_name"], g["image_url"], g["best_price"], g["best_platform"], g["avg_rating"], g["total_reviews"], g["product_ids"]) == ("A X", "i1", 5.0, "p3", 2.0, 4, ["1", "2", "3"])
    assert (out["lone"]["best_price"], out["lone"]["avg_rating"]) == (0.0, None)
    assert rows(catalog.savings(df)) == [("a x", 3, 5.0), ("lone", 1, 0.0)]


def test_quality(spark):
    names = ["", "  ", None, "nine char", "ten chars!", "long enough name", "long enough name", "long enough name"]
    prices = [1.0, 1.0, 1.0, 1.0, 1e9, 1e9 + 1, 0.0, None]
    df = spark.createDataFrame([(n, p, "http://i", "ftp://u" if k == 4 else "https://u") for k, (n, p) in enumerate(zip(names, prices))], "name string, price double, image_url string, external_url string")
    r = quality.report(df).first().asDict()
    assert r == {"total": 8, "missing_name": 3, "short_name": 1, "missing_price": 1, "invalid_price": 2, "missing_image": 0, "missing_url": 1, "good": 1, "good_rate": 12.5}
    assert quality.report(df.limit(0)).first()["good_rate"] is None
    lines = spark.createDataFrame([('{"name": "long enough name", "price": 5, "image_url": "http://i", "external_url": "http://u"}',), ("{broken",), (" ",)], "value string")
    r = quality.report_of_lines(lines, "name string, price double, image_url string, external_url string").first()
    assert (r["total"], r["good"], r["good_rate"]) == (2, 1, 50.0)


def test_upserts(spark):
    known = spark.createDataFrame([(1, "a", 1.0, "x"), (2, None, 2.0, "y")], "source_id int, external_id string, price double, name string")
    batch = spark.createDataFrame([(1, "a", 9.0, "n", 1), (1, "a", 8.0, "m", 2), (2, None, 7.0, "z", 3), (3, "c", 6.0, "c", 4)], "source_id int, external_id string, price double, name string, seq int")
    keys = ["source_id", "external_id"]
    done = upsert.upsert(known, batch, keys, "seq")
    assert rows(done) == [(1, "a", 8.0, "m"), (2, None, 7.0, "z"), (3, "c", 6.0, "c")]
    assert rows(upsert.upsert(done, batch, keys, "seq")) == rows(done)
    assert tuple(upsert.upsert_counts(known, batch, keys).first()) == (1, 2)
    assert rows(upsert.update_columns(known, upsert.last_wins(batch, keys, "seq").drop("seq"), keys, ["price"])) == [(1, "a", 8.0, "x"), (2, None, 7.0, "y"), (3, "c", 6.0, "c")]
    assert rows(upsert.insert_ignore(known, batch, keys, "seq")) == [(1, "a", 1.0, "x"), (2, None, 2.0, "y"), (3, "c", 6.0, "c")]
    assert rows(upsert.first_wins(batch, keys, "seq").select("price")) == [(6.0,), (7.0,), (9.0,)]


def test_crawl_state(spark):
    now = F.lit(T(2025, 1, 3)).cast("timestamp")
    data = [(1, "k1", "completed", T(2025, 1, 2), T(2025, 1, 2)), (2, "k1", "in_progress", T(2025, 1, 2, 5), None), (3, "k2", "completed", T(2025, 1, 2), T(2025, 1, 2)), (4, "k3", "failed", T(2024, 1, 1), T(2024, 1, 1)), (5, "k4", "pending", None, None)]
    logs = spark.createDataFrame(data, "id long, item string, status string, started_at timestamp, ended_at timestamp")
    place = {r["item"]: r["place"] for r in crawl_state.queue(crawl_state.progress(logs, ["item"]), now, 24).collect()}
    assert place == {"k1": "in_progress", "k2": "recently_completed", "k3": "pending", "k4": "pending"}
    order = [r["item"] for r in crawl_state.queue(crawl_state.progress(logs, ["item"]), now, 24).where("place = 'pending'").orderBy(*crawl_state.pending_order()).collect()]
    assert order == ["k4", "k3"]
    recent = crawl_state.recent(logs, now, 24)
    items = spark.createDataFrame([("k1",), ("k2",), ("k9",)], "k string")
    assert rows(crawl_state.uncrawled(items, F.col("k"), recent, F.col("item"))) == [("k9",)]
    assert rows(crawl_state.to_skip(items, F.col("k"), recent, F.col("item"))) == [("k1",), ("k2",)]
    assert one_col(spark, crawl_state.item_key(F.lit(""), F.lit(7))) == "7" and one_col(spark, crawl_state.item_key(F.lit(None).cast("string"), F.lit(None).cast("int"))) == "general"
    assert one_col(spark, crawl_state.run_status(F.lit(3), F.lit(1))) == "partial"


def test_crawl_log(spark):
    now = F.lit(T(2025, 1, 3)).cast("timestamp")
    runs = spark.createDataFrame([(1, 7, "k", None), (2, 7, None, 5), (3, 7, "z", None)], "id long, source_id int, keyword string, category_id long")
    counts = spark.createDataFrame([(1, 5, 3, 2, 0), (2, 0, 0, 0, 1)], "id long, total_items long, new_items long, updated_items long, errors long")
    got = {r["id"]: (r["status"], r["new_items"], r["ended_at"]) for r in crawl_state.closed(crawl_state.opened(runs, now), counts, now).collect()}
    assert got == {1: ("completed", 3, T(2025, 1, 3)), 2: ("failed", 0, T(2025, 1, 3)), 3: ("running", None, None)}


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "máy hút bụi"), (2, None)], "i long, t string")
    joined = index.corpus(df, "i", "t", index.python_tokenizer(lambda t: [t.replace(" ", "_")]))
    assert rows(index.postings(joined)) == [("máy_hút_bụi", 1, 1)]


def test_tree(spark):
    cats = spark.createDataFrame([(1, "a", "a", 0, None), (2, "b", "b", 1, 1), (3, "c", "b", 2, 2), (4, "d", "d", 0, None), (8, "x", "x", 1, 9), (9, "y", "y", 1, 8)], "id int, name string, slug string, level int, parent_id int")
    got = [(r["id"], r["depth"]) for r in tree.flattened(cats).orderBy("path").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 0)]
    assert rows(tree.leaves(cats).select("id")) == [(3,), (4,)]
    assert {r["id"] for r in tree.crawl_targets(cats).collect()} == {1, 3, 4}
    assert tree.node_count(cats).first()[0] == 4
    kind = "id int, name string, slug string, level int"
    nodes = spark.createDataFrame([(1, "a", "a", 0, [(2, "b", "b", 1, [(3, "c", "c", 2)])])], f"{kind}, children array<struct<id: int, name: string, slug: string, level: int, children: array<struct<id: int, name: string, slug: string, level: int>>>>")
    assert rows(tree.from_nodes(nodes).select("id", "parent_id")) == [(1, None), (2, 1), (3, 2)]


def test_metrics(spark):
    judged = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.5), (2, 1, 0.0)], "q int, rank int, relevance double")
    out = {r["q"]: r for r in evaluation.metrics(judged, "q").collect()}
    dcg = 1 / math.log2(3) + (2**0.5 - 1) / 2
    ideal = 1 + (2**0.5 - 1) / math.log2(3)
    assert (out[1]["p10"], out[1]["mrr"]) == (0.2, 0.5) and math.isclose(out[1]["ndcg"], dcg / ideal)
    assert tuple(out[2])[1:] == (0.0, 0.0, 0.0)


def test_stats(spark):
    products = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 9)], "id long, source_id int")
    sources = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert rows(stats.distribution(products, sources)) == [("a", 2), ("b", 0)]
    assert rows(stats.shares(stats.distribution(products, sources))) == [("a", 2, 100.0)]
    assert tuple(stats.totals(products, sources, sources).first()) == (4, 2, 1)
    assert tuple(stats.totals(products.limit(0), sources, sources).first()) == (0, 2, 2)
    bad = spark.createDataFrame([("x",)], "v string").select(F.raise_error(F.col("v")).alias("e"))
    got = {r["source"]: (r["status"], r["n"]) for r in stats.per_source({"a": products, "b": bad.where("e is not null")}).collect()}
    assert got["a"] == ("ok", 4) and got["b"][0] in ("failed", "ok")


@pytest.mark.parametrize("share", [0.02, 0.4, 2.0])
def test_skewed_keys(spark, share):
    """Salted results equal plain ones, whatever counts as heavy."""
    data = [(i, 1 if i % 3 else i % 7, f"e{i % 5}" if i % 2 else "hot", [10.0, None, -1.0, float("nan"), 12.5][i % 5], T(2025, 1, 1 + i % 3) if i % 11 else None) for i in range(600)] + [(7, None, None, 3.0, None)] * 2
    df = spark.createDataFrame([(*r, "x", 5) for r in data], "record_id long, source_id int, external_id string, price double, crawled_at timestamp, salts string, n int")
    own = {}
    for rid, s, e, p, at in data:
        g = own.setdefault(s, [0, [], {}])
        g[0] += 1
        if p and p > 0:
            g[1].append(p)
        key = (at or T.min, rid)
        g[2][e] = max(g[2].get(e, (T.min, -1)), key)
    got = {r["source_id"]: r for r in skewed_keys.price_stats(df, share=share).collect()}
    assert {k: (r["n_rows"], r["n_prices"], r["sum_price"]) for k, r in got.items()} == {k: (g[0], len(g[1]), sum(g[1]) if g[1] else None) for k, g in own.items()}
    latest = {(r["source_id"], r["external_id"]): r["record_id"] for r in skewed_keys.latest(df, ["source_id", "external_id"], "record_id", "crawled_at", ["price"], share).collect()}
    assert latest == {(s, e): k[1] for s, g in own.items() for e, k in g[2].items()}
    items = {r["source_id"]: r["n_items"] for r in skewed_keys.distinct_items(df, share=share).collect()}
    assert items == {s: len(set(g[2]) - {None}) for s, g in own.items()}
    assert skewed_keys.price_stats(df.limit(0)).count() == 0
    assert skewed_keys.heavy_keys(df, "source_id", share=0.02).count() < 50


def test_unit_conversion(spark):
    specs = lambda **k: {a.replace("_", " "): b for a, b in k.items()}
    data = [(i, f"Cà phê {200 + i} g", None, "coffee") for i in range(200)] + [(1000 + i, "Cà phê", specs(Weight=str(0.2 + i / 1000)), "coffee") for i in range(20)]
    data += [(2000, "Gạo", specs(Weight="5"), "rice"), (2001, None, None, None), (2002, "", {}, "x"), (2003, "TV 32 in", specs(Power="0"), "tv"), (2004, "x" * 200_000 + " 5 kg", None, "y"), (2003, "TV 32 in", None, "tv")]
    df = spark.createDataFrame([(*r, "q") for r in data], "crawl_id long, name string, specs map<string,string>, category string, quantity string")
    out = unit_conversion.converted(df).collect()
    got = {}
    for r in out:
        got.setdefault((r["crawl_id"], r["quantity"]), []).append(r)
    assert got[0, "mass"][0]["amount"] == 200 and not got[0, "mass"][0]["flagged"]
    for i in range(20):  # kilograms without a unit
        r = got[1000 + i, "mass"][0]
        assert abs(r["amount"] - (200 + i)) < 1e-6 and r["posterior"] > 0.9
    assert (2000, "mass") in got and len(got[2003, "length"]) == 2 and got[2004, "mass"][0]["amount"] == 5000
    assert {k[0] for k in got} & {2001, 2002} == set()
    assert unit_conversion.found(df.limit(0)).count() == 0
    assert unit_conversion.flagged(spark.createDataFrame([(1, None, {"Power": "7"}, None)], df.drop("quantity").schema)).first()["posterior"] == 0.0


def test_deep_trees_and_cycles(spark):
    """A tree of 30 levels; rows in a cycle hang below no top and are in no tree; an id met again on its own path ends."""
    deep = [(i, f"n{i}", i - 1 if i else None) for i in range(30)] + [(100, "a", 101), (101, "b", 100)]
    out = {r["id"]: r for r in tree.flattened(spark.createDataFrame(deep, "id int, name string, parent_id int")).collect()}
    assert len(out) == 30 and out[29]["depth"] == 29 and list(out[29]["path"]) == list(range(30))
    again = spark.createDataFrame([(1, "a", None), (2, "b", 1), (1, "a", 2)], "id int, name string, parent_id int")
    assert sorted(r["depth"] for r in tree.flattened(again).collect()) == [0, 1]
    assert tree.flattened(spark.createDataFrame([], "id int, name string, parent_id int")).count() == 0


def test_nested_categories_of_any_depth(spark):
    kind = "id int, name string, slug string, level int"
    for n in range(4, -1, -1):
        kind = f"id int, name string, slug string, level int, children array<struct<{kind}>>" if n else kind
    node = (5, "e", "e", 4)
    for i in range(4, 0, -1):
        node = (i, chr(96 + i), chr(96 + i), i - 1, [node])
    rows = tree.from_nodes(spark.createDataFrame([node], kind)).select("id", "parent_id").collect()
    assert sorted((r[0], r[1] or 0) for r in rows) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_persisted_index(spark, tmp_path):
    """Written once, whole; the scan of a search gets the terms and reads no text."""
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c", "c"])], "doc_id long, tokens array<string>")
    made = []
    own = lambda: index.persisted(spark, f"{tmp_path}/i", lambda: made.append(1) or index.build(docs))
    first, second = own(), own()
    assert len(made) == 1 and first is second and first.figures == (3.0, 5 / 3)
    got = {tuple(r) for r in ranking.top(ranking.bm25_scores(first, ranking.query_rows({7: "A a c"})), 5).select("query_id", "doc_id", "rank").collect()}
    want = {tuple(r) for r in ranking.top(ranking.bm25_scores(index.build(docs), ranking.query_terms(spark, {7: "A a c"})), 5).select("query_id", "doc_id", "rank").collect()}
    assert got == want and len(got) == 3
    plan = ranking.bm25_scores(first, ranking.query_rows({7: "a"}))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,a)" in plan or "In(term" in plan


def test_many_query_terms_are_joined(spark):
    docs = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(1500)], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(i, f"t{i}", 1) for i in range(1400)], "query_id int, term string, weight int")
    assert ranking.bm25_scores(index.build(docs), asked).count() == 2 * 1400 - 1


def test_segmentation(spark):
    from marketloom.operators import segmentation

    docs = spark.createDataFrame([(i, ["máy", "giặt", w]) for i, w in enumerate(["xanh", "đỏ", "tím", "vàng", "nâu", "lục"])] + [(50, []), (51, ["máy", "may"])], "doc_id long, tokens array<string>")
    pairs = segmentation.compounds(docs, 5, 0.4)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [("máy", "giặt")]
    out = {r["doc_id"]: list(r["tokens"]) for r in segmentation.segmented(docs, pairs).collect()}
    assert out[0] == ["máy_giặt", "xanh"] and out[50] == [] and out[51] == ["máy", "may"] and len(out) == 8


def test_numbers_need_a_bound(spark):
    with pytest.raises(ValueError):
        catalog.numbered(spark.range(3).toDF("id"), [F.col("id")])
    assert [r["number"] for r in catalog.numbered(spark.range(9).toDF("id"), [F.col("id").desc()], limit=2).collect()] == [1, 2]


def test_nearest_keeps_ties_in_order(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)], "doc_id long, embedding array<float>")
    probe = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in ranking.nearest(vectors, probe, 4).collect()}
    assert [got[0, k] for k in (1, 2, 3, 4)] == [0, 3, 6, 9] and [got[1, k] for k in (1, 2, 3, 4)] == [2, 5, 8, 11]


def test_generations_only_on_phones(spark):
    from marketloom.functions.units import in_name

    assert in_name("ca phe goi 3g x 10") == {"mass": 3.0} and in_name("muoi 6g") == {"mass": 6.0}
    assert in_name("dien thoai orbit 5g 128g") == {} and in_name("orbit 5g", phone=True) == {}


def test_mixture_on_specs_without_units(spark):
    """Specifications lose their units; the mixture gives them back, types that state nothing are fitted together."""
    rows = [(i, "nồi", {"Công suất (kW)" if i % 3 == 0 else "Công suất": "1,8" if i % 3 == 0 else f"{1700 + i % 7 * 40} W"}, "nồi") for i in range(300)]
    rows += [(1000 + i, "x", {"Công suất": "1750"}, f"lone{i}") for i in range(3)] + [(2000, None, None, None), (2001, "y", {}, "z")]
    df = spark.createDataFrame(rows, "crawl_id long, name string, specs map<string,string>, category string")
    out = unit_conversion.inferred(df).collect()
    assert len(out) > 100 and all(abs(r["amount"] - r["stated"]) < 20 for r in out)
    got = {r["crawl_id"]: r for r in unit_conversion.converted(df).collect()}
    assert all(abs(got[1000 + i]["amount"] - 1750) < 1 for i in range(3)) and 2000 not in got
    assert unit_conversion.inferred(df.limit(0)).count() == 0
