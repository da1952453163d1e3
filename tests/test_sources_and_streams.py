import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import index
from marketloom.session import reliable_dir
from marketloom.sources import landed, vectors
from marketloom.streaming import ingest


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_jsonl(spark, tmp_path):
    p = tmp_path / "products.jsonl"
    p.write_text('{"source_id": 1, "external_id": "a", "price": "7"}\n\n{broken\n{"source_id": 1, "external_id": 12, "price": 8.5}\n{"source_id": 2, "external_id": "c", "price": "Liên hệ"}\n{"source_id": 1, "external_id": "d", "price": 0}\n')
    df = landed.records(spark, str(p))
    assert sorted((r["external_id"], r["price"]) for r in df.collect()) == [("12", 8.5), ("a", 7.0), ("c", None), ("d", 0.0)]
    assert landed.lines(spark, str(p)).count() == 5
    out = str(tmp_path / "out")
    assert landed.append_new(df, df.where("external_id = 'a'"), out) == 1
    assert landed.append_new(df, landed.records(spark, out), out) == 1
    landed.run_report(df.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["n"] == 4


def test_shop_responses(spark):
    paged = '{"data": [{"id": "1", "name": "n", "url_path": "p1.html", "price": 5, "original_price": 9, "specifications": [{"attributes": [{"name": "k", "value": "v"}, {"name": "k", "value": "w"}]}]}, {"id": "2", "price": 0}]}'
    r = landed.paged_products(values(spark, paged, "<html>"), "https://t.example").collect()
    assert len(r) == 1 and r[0]["external_url"] == "https://t.example/p1.html" and r[0]["specs"] == {"k": "w"} and r[0]["original_price"] == 9
    graph = '{"data": {"products": [{"general": {"product_id": "1", "name": "n", "url_path": "x.html", "categories": [{"name": "c"}, {"name": "d"}]}, "filterable": {"price": 10, "special_price": 8, "thumbnail": "/a.jpg"}}]}}'
    r = landed.graph_products(values(spark, graph), "https://c.example", "https://i.example").first()
    assert (r["price"], r["discount_percent"], r["category"], r["image_url"]) == (8.0, 20, "c", "https://i.example/a.jpg")
    ajax = '{"mods": {"listItems": [{"itemId": "", "nid": "5", "name": "n", "price": "1.990.000 ₫", "itemSoldCntShow": "1,2k", "itemUrl": "//l.example/x"}]}}'
    r = landed.ajax_products(values(spark, ajax), "https://l.example").first()
    assert (r["external_id"], r["price"], r["sold_count"], r["external_url"]) == ("5", 1990000.0, 1200, "https://l.example/x")
    ads = landed.classified_ads(values(spark, '{"ads": [{"list_id": "3", "subject": "s", "price": 4}]}'), "https://a.example/").first()
    assert ads["external_url"] == "https://a.example/3.htm" and ads["brand"] is None


URLSET = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/1 </loc><lastmod>2025-01-01</lastmod></url><url><loc>https://x/1</loc></url><url><loc></loc></url></urlset>'
INDEX = "<sitemapindex><sitemap><loc>https://x/a.xml</loc></sitemap></sitemapindex>"


def test_sitemaps(spark, tmp_path):
    (tmp_path / "u.xml").write_text(URLSET)
    (tmp_path / "i.xml").write_text(INDEX)
    urls = landed.sitemap_urls(spark, str(tmp_path / "u.xml"))
    assert [r["loc"] for r in urls.collect()] == ["https://x/1"] * 2
    assert landed.distinct_urls(urls, urls).count() == 1
    assert [r["loc"] for r in landed.sitemap_index(spark, str(tmp_path / "i.xml")).collect()] == ["https://x/a.xml"]
    got = sorted((r["kind"], r["loc"]) for r in landed.sitemap_texts(values(spark, URLSET, INDEX)).collect())
    assert got == [("index", "https://x/a.xml"), ("urls", "https://x/1"), ("urls", "https://x/1")]


LIST = """<ul><li class="item a" data-id="7" data-price="15990000" data-name="TV &amp; X"><a href="/tv-7.html"><img src="//i/x.jpg"></a></li>
<li class="item"><a href="https://h/b-9.html"><h3> Nồi  cơm </h3></a><strong class="price">1.290.000₫</strong><i style="width: 80%"></i></li><li class="item"><h3>no link</h3></li>"""


def test_pages(spark):
    pages = spark.createDataFrame([(LIST,), (None,), ("",), ("<p>x",)], "html string")
    got = sorted(map(tuple, landed.html_items(pages, ["div.none", "li.item"], "https://s.example").select("external_id", "external_url", "name", "price", "image_url", "rating").collect()))
    assert got == [("7", "https://s.example/tv-7.html", "TV & X", 15990000.0, "https://i/x.jpg", None), ("9", "https://h/b-9.html", "Nồi cơm", 1290000.0, None, 4.0)]
    links = spark.createDataFrame([('<div><a href="/a">Tivi</a><span>1.000.000 ₫</span></div><a href="/b">' + "dài " * 300 + "2.000.000đ</a>",)], "html string")
    assert [tuple(r) for r in landed.html_links(links, "https://s.example").collect()] == [("https://s.example/a", "Tivi", 1000000.0)]
    assert spark.range(1).select(landed.category_id(F.lit('{"categoryId": 12}')).alias("c")).first()["c"] == "12"


def test_a_link_with_several_prices(spark):
    """The smallest name, then the smallest price, whatever the order of the pages."""
    pages = [f'<div><a href="/a">{n}</a> <b>{p}.000₫</b></div>' for n, p in [("b", 1), ("a", 9), ("a", 20), ("a", 3), ("a", 100)]]
    for order in (pages, pages[::-1], pages[2:] + pages[:2]):
        df = spark.createDataFrame([(p,) for p in order], "html string").coalesce(1)
        assert [tuple(r) for r in landed.html_links(df, "https://s.example").collect()] == [("https://s.example/a", "a", 3000.0)]


def test_queries_take_all_rows(spark, tmp_path):
    from marketloom.plans.queries import queries

    own = queries()
    rows = [(1, "b", "u", 5000.0, None), (2, "a", "u", 9000.0, 7000.0), (3, "a", "u", 8000.0, 9000.0), (4, "n", "w", None, 6000.0)]
    df = spark.createDataFrame(rows, "crawl_id long, name string, external_url string, price double, original_price double")
    df.selectExpr("*", "'x' AS brand", "'c' AS category", "'' AS image_url").write.parquet(f"{tmp_path}/crawled_products.parquet")
    assert [tuple(r) for r in own["html_links"](spark, str(tmp_path)).collect()] == [("https://shop.example/u", "a", 8000.0)]
    got = {tuple(r) for r in own["graph_api"](spark, str(tmp_path)).collect()}
    assert got == {("1", 5000.0, None, "c"), ("2", 9000.0, None, "c"), ("3", 8000.0, 9000.0, "c"), ("4", 6000.0, None, "c")}


def test_keywords_and_categories(spark):
    now = F.lit(dt.datetime(2025, 1, 2)).cast("timestamp")
    data = [(1, "b", "c", 1, True, ["all"], None), (2, "a", "c", 1, True, ["tiki"], dt.datetime(2025, 1, 1, 23)), (3, "z", "d", 0, True, ["lazada"], None), (4, "n", "c", 0, True, None, None), (5, "off", "c", 0, False, ["all"], None)]
    df = spark.createDataFrame(data, "id int, keyword string, category string, priority int, is_active boolean, applies_to array<string>, last_crawled_at timestamp")
    assert [r["keyword"] for r in landed.keywords(df, "tiki", now).collect()] == ["a", "b"]
    assert [r["keyword"] for r in landed.keywords(df, "tiki", now, hours=24).collect()] == ["b"]
    assert [r["keyword"] for r in landed.keywords(df, "all", now, "d").collect()] == ["z"]
    cats = spark.createDataFrame([(1, True, None), (2, True, 5), (3, True, 6), (4, False, None)], "id int, is_active boolean, source_id int")
    assert sorted(r["id"] for r in landed.categories(cats, 5).collect()) == [1, 2]
    assert [r["id"] for r in landed.categories(cats, 5, spark.createDataFrame([("1",)], "category_id string")).collect()] == [2]


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "d")], "id long, name string")
    v = vectors.encoded(df, "id", "name", lambda texts: np.array([[len(t), 0.0] for t in texts]), batch=1)
    assert sorted((r["doc_id"], r["name"], r["embedding"]) for r in v.collect()) == [(1, "abc", [1.0, 0.0]), (4, "d", [1.0, 0.0])]
    assert vectors.upserted(v, v.where("doc_id = 4").withColumn("name", F.lit("new"))).where("name = 'new'").count() == 1
    path = str(tmp_path / "v")
    v.write.parquet(path)
    assert vectors.exists(spark, path) and vectors.ids(v).count() == 2
    vectors.drop(spark, path)
    assert not vectors.exists(spark, path)


def test_streams(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, seq int").coalesce(1).write.parquet(base + "/in")
    spark.createDataFrame([(1, "c", 3), (2, "d", 4)], "k int, v string, seq int").coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema("k int, v string, seq int").option("maxFilesPerTrigger", 1).parquet(base + "/in")
    ingest.run_once(lambda: ingest.upsert_batches(stream, base + "/out", ["k"], "seq"), base + "/cp")
    assert {r["k"] for r in ingest.current(spark, base + "/out", ["k"]).collect()} == {1, 2}
    docs = spark.createDataFrame([(1, ["a", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    docs.write.parquet(base + "/docs")
    tokens = spark.readStream.schema(docs.schema).parquet(base + "/docs")
    ingest.run_once(lambda: ingest.index_batches(tokens, base + "/idx"), base + "/cp2")
    assert sorted(map(tuple, index.merged(spark.read.parquet(base + "/idx").drop("part")).collect())) == [("a", 1, 2), ("b", 2, 1)]


def test_event_time(spark, tmp_path):
    base = str(tmp_path)
    at = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    e = spark.createDataFrame([("a", at(1, 0)), ("a", at(1, 10)), ("a", at(3, 0)), ("b", at(1, 0))], "k string, ts timestamp")
    batch = sorted((r["k"], r["n"]) for r in ingest.sessions(e, "ts", "k", "30 minutes").collect())
    assert batch == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r["k"], r["n"]) for r in ingest.windowed_counts(e, "ts", "k", "1 hour").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    e.write.parquet(base + "/e")
    stream = spark.readStream.schema(e.schema).parquet(base + "/e")
    ingest.run_once(lambda: ingest.first_seen(stream, "ts", ["k"]).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(base + "/o")), base + "/cp")
    assert spark.read.parquet(base + "/o").count() == 2


def test_reliable_dir(spark):
    assert reliable_dir(spark) == reliable_dir(spark)
