import pytest

from marketloom.__main__ import main
from marketloom.engine import Engine, Request, request_from

COLUMNS = "id string, name string, name_normalized string, price double, platform string, image_url string, external_url string, original_price double, discount_percent double, available boolean, rating double, review_count long"


@pytest.fixture
def engine(spark, tmp_path):
    rows = [("1", "Tivi đỏ", "tivi đỏ", 5.0, "tiki"), ("2", "Tivi xanh", "tivi xanh", 9.0, "Điện máy xanh"), ("3", "Nồi cơm", "nồi cơm", None, "tiki"), ("4", "Tivi", "tivi", 0.0, None), ("5", "x", None, 1.0, "tiki")]
    products = spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], COLUMNS)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "doc_id long, embedding array<float>")
    return Engine(products, vectors, lambda q: [1.0, 0.0], str(tmp_path / "index"))


def ids(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_search(engine):
    engine.build_index()
    assert ids(engine.search(Request("Tivi"), "bm25")) == [4, 1, 2]
    assert ids(engine.search(Request("tivi", platforms=["dienmayxanh"]), "bm25")) == [2]
    assert ids(engine.search(Request("tivi", min_price=0), "bm25")) == [4, 1, 2]
    assert ids(engine.search(Request("tivi", max_price=5.0, top_k=1), "bm25")) == [4]
    assert ids(engine.search(Request("xyzzy"), "bm25")) == []
    assert ids(engine.search(Request("q", top_k=2), "vector")) == [1, 3]
    assert ids(engine.search(Request("q", min_price=6), "vector")) == [2]
    assert ids(engine.search(Request("tivi xanh", alpha=0.0), "hybrid"))[0] == 2
    assert ids(engine.search(Request("tivi xanh", alpha=1.0), "hybrid"))[0] == 1
    with pytest.raises(ValueError):
        engine.search(Request("q"), "other")


def test_other_calls(spark, engine):
    assert [r["doc_id"] for r in engine.substring(Request("TIVI", min_price=1)).collect()] == [1, 2]
    assert [r["doc_id"] for r in engine.latest(2).collect()] == [5, 4]
    assert engine.detail(3).count() == 1 and engine.detail(99).count() == 0
    assert engine.groups().count() == 5
    assert engine.quality().first()["total"] == 5
    engine.build_index()
    m = engine.evaluate({"tivi": (["tivi"], ["tivi"]), "nồi cơm": (["nồi"], ["nồi"])}).first()
    assert (m["p10"], m["mrr"], m["ndcg"]) == (0.2, 1.0, 1.0)
    r = request_from({"query": "a", "platforms": "tiki, x ,", "min_price": "0", "max_price": ""})
    assert (r.top_k, r.platforms, r.min_price, r.max_price, r.filtered) == (50, ["tiki", "x"], 0.0, None, True)


def test_without_an_index_on_disk(engine):
    other = Engine(engine.products.drop("doc_id"))
    assert ids(other.search(Request("tivi"), "bm25")) == [4, 1, 2]


def test_command_line(spark, capsys, tmp_path):
    main(["index", "/root/testdata/sf0.001", "--index", str(tmp_path / "i")])
    main(["search", "/root/testdata/sf0.001", "nồi cơm điện", "--index", str(tmp_path / "i"), "--limit", "3"])
    assert "nồi cơm" in capsys.readouterr().out.lower()


def test_find_and_vectors(engine, spark, tmp_path):
    engine.build_index()
    assert ids(engine.find({"query": "Tivi", "method": "bm25", "limit": "2"})) == [4, 1]
    assert ids(engine.find({"query": "tivi xanh", "alpha": "0"}))[0] == 2
    assert [r["doc_id"] for r in engine.find({"query": "TIVI", "method": "odd", "max_price": "6"}).collect()] == [1, 4]
    bare = Engine(engine.products, path=str(tmp_path / "nothing"))
    assert [r["doc_id"] for r in bare.find({"query": "nồi", "method": "bm25"}).collect()] == [3]  # no index there
    made = engine.build_vectors(str(tmp_path / "v"), lambda t: [[len(x), 1.0] for x in t], limit=2)
    assert sorted(r["doc_id"] for r in made.collect()) == [1, 2] and made.columns == ["doc_id", "name", "embedding"]


def test_compounds_in_names_and_queries(spark):
    rows = [(str(i), f"máy giặt {c}", f"máy giặt {c}", 1.0, "tiki") for i, c in enumerate("abcdef")] + [("9", "giặt máy", "giặt máy", 1.0, "tiki")]
    products = spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], COLUMNS)
    own = Engine(products, compounds=Engine(products).learn_compounds())
    assert [t for _, t, _ in own.terms(Request("Máy giặt b"))] == ["máy_giặt", "b"]
    assert ids(own.search(Request("máy giặt b"), "bm25"))[0] == 1 and 9 not in ids(own.search(Request("máy giặt"), "bm25"))
