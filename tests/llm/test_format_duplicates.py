import itertools
import re

from marketloom.llm import format_duplicates as fd

URL = "https://a.example/x-p1.html?sku=1&spid=2"


def test_same_name():
    assert fd.same_name("Dây sạc GX Max, 300 cm", "300  CM - DÂY\tSẠC GX MAX")
    assert fd.same_name("3,600 ml, pink, Dish Terra", "pink | 3,600 ml | Dish Terra")
    assert fd.same_name("JT.61561 850 W", " jt61561 850 w!")
    assert fd.same_name("Bot Giat Balgulul, Mobile 3kg | Neo", "neo / bot giat balgulul mobile 3kg")
    assert not fd.same_name("TV 12345", "TV 12354")
    assert not fd.same_name("a", "a b")
    assert not fd.same_name("kg 12", "12 gk")
    assert fd.same_name("", " -- ")


def test_same_name_with_many_fields_that_fit():
    """Fields that are prefixes of one another: the search tries each state once and has no limit of steps."""
    p, q, r, t = ["ab"] * 12, ["ab" * 6 + "c"], ["de"] * 12, ["de" * 6 + "f"]
    join = " | ".join
    assert fd.same_name(join(p + q + t + r), join(q + p + r + t))
    assert not fd.same_name(join(p + q + t + r), join(q + p + r + ["de" * 6 + "g"]))
    assert not fd.same_name(join(p + q + ["xy"]), join(q + p + ["yx"]))


def test_same_url():
    assert fd.same_url(URL, "HTTPS://A.EXAMPLE/x_p1.html/?spid=2&sku=1/#")
    assert not fd.same_url(URL, "https://a.example/x-p1.html?sku=12&spid=")
    assert not fd.same_url(URL, "https://a.example/x-p1.html?sku=2&spid=1")
    assert not fd.same_url(URL, "https://a.example/x-p1.html")


def canonical(name, url):
    """A plain path for tests: sorted fields, sorted parameters."""
    fold = lambda s: re.sub(r"[\W_]", "", s.lower())
    path, _, tail = url.partition("?")
    return tuple(sorted(fold(f) for f in re.split(r"[|;]|\s[-/]\s|,\s", name) if fold(f))), fold(path), tuple(sorted(re.sub(r"[^\w=]", "", p.lower()) for p in tail.split("&") if p))


def test_pairs(spark, crawled):
    names = ["Nồi cơm X1 - 2L", "2l | NỒI CƠM X1", "Nồi  cơm x1, 2L", "Nồi cơm X1 - 3L", "nồi cơm X1 2L", None, ""]
    urls = [URL, "https://A.example/X_p1.html?spid=2&sku=1", "https://a.example/x-p1.html?sku=1&spid=3", None]
    rows = [{"crawl_id": i, "name": n, "external_url": u, "copies": "z", "rep": "r", "id": "q"} for i, (n, u) in enumerate(itertools.product(names, urls * 2))]
    df = crawled(rows)
    own = {r["crawl_id"]: r for r in rows if r["name"] is not None and r["external_url"] is not None}
    key = {i: (re.sub(r"[\W_]", "", "".join(sorted(r["name"].lower()))), canonical("", r["external_url"])) for i, r in own.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(own), 2) if key[a] == key[b]}
    got = [tuple(r) for r in fd.pairs(fd.members(df)).collect()]
    assert set(got) == want and len(got) == len(want)
    out = fd.collapsed(df)
    assert out.columns == [*[c for c in df.columns if c != "copies"], "copies"]
    assert sum(r["copies"] for r in out.collect()) == len(rows)
    assert fd.members(df.limit(0)).count() == 0


def test_colliding_records_are_told_apart(spark, crawled):
    """Anagrams share all hashes; each record gets its own copies."""
    names = ["AB 12345", "AB 12354", "AB 12435", "ab-12345", "ab.12354", "AB 54321", "AB 53421", "AB 13245", "ab 13245", "AB 21345", "AB 31245", "ab 31245"]
    df = crawled([{"crawl_id": i, "name": n, "external_url": URL} for i, n in enumerate(names)])
    fold = lambda s: re.sub(r"\W", "", s.lower())
    want = {(a, b) for a, b in itertools.combinations(range(len(names)), 2) if fold(names[a]) == fold(names[b])}
    assert {tuple(r) for r in fd.pairs(fd.members(df)).collect()} == want


def test_many_colliding_records_with_moved_fields(spark, crawled):
    """More anagrams at one address than any fixed number of rounds tells apart; the fields of a copy stand in another order."""
    codes = ["".join(c) for c in itertools.permutations("54321")][:40]
    names = [f"AB {c} - 2L" for c in codes] + [f"2l | ab {c}" for c in codes]
    df = crawled([{"crawl_id": i, "name": n, "external_url": URL} for i, n in enumerate(names)])
    assert {tuple(r) for r in fd.pairs(fd.members(df)).collect()} == {(i, i + 40) for i in range(40)}


def test_long_and_hot(spark, crawled):
    """A group of a third of all rows, very long texts."""
    rows = [{"crawl_id": i, "name": "Tivi, 32 in" if i % 3 == 0 else f"n{i}", "external_url": URL if i % 3 == 0 else f"u{i}"} for i in range(300)]
    rows += [{"crawl_id": 1000 + i, "name": "dài " * 50_000 + "." * i, "external_url": URL} for i in range(2)]
    of = {r["id"]: r["rep"] for r in fd.members(crawled(rows)).collect()}
    assert len(of) == 102 and of[1001] == 1000 and {of[i] for i in range(0, 300, 3)} == {0}


def test_field_hashes_tell_anagrams_apart():
    """Moved fields, letter case, white space and signs leave the hashes as they are; another order of letters does not."""
    texts = fd.text_column(fd.pa.array(["AB 12345 - 2L", "2l | ab.12345", "AB 12354 - 2L", "AB 12345 2L", "", "--", "ab12345,2L"]))
    own, letters = fd.name_hashes(*fd.to_codepoints(texts))
    assert own[0] == own[1] != own[2] and own[3] != own[0] and own[4] == own[5]
    assert letters[0] == letters[1] == letters[2] == letters[3] == letters[6]
    urls = fd.text_column(fd.pa.array([URL, "HTTPS://a.example/X_p1.html?spid=2&sku=1", "https://a.example/x-p1.html?sku=2&spid=1", "https://a.example/x-p1.html?sku1=&spid2=", "https://a.example/x-p1.htmlsku=1spid=2"]))
    h = fd.url_hashes(*fd.to_codepoints(urls))
    assert h[0] == h[1] and len(set(h)) == 4


def test_repeated_and_missing_ids(spark, crawled):
    rows = [{"crawl_id": i, "name": n, "external_url": URL} for i, n in [(1, "A | B"), (1, "A | B"), (2, "b - a"), (3, "x"), (3, "y"), (None, "A | B"), (None, "A | B"), (4, "Y.")]]
    of = sorted((r["id"], r["rep"]) for r in fd.members(crawled(rows)).collect())
    assert [x for x in of if x[0] in (1, 2)] == [(1, 1), (1, 1), (2, 1)] and (4, 3) in of and all(i is not None for i, _ in of)
    out = fd.collapsed(crawled(rows)).where("crawl_id is null")
    assert [r["copies"] for r in out.collect()] == [1, 1]


def test_sifted_keeps_all_wanted(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 7 as other")
    kept = fd.sifted(rows, rows.where("id % 10 = 0"), "id")
    assert kept.columns == rows.columns and kept.where("id % 10 = 0").count() == 2000 and kept.count() < 2100
