import random

import pytest

from marketloom.llm import canonical_values as cv

BRANDS = [(1, "Morulms Living", 50), (2, "DROVERUS", 40), (3, "Giếng Đượm Hương", 5), (4, "Balgulul", 5), (5, "Balgulul Mobile", 9), (6, "Jorgriia Foods", 2), (7, "Tivi", 3)]
LOOKUP = cv.Dictionary(BRANDS)


@pytest.mark.parametrize(
    "value, want",
    [
        ("morulms-living", 1), ("Living Morulms", 1), ("Morums iving", 1), ("M O R U L M S   L I V I N G", 1), ("MorulmsLiving", 1), ("Thương hiệu: Morulms Living", 1),
        ("Drocerus Official Store", 2), ("DROVERUS Co., Ltd", 2), ('"DROVERUS"', 2), ("[DROVERUS]", 2), ("by DROVERUS®", 2), ("DROVERUS-VN", 2), ("Gieng Duom Huong", 3), ("Balgulul", 4), ("balgulul.mobile", 5),
        ("Jorgriia", -1), ("Griibbus Living", -1), ("OEM", -1), ("N/A", -1), ("không thương hiệu", -1), ("Trang chủ > TV > Tivi", 7), ("/tivi/", 7), ("tivi.html", 7), ("Tii", 7), ("x" * 100_000, -1), ("by " * 5000, -1), ("!!!", -1),
    ],
)
def test_resolve(value, want):
    assert LOOKUP.resolve(value) == want


def test_many_layers_and_long_rotated_names():
    """Neither the seller's words around a name nor the number of its words are bounded."""
    before, after = "thương hiệu nhãn hàng by mua bán hãng brand", "chính hãng official store co ltd vn giá rẻ mới cao cấp khuyến mãi"
    assert LOOKUP.resolve(f"{before} Droverus {after}") == 2
    assert LOOKUP.resolve(f"{before} Drocerus {after}") == 2
    name = "Mot Hai Ba Bon Nam Sau Bay Tam Chin Muoi"
    own = cv.Dictionary([*BRANDS, (8, name, 1)])
    assert own.resolve("Bay Tam Chin Muoi Mot Hai Ba Bon Nam Sua") == 8


def test_many_layers_in_a_join(spark):
    name = "Mot Hai Ba Bon Nam Sau Bay Tam Chin Muoi"
    reference = spark.createDataFrame([(1, "Droverus"), (8, name)], "id int, name string")
    values = ["by mua bán hãng brand Droverus chính hãng official store co ltd vn giá rẻ", "Bay Tam Chin Muoi Mot Hai Ba Bon Nam Sua", "other"]
    df = spark.createDataFrame(list(enumerate(values)), "record_id long, brand_raw string")
    assert {r["record_id"]: r["ref_id"] for r in cv.mapped_by_join(df, "record_id", "brand_raw", reference).collect()} == {0: 1, 1: 8, 2: -1}


def plain_distance(a, b):
    """Optimal string alignment, the textbook form."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_and_dictionary_against_brute_force():
    random.seed(7)
    words = ["".join(random.choice("abcde") for _ in range(random.randint(4, 9))) for _ in range(300)]
    own = cv.Dictionary([(i, w, 0) for i, w in enumerate(words)])
    for w in words[:60]:
        typo = list(w)
        for _ in range(2):
            typo[random.randrange(len(typo))] = random.choice("abcde")
        typo = "".join(typo)
        near = {k for k in own.near(typo) if cv.distance(typo, k)[0] <= min(cv.edits_allowed(typo), cv.edits_allowed(k))}
        assert near == {x for x in set(words) if plain_distance(typo, x) <= min(cv.edits_allowed(typo), cv.edits_allowed(x))}
    for a, b in zip(words[:100], words[100:200]):
        n = plain_distance(a, b)
        assert cv.distance(a, b)[0] == (n if n <= 2 else 99)


@pytest.fixture
def tables(spark):
    rows = [(1, "DROVERUS", "Tivi"), (2, "droveru", "Máy > tivi"), (3, None, ""), (4, "  ", None), (5, "OEM", "tv"), (6, "Balgulul Mobil", "Tivi"), (6, "Balgulul Mobil", "Tivi")]
    landed = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id long, brand_raw string, category_raw string, value string, ref_id int")
    brands = spark.createDataFrame([(i, n) for i, n, _ in BRANDS] + [(99, None), (None, "tv")], "id int, name string")
    return landed, brands, spark.createDataFrame([(70, "Tivi")], "id int, name string")


WANT = [(2, "brand", 2), (2, "category", 70), (5, "brand", -1), (5, "category", -1), (6, "brand", 5), (6, "brand", 5)]


def test_found(tables):
    assert sorted(map(tuple, cv.found(*tables).collect())) == WANT
    landed, brands, categories = tables
    assert cv.found(landed.limit(0), brands, categories).count() == 0
    assert {r["ref_id"] for r in cv.found(landed, brands.limit(0), categories.limit(0)).collect()} == {-1}
    assert sorted(map(tuple, cv.misses(*tables).collect())) == [("brand_raw", "OEM", 1), ("category_raw", "tv", 1)]


def test_long_lists_are_joined(tables, monkeypatch):
    monkeypatch.setattr(cv, "MOST_HASHES", 0)
    assert sorted(map(tuple, cv.found(*tables).collect())) == WANT


def test_long_keys_against_brute_force():
    """Keys around and beyond SHORT letters: edits and swaps anywhere, at the borders of pieces too."""
    r = random.Random(4)
    keys = ["".join(r.choice("abcdef") for _ in range(n)) for n in [38, 39, 40, 41, 42, 43, 60, 150, 400] for _ in range(3)]
    own = cv.Dictionary([(i, k, 0) for i, k in enumerate(keys)])
    for k in keys:
        for _ in range(12):
            t = list(k)
            for _ in range(2):
                at = r.choice([r.randrange(len(t) - 1), r.choice(cv.piece_bounds(len(k))[1:-1]) - 1])
                kind = r.randrange(4)
                if kind == 0:
                    t[at] = "z"
                elif kind == 1:
                    t.insert(at, "z")
                elif kind == 2:
                    del t[at]
                else:
                    t[at], t[at + 1] = t[at + 1], t[at]
            typo = "".join(t)
            near = {x for x in own.near(typo) if cv.distance(typo, x)[0] <= 2}
            assert near == {x for x in keys if abs(len(x) - len(typo)) <= 2 and plain_distance(typo, x) <= 2} and (k in near or plain_distance(typo, k) > 2)
    assert own.resolve(keys[-1][:200] + "zz" + keys[-1][200:]) == keys.index(keys[-1])


def test_both_ways_give_the_same(spark, monkeypatch):
    """Broadcast and joined lists: blanks of every kind, signs only, words turned, decorations, misspellings, long names, many distinct values."""
    r = random.Random(9)
    names = ["Sương Biếc", "Máy giặt", "®", "Tivi", "Tivi 4K", "Nova", "nova", "x", "An", "dài " * 40 + "cuối", "Bếp từ đôi"]
    reference = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    values = ["", " ", "\t", "\u00a0\u2003\n", "\x1f", "®", "??", "none", "OEM", "Giặt máy", "Nhà > Tivi", "tivi4k", "TV", "Novva", "nva", "y", "an", "thương hiệu Sương Biếc chính hãng", "suong biec", "dài " * 39 + "dai cuoi", "dài " * 40 + "cuối", None]
    for _ in range(150):
        v = list(r.choice(names[:2] + names[3:]))
        for _ in range(r.randint(0, 3)):
            v[r.randrange(len(v))] = r.choice("aeo xư")
        values.append("".join(v))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "record_id long, brand_raw string")
    first = sorted(map(tuple, cv.mapped(df, "record_id", {"brand_raw": reference}).collect()))
    monkeypatch.setattr(cv, "MOST_HASHES", 0)
    assert sorted(map(tuple, cv.mapped(df, "record_id", {"brand_raw": reference}).collect())) == first
    got = {i: (ref, exact) for i, _, _, ref, exact in first}
    assert not {0, 1, 2, 3, 4, 21} & set(got) and got[5] == (-1, False) and got[9] == (1, False) and got[19] == (9, False) and got[20] == (9, True)
