import pytest
from pyspark.sql import functions as F

from marketloom.functions import display, parse, text
from marketloom.functions.units import amounts, in_name, in_specs, number, plain_ascii, storage
from marketloom.operators import platforms


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def js_hash(s):
    h = 0
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "little")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    return f"{abs(h):x}".rjust(16, "0")


@pytest.mark.parametrize(
    "raw, want",
    [("Tủ  Lạnh - Aqua\t(469L)!", "tủ lạnh  aqua 469l"), ("a\u00a0b", "a b"), ("e\u0301", "e"), ("", ""), (None, None), ("🔥Hot", "hot")],
)
def test_normalize_name(spark, raw, want):
    assert one(spark, text.normalize_name, raw) == want


@pytest.mark.parametrize("raw", ["Tủ lạnh Aqua", "", "a - b", "𝟗𝟗 x", "Điện thoại " * 40])
def test_name_hash(spark, raw):
    normal = one(spark, text.normalize_name, raw)
    assert one(spark, text.name_hash, raw) == js_hash(normal)
    assert one(spark, text.name_hash, None) is None


def test_tokens_and_keys(spark):
    assert one(spark, text.tokens, " a  b_c\td ") == ["a", "b_c", "d"]
    assert one(spark, text.tokens, None) == []
    assert one(spark, text.prefix_key, "A" * 49 + " B") == "a" * 49
    assert one(spark, lambda c: text.first_truthy(c, F.lit("x")), "") == "x"
    assert one(spark, text.prefixed, "t") == "passage: t"
    phrases = F.array(F.lit("Nồi"), F.lit("zz"))
    assert one(spark, lambda c: text.phrase_share(c, phrases), "NỒI cơm") == 0.5
    assert one(spark, lambda c: text.any_phrase(c, phrases), None) == 0.0


@pytest.mark.parametrize("raw, want", [("15.990.000₫", 15990000.0), ("", 0.0), (None, 0.0), ("19.5", 195.0), ("Liên hệ", 0.0)])
def test_digits_price(spark, raw, want):
    assert one(spark, parse.digits_price, raw) == want


@pytest.mark.parametrize("raw, want", [("1,2k", 1200), ("3K đã bán", 3000), ("7", 7), ("", 0), (None, 0), ("x", 0), ("0,0005k", 1)])
def test_sold_count(spark, raw, want):
    assert one(spark, parse.sold_count, raw) == want


@pytest.mark.parametrize("raw, want", [("width: 80%", 4.0), ("4.5", 4.5), ("7", None), ("", None), (None, None)])
def test_rating(spark, raw, want):
    assert one(spark, parse.rating, raw) == want


def test_prices(spark):
    assert one(spark, lambda c: parse.discount_percent(c, F.lit(80.0)), 100.0, "double") == 20
    assert one(spark, lambda c: parse.discount_percent(c, F.lit(0.0)), 100.0, "double") == 0
    assert one(spark, lambda c: parse.discount_percent(c, F.lit(1.0)), None, "double") == 0
    assert one(spark, lambda c: parse.original_if_higher(c, F.lit(80.0)), 80.0, "double") is None


@pytest.mark.parametrize(
    "platform, url, want",
    [("tiki", "https://tiki.vn/x-p123.html", "123"), ("tiki", "https://tiki.vn/p9.html", "9"), ("lazada", "https://l.vn/products/x-i55-s1.html", "55"), ("dienmayxanh", "https://d/x-77", "77"), ("cellphones", "https://c/iphone-15.html", "iphone-15"), ("other", "https://c/x-1", None), ("tiki", None, None)],
)
def test_product_id(spark, platform, url, want):
    assert one(spark, lambda c: parse.product_id(c, F.lit(platform)), url) == want


def test_addresses(spark):
    base = "https://s.example/"
    for raw, want in [("//h/x", "https://h/x"), ("/x", "https://s.example/x"), ("x", "https://s.example/x"), ("http://h/x", "http://h/x"), ("", None), (None, None)]:
        assert one(spark, lambda c: parse.absolute_url(c, base), raw) == want
    assert one(spark, parse.slug_id, "https://c/iphone-15-pro.html?x") == "iphone_15_pro"
    assert one(spark, parse.slug_id, "a/b-c") == "b_c"
    assert one(spark, parse.slug_id, "a/") is None
    assert one(spark, parse.csv_list, "a, b ,c") == ["a", "b", "c"]
    assert one(spark, parse.trimmed_slug, "/a/b/") == "a/b"


def test_platforms(spark):
    for raw, want in [("https://TIKI.vn/x", "tiki"), ("https://lazada.com?u=tiki.vn", "tiki"), ("https://x.example", None), (None, None)]:
        assert one(spark, platforms.from_url, raw) == want
    url = F.lit("https://www.fahasa.com/x")
    for raw, want in [("Điện Máy Xanh ", "dienmayxanh"), ("unknown", "fahasa"), (None, "fahasa"), (" Tiki", "tiki")]:
        assert one(spark, lambda c: platforms.normalized(c, url), raw) == want
    assert one(spark, lambda c: platforms.normalized(c, F.lit(None).cast("string")), None) == "unknown"
    assert platforms.expanded(["DienMayXanh", "tiki"]) == ["điện máy xanh", "dienmayxanh", "tiki"]
    assert one(spark, lambda c: platforms.product_pages(c, "tiki"), "https://tiki.vn/a-p1.html") is True
    assert one(spark, lambda c: platforms.mapped_slug(c, {"tablet": "may-tinh-bang"}), "laptop") == "laptop"


def test_display(spark):
    assert one(spark, display.price_text, 15990000.0, "double") == "15.990.000 ₫"
    assert one(spark, display.price_text, None, "double") == "Liên hệ"
    assert one(spark, display.compact_number, 1250, "long") == "1.3K"
    assert one(spark, display.capitalized, "góc me") == "Góc me"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Bột giặt 1.5 [ký]", [("mass", 1500)]), ("60.9  fl  oz", [("volume", 1801)]), ("nửa - lít", [("volume", 500)]), ("1 lít rưỡi", [("volume", 1500)]), ("2 kg 250 g", [("mass", 2250)]), ("5 kg... 500 g", [("mass", 5500)]), ("5 kg | 500 g", [("mass", 5000), ("mass", 500)]), ('TV 75" LED', [("length", 1905)]),
        ("50''", [("length", 1270)]), ("1kg5", [("mass", 1500)]), ("3,600 ML", [("volume", 3600)]), ("0.250 kg", [("mass", 250)]), ("2 in 1", []), ("TV 50 in 12-month warranty", [("length", 1270)]), ("TV 32 in 4 loa", [("length", 813)]), ("5G", []), ("8 lạng", [("mass", 800)]), ("120 phân", [("length", 1200)]),
        ("0,85 KW", [("power", 850)]), ("2,25k‍ilogam", [("mass", 2250)]), ("３５ ｃｌ", [("volume", 350)]), ("5 kilοgam", [("mass", 5000)]), ("12 oz", [("mass", 340)]), ("9" * 5000, []), ("220V 5V/2A", []), ('KM-23042 "Max"', []), ('64 "Gb"', []), ("25.4 FL *OZ*", [("volume", 751)]), ("1 lít (rưỡi)", [("volume", 1500)]), ('23042 " x', []),
    ],
)
def test_amounts(raw, want):
    assert [(q, round(a)) for q, a, _ in amounts(plain_ascii(raw))] == want


def test_units_in_context():
    assert in_name(plain_ascii("Điện thoại X 128G 201 g")) == {"mass": 201.0}
    assert in_name(plain_ascii("Cà phê 512G")) == {"mass": 512.0}
    assert storage("phone 128 (gb)") == 128 and storage("1tb") == 1024 and storage("500g") is None
    assert in_specs([("Weight", "5500"), ("Unit", "g"), ("Dung tích (mL)", "800"), ("Storage", "64 GB"), ("Power", None)]) == ({"mass": 5500.0, "volume": 800.0}, {})
    assert in_specs([("Cân nặng", "3.5")]) == ({}, {"mass": 3.5})
    assert [number(*x) for x in [("1.500", "ml"), ("1.500", "kg"), ("1.234.567", "g"), ("0,5", "l")]] == [1500, 1.5, 1234567, 0.5]
