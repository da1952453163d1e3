"""Shops behind addresses and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.text import first_truthy

# Parts of addresses by platform; the first that occurs decides.
URL_PARTS = {
    "shopee": ["shopee.vn", "shopee.com"],
    "tiki": ["tiki.vn"],
    "lazada": ["lazada.vn", "lazada.com"],
    "sendo": ["sendo.vn"],
    "dienmayxanh": ["dienmayxanh.com"],
    "thegioididong": ["thegioididong.com"],
    "cellphones": ["cellphones.com.vn"],
    "fptshop": ["fptshop.com.vn"],
    "nguyenkim": ["nguyenkim.com"],
    "phongvu": ["phongvu.vn"],
    "gearvn": ["gearvn.com"],
    "hasaki": ["hasaki.vn"],
    "yes24": ["yes24.vn"],
    "fahasa": ["fahasa.com"],
}
# Spellings of platform names.
ALIASES = {
    "dien may xanh": "dienmayxanh",
    "điện máy xanh": "dienmayxanh",
    "the gioi di dong": "thegioididong",
    "thế giới di động": "thegioididong",
    "cell phones": "cellphones",
}
# How shops spell platforms that are asked for by their common name.
SPELLINGS = {
    "dienmayxanh": ["điện máy xanh"],
    "thegioididong": ["thế giới di động"],
}
# Names that mean that the platform is not known.
UNKNOWN = ["unknown", "null", "none", ""]


def chain(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """One CASE of ordered conditions."""
    out = reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def from_url(url: Column, parts: dict[str, list[str]] = URL_PARTS) -> Column:
    """The platform whose part of an address occurs first in the declared order, else null."""
    low = F.lower(url)
    return chain([(reduce(lambda a, b: a | b, [low.contains(p) for p in each]), F.lit(name)) for name, each in parts.items()])


def normalized(platform: Column, url: Column, *others: Column, parts: dict[str, list[str]] = URL_PARTS) -> Column:
    """The platform's common name: the first given one, else that of the address, aliases resolved, 'unknown' if none."""
    named = first_truthy(platform, *others)
    known = F.when(named.isNull() | F.lower(named).isin(UNKNOWN), F.coalesce(from_url(url, parts), named)).otherwise(named)
    low = F.lower(F.trim(known))
    return F.coalesce(chain([(low == a, F.lit(b)) for a, b in ALIASES.items()], low), F.lit("unknown"))


def expanded(names: list[str]) -> list[str]:
    """Requested platforms in lower case with the spellings that shops use."""
    return list(dict.fromkeys(x for n in names for x in [*SPELLINGS.get(n.lower(), []), n.lower()]))


def matches_any(url: Column, patterns: list[str]) -> Column:
    """Whether any of the regular expressions occurs in an address."""
    return reduce(lambda a, b: a | b, [url.rlike(p) for p in patterns])


# The product pages of platforms.
PRODUCT_PAGES = {
    "tiki": [r"/p[0-9]+\.html", r"tiki\.vn/[^/]+-p[0-9]+"],
    "lazada": [r"/products/.*-i[0-9]+", r"lazada\.vn/.*\.html"],
    "dienmayxanh": [r"dienmayxanh\.com/[^/]+$", r"/[a-z0-9-]+-[0-9]+$"],
    "cellphones": [r"cellphones\.com\.vn/[^/]+\.html$"],
}


def product_pages(url: Column, platform: str) -> Column:
    return matches_any(url, PRODUCT_PAGES.get(platform, [".*"]))


# The slugs of categories at sources that name them otherwise.
SOURCE_SLUGS = {
    "lazada": {
        "dien-thoai": "dien-thoai-di-dong",
        "tablet": "may-tinh-bang",
        "phu-kien": "phu-kien-dien-thoai",
        "do-gia-dung": "do-gia-dung-dien-tu",
        "dong-ho": "thiet-bi-deo-thong-minh",
        "may-anh": "may-anh-may-quay-phim",
        "laptop": "laptop",
        "tivi": "tivi",
    },
    "tiki": {
        "dien-thoai": "1789",
        "laptop": "1846",
        "tablet": "1789",
        "tivi": "1815",
        "may-anh": "1882",
        "do-gia-dung": "1883",
        "phu-kien": "1801",
        "dong-ho": "8594",
    },
    "dienmayxanh": {
        "dien-thoai": "dien-thoai",
        "laptop": "laptop",
        "tablet": "may-tinh-bang",
        "tivi": "tivi",
        "tu-lanh": "tu-lanh",
        "may-giat": "may-giat",
        "do-gia-dung": "do-gia-dung",
    },
    "shopee": {
        "dien-thoai": "Điện thoại",
        "laptop": "Laptop",
        "tablet": "Máy tính bảng",
    },
    "cellphones": {
        "dien-thoai": "mobile",
        "laptop": "laptop",
        "tablet": "tablet",
        "phu-kien": "phu-kien",
        "dong-ho": "do-choi-cong-nghe/dong-ho-thong-minh",
    },
}


def source_slug(slug: Column, source: Column) -> Column:
    """A category's slug at the source of each row, itself where the source has no other."""
    pairs = [(f"{s}\n{a}", b) for s, own in SOURCE_SLUGS.items() for a, b in own.items()]
    names = F.create_map(*(F.lit(x) for kv in pairs for x in kv))
    return F.coalesce(F.element_at(names, F.concat_ws("\n", source, slug)), slug)


def mapped_slug(slug: Column, mapping: dict[str, str]) -> Column:
    """A category's slug at a source, itself where the mapping has none."""
    if not mapping:
        return slug
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), slug), slug)
