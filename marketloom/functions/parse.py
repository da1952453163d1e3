"""Numbers, identifiers and addresses read from landed strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_price(text: Column) -> Column:
    """All digits of a price as one number, 0 if there are none ('15.990.000₫' is 15990000)."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("double"), F.lit(0.0))


def sold_count(text: Column) -> Column:
    """'1,2k' is 1200: the first comma is a point, k is a thousand, halves round up; 0 if unreadable."""
    number = F.regexp_extract(text, r"([0-9.,]+)\s*([kK])?", 1)
    first = F.regexp_extract(F.regexp_replace(number, "^([^,]*),", "$1."), r"^[0-9]*\.?[0-9]*", 0)
    value = first.try_cast("double") * F.when(F.regexp_extract(text, r"([0-9.,]+)\s*([kK])?", 2) != "", 1000).otherwise(1)
    return F.coalesce(F.floor(value + 0.5), F.lit(0)).cast("long")


def rating(text: Column) -> Column:
    """'width: 80%' is 4.0; a leading number up to 5 is itself; else null."""
    width = F.regexp_extract(text, r"width:\s*([0-9]+)%", 1).try_cast("double")
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")
    return F.when(width.isNotNull(), width / 100 * 5).when(number <= 5, number)


def discount_percent(original: Column, final: Column) -> Column:
    """The whole percent off if original > final > 0, else 0."""
    return F.when((original > final) & (final > 0), F.floor((original - final) / original * 100 + 0.5)).otherwise(0).cast("int")


def original_if_higher(original: Column, price: Column) -> Column:
    return F.when(original > price, original)


# Patterns of product ids in addresses, by platform, in the order they are tried.
ID_PATTERNS = {
    "tiki": [r"-p([0-9]+)\.html", r"/p([0-9]+)\.html"],
    "lazada": [r"-i([0-9]+)(?:-s|\.|$)"],
    "dienmayxanh": [r"-([0-9]+)$"],
    "cellphones": [r"/([^/]+)\.html$"],
}


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def product_id(url: Column, platform: Column) -> Column:
    """The product id in an address of a known platform, else null."""
    out: Column | None = None
    for name, patterns in ID_PATTERNS.items():
        out = F.when(platform == name, first_match(url, patterns)) if out is None else out.when(platform == name, first_match(url, patterns))
    return out


def slug_id(url: Column) -> Column:
    """The last part of an address without '.html', dashes as underscores; null if there is none."""
    page = F.regexp_extract(url, r"/([^/]+)\.html", 1)
    last = F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".html"), F.lit(""))
    return F.nullif(F.translate(F.when(page != "", page).otherwise(last), "-", "_"), F.lit(""))


def absolute_url(href: Column, base: str) -> Column:
    """'//host/x', '/x' and 'x' joined to a base; absolute ones as they stand; empty ones null."""
    root = base.rstrip("/")
    return (
        F.when(href.isNull() | (href == ""), None)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(F.lit(root), href))
        .otherwise(F.concat(F.lit(root + "/"), href))
    )


def csv_list(text: Column) -> Column:
    """'a, b' as ['a', 'b']; null stays null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def flatten_specs(groups: Column) -> Column:
    """``[{attributes: [{name, value}]}]`` as a map; the last of equal names wins."""
    return F.map_from_entries(F.flatten(F.transform(groups, lambda g: F.transform(g["attributes"], lambda a: F.struct(a["name"], a["value"])))))


def trimmed_slug(slug: Column) -> Column:
    """A slug without slashes at its ends."""
    return F.regexp_replace(slug, "^/+|/+$", "")


def uri_component(text: Column) -> Column:
    """Percent-encoded UTF-8 as a part of an address: all but letters, digits and - _ . ! ~ * ' ( ) is encoded."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def hours_before(now: Column, hours: float) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))


def millis_between(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 1000
