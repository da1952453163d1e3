"""Values as a page shows them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_text(price: Column) -> Column:
    """'15.990.000 ₫'; null and 0 are 'Liên hệ'."""
    grouped = F.translate(F.format_number(F.round(price), 0), ",", ".")
    return F.when(price.isNull() | (price == 0) | F.isnan(price), "Liên hệ").otherwise(F.concat(grouped, F.lit(" ₫")))


def compact_number(n: Column) -> Column:
    """1.2M, 3.4K, or the number itself."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


# The names of platforms as a page shows them.
PLATFORM_NAMES = {
    "shopee": "Shopee",
    "tiki": "Tiki",
    "lazada": "Lazada",
    "sendo": "Sendo",
    "dienmayxanh": "Điện Máy Xanh",
    "thegioididong": "TGDĐ",
    "cellphones": "CellphoneS",
    "fptshop": "FPT Shop",
    "nguyenkim": "Nguyễn Kim",
    "phongvu": "Phong Vũ",
    "gearvn": "GearVN",
    "hasaki": "Hasaki",
    "yes24": "Yes24",
    "fahasa": "Fahasa",
    "unknown": "Khác",
}


def platform_name(platform: Column) -> Column:
    """A platform's name on a page: the fixed one in any case, else its first letter in upper case; 'Unknown' if there is none."""
    names = F.create_map(*(F.lit(x) for kv in PLATFORM_NAMES.items() for x in kv))
    return F.when(F.coalesce(platform, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.element_at(names, F.lower(platform)), capitalized(platform)))


def capitalized(text: Column) -> Column:
    """The first letter in upper case, the rest as it stands."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1_000_000))


def millions(price: Column) -> Column:
    return price * 1_000_000
