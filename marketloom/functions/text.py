"""Names and keys as column expressions; everything stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space of the web's regular expressions.
SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def normalize_name(name: Column) -> Column:
    """Lower case, white space collapsed, then all but letters, digits and spaces deleted, trimmed.

    The order matters: 'a - b' keeps two inner spaces.  Combining marks are deleted."""
    spaced = F.regexp_replace(F.lower(name), SPACE + "+", " ")
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N} ]", ""))


def name_hash(name: Column) -> Column:
    """A 31-polynomial over the UTF-16 units of the normalized name, wrapped to 32 bits, absolute, 16 hex digits."""
    wrap = F.lit(1 << 32)

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        high, low = F.floor((code - 0x10000) / 1024) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
        return F.when(code < 0x10000, (acc * 31 + code) % wrap).otherwise((((acc * 31 + high) % wrap) * 31 + low) % wrap)

    normal = normalize_name(name)
    total = F.aggregate(F.filter(F.split(normal, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    signed = F.when(total >= 1 << 31, total - wrap).otherwise(total)
    return F.when(name.isNotNull(), F.lpad(F.lower(F.hex(F.abs(signed))), 16, "0"))


def tokens(text: Column) -> Column:
    """The default tokenizer: white-space words of the text as it stands (null gives none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda t: t != "")


def prefix_key(name: Column, length: int = 50) -> Column:
    """The first characters of a lower-case name, trimmed: the key of a price comparison."""
    return F.trim(F.substring(F.lower(name), 1, length))


def truthy(value: Column) -> Column:
    """A string that is not empty, else null."""
    return F.nullif(value, F.lit(""))


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*(truthy(v) for v in values))


def prefixed(text: Column, kind: str = "passage") -> Column:
    """The prefix that asymmetric text encoders expect: 'passage: ' or 'query: '."""
    return F.concat(F.lit(f"{kind}: "), text)


def phrase_share(name: Column, phrases: Column) -> Column:
    """The share of phrases that occur in a name, ignoring case; 0 for missing names or no phrases."""
    low = F.lower(name)
    hit = F.size(F.filter(phrases, lambda p: low.contains(F.lower(p))))
    return F.coalesce(F.when(F.size(phrases) > 0, hit / F.size(phrases)), F.lit(0.0))


def any_phrase(name: Column, phrases: Column) -> Column:
    """1 if any phrase occurs in a name, ignoring case, else 0."""
    low = F.lower(name)
    return F.coalesce(F.exists(phrases, lambda p: low.contains(F.lower(p))).cast("double"), F.lit(0.0))
