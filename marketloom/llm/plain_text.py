"""One consistent form for text that only looks plain (problem 6).

Method: the Arrow text of a batch is copied into one code-point array; lookup-table gathers
replace full-width forms, odd spaces and look-alike letters, expansion offsets take ligatures and composed
letters apart, and marks are put in canonical order and composed again for all rows at once.

Defined results: null stays null; empty text stays empty; plain text comes out byte for byte;
tabs and line breaks are left alone (they do not look like a space); joiners inside emoji, words
wholly in another script, trade marks, brackets and emoji are left alone.  Rows are independent,
so repeated rows and ties need no rule, and columns of any other name pass through untouched.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.codepoints import TOP, any_in_row, from_codepoints, pieces, text_column, to_codepoints
from marketloom.functions.lookalikes import ALWAYS, INVISIBLE, LOOKALIKES, SPACES

JOINER = 0x200D
# Code points that show nothing by themselves: fillers, joiners of graphemes, and selectors of a variant (those after anything but a letter stay, as emoji have them).
FILLERS = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0]
SELECTORS = [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
BLANK = 0x2800  # a pattern without dots looks like a space
JOINED = [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]  # ligatures and numerals that look like the letters they are made of
# Letters of another script that look like Latin ones in mixed words.
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))


@lru_cache(None)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built from the character database by rule."""
    single = np.arange(TOP, dtype=np.uint32)  # one to one
    odd = np.zeros(TOP, bool)  # whether it may change
    latin, foreign, word, pictured = (np.zeros(TOP, bool) for _ in range(4))
    look = np.zeros(TOP, np.uint32)
    ccc = np.zeros(TOP, np.uint8)
    width = np.ones(TOP, np.uint8)
    parts: dict[int, str] = {}
    pairs: dict[int, int] = {}
    for c in range(sys.maxunicode + 1):
        if 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xDFFF or 0x17000 <= c <= 0x1CFFF or c >= 0x20000:
            continue
        ch = chr(c)
        kind = ud.category(ch)
        if kind == "Cn":
            continue
        ccc[c] = ud.combining(ch)
        if kind[0] in "LNM":
            word[c] = True
        tag = ud.decomposition(ch)
        if tag and tag[0] != "<":
            full = ud.normalize("NFD", ch)
            parts[c] = full
            width[c] = len(full)
            if len(tag.split()) == 2 and ud.normalize("NFC", full) == ch:
                a, b = (int(x, 16) for x in tag.split())
                pairs[a << 21 | b] = c
        if tag.startswith(("<wide>", "<font>")) and len(tag.split()) == 2:
            plain = int(tag.split()[1], 16)
            if plain < 0x250 and (c >= 0x1D400 or 0xFF00 <= c < 0xFFF0):
                single[c] = plain
                odd[c] = True
        if kind[0] == "L":
            name = ud.name(ch, "")
            latin[c] = "LATIN" in name or single[c] != c
            foreign[c] = name.startswith(("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE"))
        pictured[c] = c >= 0x1F000 or 0x2600 <= c < 0x27C0 or c in (0xFE0F, 0x2764)
    for c in (*SPACES, BLANK):
        single[c] = 32
        odd[c] = True
    for a, b in ALWAYS.items():
        single[ord(a)] = ord(b)
        odd[ord(a)] = True
    for a, b in (LOOKALIKES | CHEROKEE).items():
        look[ord(a)] = ord(b)
        odd[ord(a)] = True
    odd[foreign] = True
    hidden = np.zeros(TOP, bool)
    hidden[[*INVISIBLE, *FILLERS]] = True
    selector, letter = np.zeros(TOP, bool), np.zeros(TOP, bool)
    selector[SELECTORS] = True
    letter[[c for c in range(0x3400) if ud.category(chr(c))[0] in "LM" and c not in SELECTORS]] = True
    joined = {c: ud.normalize("NFKC", chr(c)) for c in JOINED}
    wide = np.ones(TOP, np.uint8)
    wide[list(joined)] = [len(x) for x in joined.values()]
    inside = np.zeros(TOP, np.int64)
    inside[list(joined)] = np.cumsum([0, *(len(x) for x in joined.values())][:-1])
    odd[JOINED] = True
    odd[0x1100:0x1200] = True
    odd |= hidden | selector | (ccc > 0)
    start = np.zeros(TOP, np.int64)
    flat: list[int] = []
    for c, full in parts.items():
        start[c] = len(flat)
        flat.extend(map(ord, full))
    keys = np.array(sorted(pairs), np.int64)
    return {
        "single": single, "odd": odd, "latin": latin, "foreign": foreign, "word": word, "pictured": pictured, "look": look, "ccc": ccc, "width": width,
        "start": start, "flat": np.array(flat, np.uint32), "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32), "hidden": hidden,
        "selector": selector, "letter": letter, "wide": wide, "inside": inside, "letters": np.array([ord(x) for t in joined.values() for x in t], np.uint32), "joined": np.isin(np.arange(TOP), JOINED),
    }


def offsets_after(keep: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return total[at]


def unhide(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without invisible characters, but for joiners that hold emoji together and selectors of emoji."""
    t = tables()
    gone = t["hidden"][points]
    if len(points):
        before = np.append(0, points[:-1])
        gone = gone | t["selector"][points] & (t["letter"][before] | t["selector"][before] | (before == 32))
    if not gone.any():
        return points, at
    joined = np.zeros(len(points), bool)
    joined[1:-1] = (points[1:-1] == JOINER) & t["pictured"][points[:-2]] & t["pictured"][points[2:]]
    keep = ~gone | joined
    return points[keep], offsets_after(keep, at)


def unmask(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Look-alike letters replaced in words that mix scripts or hold digits beside look-alikes only.

    A word is a run of letters, digits and marks.  Words with a letter that looks like no Latin
    one, and words without any Latin letter or digit, are words of the other script.
    """
    t = tables()
    foreign = t["foreign"][points]
    if not foreign.any():
        return points
    word = t["word"][points]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = at[:-1][at[:-1] < len(points)]
    begin[firsts] = word[firsts]
    of = np.cumsum(begin) - 1
    n = int(of[-1]) + 1
    count = lambda flag: np.bincount(of[flag & word], minlength=n)
    digit = (points >= 48) & (points <= 57)
    mixed = (count(foreign) > 0) & (count(foreign & (t["look"][points] == 0)) == 0) & ((count(t["latin"][points]) > 0) | (count(digit) > 0))
    swap = foreign & word & mixed[of]
    return np.where(swap, t["look"][points], points)


def unjoin(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ligatures and numerals of one code point as the letters they look like."""
    t = tables()
    width = t["wide"][points].astype(np.int64)
    parts = t["joined"][points]
    if not parts.any():
        return points, at
    end = np.cumsum(width)
    first = end - width
    source = np.repeat(np.arange(len(points)), width)
    place = np.arange(int(end[-1])) - first[source]
    whole = points[source]
    out = np.where(parts[source], t["letters"][np.minimum(t["inside"][whole] + place, len(t["letters"]) - 1)], whole).astype(np.uint32)
    return out, np.append(first, end[-1])[at]


def syllables(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining Korean letters as syllables; a row's end parts them."""
    lead, vowel, tail = (points >= 0x1100) & (points <= 0x1112), (points >= 0x1161) & (points <= 0x1175), (points >= 0x11A8) & (points <= 0x11C2)
    if not (lead.any() and vowel.any()):
        return points, at
    begin = np.zeros(len(points) + 2, bool)
    begin[at[at < len(points)]] = True
    two = np.flatnonzero(lead[:-1] & vowel[1:] & ~begin[1 : len(points)])
    three = two[(two + 2 < len(points)) & tail[np.minimum(two + 2, len(points) - 1)] & ~begin[two + 2]]
    out, keep = points.copy(), np.ones(len(points), bool)
    out[two] = 0xAC00 + ((points[two] - 0x1100) * 21 + points[two + 1] - 0x1161) * 28
    out[three] += points[three + 2] - 0x11A7
    keep[two + 1] = keep[three + 2] = False
    return out[keep], offsets_after(keep, at)


def compose(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed with their letters, for all rows at once."""
    t = tables()
    if not (t["ccc"][points] > 0).any():
        return points, at
    width = t["width"][points].astype(np.int64)
    end = np.cumsum(width)
    first = end - width
    source = np.repeat(np.arange(len(points)), width)
    place = np.arange(int(end[-1])) - first[source]
    whole = points[source]
    apart = np.where(width[source] > 1, t["flat"][np.minimum(t["start"][whole] + place, len(t["flat"]) - 1)], whole).astype(np.uint32)
    at = np.append(first, end[-1])[at]
    ccc = t["ccc"][apart].astype(np.int64)
    new = ccc == 0
    new[at[:-1][at[:-1] < len(apart)]] = True
    group = np.cumsum(new) - 1
    order = np.lexsort((ccc, group)) if (np.diff(ccc) < 0).any() else np.arange(len(apart))
    apart, ccc = apart[order], ccc[order]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = np.arange(len(apart)) - head[group]
    base = apart[head].astype(np.int64)
    open_to = ccc[head] == 0
    last = np.zeros(len(head), np.int64)
    keep = np.ones(len(apart), bool)
    for k in range(1, int(rank.max()) + 1):
        here = np.flatnonzero(rank == k)
        g = group[here]
        key = base[g] << 21 | apart[here].astype(np.int64)
        found = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        fits = (t["keys"][found] == key) & open_to[g] & ((last[g] < ccc[here]) | (last[g] == 0))
        base[g[fits]] = t["made"][found[fits]]
        keep[here[fits]] = False
        last[g[~fits]] = ccc[here[~fits]]
    apart = apart.copy()
    apart[head] = base.astype(np.uint32)
    return apart[keep], offsets_after(keep, at)


def canonical(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of all rows, as code points and offsets."""
    points, at = unhide(points, at)
    points, at = unjoin(tables()["single"][points], at)
    points, at = syllables(*compose(points, at))
    return unmask(points, at), at


def plain(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of a string column, and whether each row changed."""
    text = text_column(column)
    points, at = to_codepoints(text)
    changed = any_in_row(tables()["odd"][points], at) if len(points) else np.zeros(len(text), bool)
    out = text.cast(pa.string())
    if changed.any():
        some = text.filter(pa.array(changed))
        better = from_codepoints(*canonical(*to_codepoints(some)))
        differs = pc.not_equal(better, some.cast(pa.string())).to_numpy(zero_copy_only=False)
        where = np.flatnonzero(changed)
        changed[where[~differs]] = False
        out = pc.replace_with_mask(out, pa.array(np.isin(np.arange(len(out)), where)), better)
    null = column.is_null()
    return pc.if_else(null, pa.scalar(None, pa.string()), out), changed


def with_plain_text(df: DataFrame, text: str, out: str = "plain", changed: str = "changed") -> DataFrame:
    """``df`` with the consistent form of column ``text`` and whether it differs.

    Narrow: one pass, no shuffle, memory bounded by a slice of two million bytes.  Existing
    columns named ``out`` or ``changed`` are replaced.
    """
    names = [c for c in df.columns if c not in (out, changed) or c == text]
    df = df.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            better, flag = plain(b.column(text))
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n not in (out, changed)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), better, pa.array(flag)], names=[*(n for n, _ in kept), out, changed])

    kept = [f for f in df.schema.fields if f.name not in (out, changed)]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(changed, T.BooleanType())]))


def masked_rows(df: DataFrame, table: str, row_id: str, text: str) -> DataFrame:
    """``(tbl, row_id)`` of the rows whose text only looks plain."""
    lean = df.select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"))
    return with_plain_text(lean, "text").where("changed").select(F.lit(table).alias("tbl"), "row_id")
