"""Held-out passages inside the corpus (problem 8).

Method: template canonicalisation.  Text becomes words (runs of letters or digits, without case
and accents); numbers, codes, names and units become typed placeholders.  :func:`found` compares
windows of ``WINDOW`` words: as a word's placeholder depends on the word alone, equal passages always have equal
templates, and the slots of windows with equal templates are checked for equality.  :func:`passages` also looks for re-parameterised
copies: there a run of placeholders of one type is one slot, so that a name of two words may replace one of a single word; windows
of ``SPAN`` such tokens meet on their templates, adjoining ones make a passage, and its slots are checked for
consistency: equal slots of the item are equal in the copy.

Scale: the items' windows are broadcast if there are at most ``MOST_WINDOWS`` of them (the items
do not grow with the corpus); beyond that the windows are joined as tables, after a bitmap of fixed size of the items'
templates has sifted those of the corpus.  Documents are read once, hashed as arrays and never shuffled; all windows of whole texts count.
Names are a bitmap of fixed size too, whatever their number; a word that it takes for a name by chance is a slot like others.

Defined results: items without an id are no items; null or empty texts and texts shorter than a window have no windows; an item that
occurs many times in a document, and documents landed twice, give one row per pair of ids; items with equal texts are all
reported.
"""

from __future__ import annotations

import sys
import unicodedata as ud
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.codepoints import TOP, mix64, pieces, powers, segment_hash, text_column, to_codepoints
from marketloom.session import cut

WINDOW = 12
SPAN = 8  # tokens of a template window of a re-parameterised passage
CHANGED_WORDS, CHANGED_SHARE = 24, 0.8  # words that such a passage must span, or this share of a shorter item
PLAIN_SHARE = 0.5  # of its tokens must be plain words
MOST_WINDOWS = 5_000_000
BITS = 1 << 26  # of a bitmap
NUMBER, CODE, UNIT, NAME = 1, 2, 3, 4
# Words for units, without accents.
UNITS = "g gr gram grams kg kilogam kilogram ky lang mg ml cl l lit litre liter cc mm cm m met km inch inches ft oz lb w watt kw oat v gb mb tb phut gio ngay tuan thang nam minutes hours days weeks months years vnd dong usd eur".split()


@lru_cache(None)
def fold_table() -> np.ndarray:
    """For every code point: 0 ends a word, 1 is ignored inside one, else the letter it folds to."""
    table = np.zeros(TOP, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = ud.category(ch)
        if kind[0] == "M" or kind == "Cf":
            table[c] = 1
        elif kind[0] in "LN":
            low = ud.normalize("NFD", ch.lower())[0]
            table[c] = ord(low)
    table[ord("đ")] = table[ord("Đ")] = ord("d")
    return table


def words_of(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a batch: two independent hashes, the row, and the kind (0, number, code)."""
    folded = fold_table()[points]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    seen = folded != 1
    folded, row = folded[seen], row[seen]
    kept = folded > 0
    begin = kept.copy()
    begin[1:] &= ~kept[:-1] | (row[1:] != row[:-1])
    letters = folded[kept]
    first = np.flatnonzero(begin[kept])
    digit = (letters >= 48) & (letters <= 57)
    if not len(first):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int32), np.zeros(0, np.int8)
    digits = np.add.reduceat(digit.astype(np.int32), first)
    length = np.diff(np.append(first, len(letters)))
    kind = np.where(digits == length, NUMBER, np.where(digits > 0, CODE, 0)).astype(np.int8)
    hashes = segment_hash(letters, first, 5)
    return hashes, mix64(hashes ^ np.uint64(0xA5A5_5A5A_1234_8765)), row[kept][first], kind


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of single words as :func:`words_of` makes them, sorted."""
    return np.unique(words_of(*to_codepoints(pa.array(sorted(set(words)) or ["g"], pa.large_string())))[0])


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash of every run of ``window`` values."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    p = powers(base | 1, max(window, 2))
    with np.errstate(over="ignore"):
        for k in range(window):
            out += values[k : k + n] * p[k]
    return mix64(out)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def bitmap_of(values: np.ndarray) -> np.ndarray:
    """A bitmap of ``BITS`` bits of 64-bit hashes, packed into words."""
    place = (values & np.uint64(BITS - 1)).astype(np.int64)
    out = np.zeros(BITS >> 6, np.uint64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def in_bitmap(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (values & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The same of a column of any length: at most ``BITS / 64`` words reach the driver."""
    place = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


class Reader:
    """Makes the windows of a batch of texts; ``names`` are words or a bitmap of their hashes."""

    def __init__(self, names: list[str] | np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.units = word_hashes(UNITS)
        self.names = names if isinstance(names, np.ndarray) else bitmap_of(word_hashes(names)) if names else None
        self.stand_in = mix64(np.arange(10, 20, dtype=np.uint64))

    def words(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :func:`words_of`, with all kinds."""
        word, second, row, kind = words_of(*to_codepoints(text))
        kind[(kind == 0) & member(word, self.units)] = UNIT
        if self.names is not None:
            kind[(kind == 0) & in_bitmap(word, self.names)] = NAME
        return word, second, row, kind

    def windows(self, read: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """By window of words: row, place of its first word, template hash, exact hash."""
        word, second, row, kind = read
        typed = np.where(kind > 0, self.stand_in[kind], word)
        template = rolling(typed, self.window, 0x2545F4914F6CDD1D)
        exact = rolling(second, self.window, 0x27BB2EE687B0B0FD)
        place = within_rows(row, self.window)
        return {"row": row[place], "place": place, "template": template[place], "exact": exact[place]}

    def slots(self, read: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """The tokens, where runs of placeholders of one type are one: row, type, hash of what stands there, words; and by window of ``SPAN`` tokens its place and template."""
        word, _, row, kind = read
        if not len(word):
            none = np.zeros(0, np.int64)
            return {"row": none, "kind": none, "slot": none.astype(np.uint64), "words": none, "place": none, "template": none.astype(np.uint64)}
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (row[1:] != row[:-1]))
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(word)))
        with np.errstate(over="ignore"):
            turn = powers(0x9E3779B97F4A7C15, max(2, int(length.max())))[np.arange(len(word)) - np.repeat(begin, length)]
            slot = np.add.reduceat(word * turn, begin)
        kind, row = kind[begin], row[begin]
        template = rolling(np.where(kind > 0, self.stand_in[kind], slot), SPAN, 0x2545F4914F6CDD1D)
        place = within_rows(row, SPAN)
        return {"row": row, "kind": kind, "slot": slot, "words": length, "place": place, "template": template[place]}


def within_rows(row: np.ndarray, window: int) -> np.ndarray:
    """The places of windows that lie in one row."""
    n = len(row) - window + 1
    return np.flatnonzero(row[window - 1 :] == row[:n]) if n > 0 else np.zeros(0, np.int64)


class Lookup:
    """Places of equal hashes: sorted, with a small bitmap before the search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def meet(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all meetings the number of the given hash and of the known one."""
        near = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[near], "left")
        count = np.searchsorted(self.hashes, hashes[near], "right") - low
        near, low, count = near[count > 0], low[count > 0], count[count > 0]
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        other = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        return np.repeat(near, count), self.order[other]


def adjoining(row: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order of window meetings by (row, item, diagonal, place), and the spans of it in which each is the next of the one before."""
    order = np.lexsort((a, a - b, item, row))
    row, item, a, b = row[order], item[order], a[order], b[order]
    new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(a) != 1) | (np.diff(b) != 1))) if len(a) else np.zeros(0, np.int64)
    return order, list(zip(new.tolist(), [*new[1:].tolist(), len(a)]))


def longest_copy(kind: np.ndarray, mine: np.ndarray, other: np.ndarray, words: np.ndarray) -> int:
    """The item's words in the longest stretch of two runs of tokens with equal templates in which equal slots of the item
    are equal in the copy, at least one slot differs, and enough tokens are plain words; 0 if there is none."""
    last: dict[int, int] = {}
    start = best = 0
    total, plain, differ = (np.append(0, np.cumsum(x)) for x in (words, kind == 0, mine != other))
    for e in range(len(kind)):
        if kind[e]:
            p = last.get(int(other[e]), -1)
            if p >= start and mine[p] != mine[e]:
                start = p + 1
            last[int(other[e])] = e
        if differ[e + 1] > differ[start] and plain[e + 1] - plain[start] >= PLAIN_SHARE * (e + 1 - start):
            best = max(best, int(total[e + 1] - total[start]))
    return best


def enough(words: int, item_words: int) -> bool:
    return words >= min(CHANGED_WORDS, CHANGED_SHARE * item_words)


class Leaks:
    """The windows of the held-out items, looked up by template."""

    def __init__(self, ids: list[int], texts: list[str | None], names: list[str] | np.ndarray = [], window: int = WINDOW, changed: bool = True) -> None:
        self.reader = Reader(names, window)
        read = self.reader.words(pa.array([t or "" for t in texts], pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.own = self.reader.windows(read)
        self.exactly = Lookup(self.own["template"])
        self.length = np.bincount(read[2], minlength=len(ids))
        if changed:
            self.tokens = self.reader.slots(read)
            self.changed = Lookup(self.tokens["template"])

    def exact_pairs(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, item) that share a window word for word."""
        w = self.reader.windows(self.reader.words(text))
        mine, other = self.exactly.meet(w["template"])
        same = w["exact"][mine] == self.own["exact"][other]
        both = np.unique(np.stack([w["row"][mine[same]].astype(np.int64), self.own["row"][other[same]].astype(np.int64)], 1), axis=0)
        return both[:, 0], self.ids[both[:, 1]]

    def runs(self, text: pa.Array) -> list[tuple[int, int, str, int]]:
        """``(row, item, kind, words)``: the longest exact passage of each pair, or else the longest passage
        that is equal but for a consistent change of slots."""
        read = self.reader.words(text)
        w = self.reader.windows(read)
        mine, other = self.exactly.meet(w["template"])
        same = w["exact"][mine] == self.own["exact"][other]
        mine, other = mine[same], other[same]
        row, item = w["row"][mine], self.own["row"][other]
        order, spans = adjoining(row, item, w["place"][mine], self.own["place"][other])
        best: dict[tuple[int, int], tuple[str, int]] = {}
        for x, y in spans:
            pair = int(row[order[x]]), int(item[order[x]])
            best[pair] = max(best.get(pair, ("exact", 0)), ("exact", y - x + self.reader.window - 1))
        t, own = self.reader.slots(read), self.tokens
        mine, other = self.changed.meet(t["template"])
        a, b = t["place"][mine], own["place"][other]
        row, item = t["row"][a], own["row"][b]
        order, spans = adjoining(row, item, a, b)
        for x, y in spans:
            pair = int(row[order[x]]), int(item[order[x]])
            if best.get(pair, ("",))[0] == "exact":
                continue
            at, to, n = int(a[order[x]]), int(b[order[x]]), y - x + SPAN - 1
            words = longest_copy(own["kind"][to : to + n], t["slot"][at : at + n], own["slot"][to : to + n], own["words"][to : to + n])
            if words and enough(words, int(self.length[pair[1]])):
                best[pair] = max(best.get(pair, ("reparameterised", 0)), ("reparameterised", words))
        return [(r, int(self.ids[i]), kind, n) for (r, i), (kind, n) in best.items()]


def lexicon(*tables: DataFrame) -> np.ndarray:
    """The words of the names in tables (brands, shops) as a bitmap of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "name"):
            yield pa.RecordBatch.from_arrays([pa.array(words_of(*to_codepoints(text_column(b.column("name"))))[0].view(np.int64))], names=["h"])

    out = np.zeros(BITS >> 6, np.uint64)
    for t in tables:
        out |= bitmap(t.select("name").where("name is not null").mapInArrow(run, "h long"), "h")
    return out


CACHE: dict[str, Leaks] = {}


def leaks_of(shared) -> Leaks:
    """The items' windows, made once per worker."""
    key, *rest = shared.value
    if key not in CACHE:
        CACHE.clear()
        CACHE[key] = Leaks(*rest)
    return CACHE[key]


def collected(items: DataFrame, item_id: str, text: str) -> tuple[list[int], list[str]] | None:
    """Ids and texts of the items, or None if they have too many windows to be broadcast."""
    words = items.select(F.sum(F.size(F.split(text, r"[^\p{L}\p{N}]+")))).first()[0] or 0
    if words > MOST_WINDOWS:
        return None
    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), text).collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def windows_table(df: DataFrame, row_id: str, text: str, names: list[str] | np.ndarray, kind: str, wanted: np.ndarray | None = None) -> DataFrame:
    """``(id, template, place, exact, kinds, slots, words, length)`` of all windows, for items too many to be broadcast: those of words ('exact') have
    an exact hash, those of tokens ('changed') what stands in them; ``length`` is the text's in words.  Only with templates in the bitmap ``wanted`` if there is one."""
    shared = df.sparkSession.sparkContext.broadcast((names, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bits = Reader(shared.value[0]), shared.value[1]
        for b in pieces(batches, "text"):
            read = reader.words(text_column(b.column("text")))
            w = reader.windows(read) if kind == "exact" else reader.slots(read)
            keep = np.flatnonzero(in_bitmap(w["template"], bits)) if bits is not None else np.arange(len(w["template"]))
            place = w["place"][keep]
            row = w["row"][keep] if kind == "exact" else w["row"][place]
            length = np.bincount(read[2], minlength=b.num_rows)[row]
            none = np.zeros((len(keep), 0), np.int64)
            many = [none] * 3 if kind == "exact" else [w[c][place[:, None] + np.arange(SPAN)].astype(np.uint64).view(np.int64) for c in ("kind", "slot", "words")]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in many]
            exact = w["exact"][keep].view(np.int64) if kind == "exact" else np.zeros(len(keep), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(w["template"][keep].view(np.int64)), pa.array(place.astype(np.int64)), pa.array(exact), *lists, pa.array(length.astype(np.int64))], names=["id", "template", "place", "exact", "kinds", "slots", "words", "length"])

    lean = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    return lean.mapInArrow(run, "id long, template long, place long, exact long, kinds array<long>, slots array<long>, words array<long>, length long")


def joined_windows(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, names: list[str] | np.ndarray, kind: str) -> DataFrame:
    """The windows of documents beside those of items with equal templates, the items' columns named with ``o_``."""
    other = cut(windows_table(items, item_id, text, names, kind))
    mine = windows_table(docs, doc_id, text, names, kind, bitmap(other, "template"))
    renamed = other.select(F.col("id").alias("item_id"), "template", *(F.col(c).alias(f"o_{c}") for c in ("place", "exact", "slots", "words", "length")))
    return mine.withColumnRenamed("id", "doc_id").join(renamed, "template")


def found(docs: DataFrame, items: DataFrame, names: list[str] | np.ndarray = [], doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, doc_id)`` of all pairs that share ``WINDOW`` consecutive words; names may be left out, they change no row."""
    held = collected(items, item_id, text)
    if held is None:
        return joined_windows(docs, items, doc_id, item_id, text, names, "exact").where("exact = o_exact").select("item_id", "doc_id").distinct()
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *held, names, WINDOW, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = leaks_of(shared)
        for b in pieces(batches, "text"):
            row, item = leaks.exact_pairs(text_column(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(item), b.column("doc_id").take(pa.array(row))], names=["item_id", "doc_id"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, doc_id long")


def passages(docs: DataFrame, items: DataFrame, names: list[str] | np.ndarray = [], doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, doc_id, kind, n_words)``: exact leaks, and copies with other numbers, names or units."""
    held = collected(items, item_id, text)
    if held is None:
        return joined_passages(docs, items, names, doc_id, item_id, text)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *held, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = leaks_of(shared)
        for b in pieces(batches, "text"):
            out = leaks.runs(text_column(b.column("text")))
            ids = b.column("doc_id").take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int64()), ids, pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.int32())], names=["item_id", "doc_id", "kind", "n_words"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, doc_id long, kind string, n_words int")


PASSAGE = "item_id long, doc_id long, kind string, n_words int"


def joined_passages(docs: DataFrame, items: DataFrame, names: list[str] | np.ndarray, doc_id: str, item_id: str, text: str) -> DataFrame:
    """The same from joined windows, for items of any number; the meetings of one document with one item are put together in one task."""

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["place"].to_numpy(), pdf["o_place"].to_numpy()
        none = np.zeros(len(a), np.int64)
        _, spans = adjoining(none, none, a, b)
        return pd.DataFrame([(pdf["item_id"].iloc[0], pdf["doc_id"].iloc[0], "exact", max(y - x for x, y in spans) + WINDOW - 1)])

    def changed(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["place"].to_numpy(), pdf["o_place"].to_numpy()
        none = np.zeros(len(a), np.int64)
        order, spans = adjoining(none, none, a, b)
        kinds, mine, other, words = (np.stack(pdf[c].to_numpy())[order] for c in ("kinds", "slots", "o_slots", "o_words"))
        best = 0
        for x, y in spans:
            whole = lambda m: np.append(m[x:y, 0], m[y - 1, 1:])  # noqa: B023, E731
            best = max(best, longest_copy(whole(kinds), whole(mine), whole(other), whole(words)))
        ok = best and enough(best, int(pdf["o_length"].iloc[0]))
        return pd.DataFrame([(pdf["item_id"].iloc[0], pdf["doc_id"].iloc[0], "reparameterised", best)] if ok else [], columns=["item_id", "doc_id", "kind", "n_words"])

    key = ["doc_id", "item_id"]
    same = joined_windows(docs, items, doc_id, item_id, text, names, "exact").where("exact = o_exact")
    first = same.select(*key, "place", "o_place").groupBy(*key).applyInPandas(exact, PASSAGE)
    like = joined_windows(docs, items, doc_id, item_id, text, names, "changed").select(*key, "place", "o_place", "kinds", "slots", "o_slots", "o_words", "o_length")
    second = like.groupBy(*key).applyInPandas(changed, PASSAGE)
    first = cut(first)
    return first.unionByName(second.join(first.select(*key), key, "left_anti"))


def by_item(leaks: DataFrame) -> DataFrame:
    """``(item_id, n_docs)``: the items that leaked, and into how many documents."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
