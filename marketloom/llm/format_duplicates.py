"""Records equal but for formatting (problem 2).

Method: the characters of a batch stream through a skip-and-fold table (white space, punctuation
and signs are skipped, letters fold to lower case) into rolling polynomial hashes, in which a skipped
character takes no place; no canonical string or array is built.  Each field of a name, the path of a
URL and each of its parameters have a hash; those of the fields and of the parameters are added up, as
their order is free.  Rows with equal hashes are verified against one representative by a two-pointer
comparison that skips and folds as it goes.  A copy can also lose or gain a separator, which changes its
fields; so the representatives of one URL that have the same letters (a sum over the characters) meet in a
second comparison, in which fields may move and join.

Scale: one pass makes ``(id, hashes)``; counts per hash are combined before the shuffle and only
hashes are shuffled.  Texts move for rows whose hash occurs twice: the scan is sifted by a bitmap of
fixed size of those rows before anything is shuffled (with far more candidates than bits it lets all rows
pass, and the join alone decides).  Each candidate is compared with one representative
(linear in the group, never all pairs); the second comparison sees one row per field hash.  Records that share all
letters but differ go into further rounds, from round ROUNDS on with up to AT_ONCE representatives a hash,
until no row is left.  A hot group is split by AQE's skew join, as only its representatives are on the other side.

Defined results: rows with a null id, name or URL are records of their own and take no part in
groups; an empty name equals a blank one; byte-equal rows count as copies, also under one id; ties for the
representative go to the smallest id.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.codepoints import TOP, mix64, pieces, powers, spread64, text_column, to_codepoints
from marketloom.session import cut

BASE = 0x9E3779B97F4A7C15 | 5
EQUALS = np.uint64(0xC2B2AE3D27D4EB4F)  # the sign between a parameter and its value
BITS = 1 << 26  # of the bitmap that sifts rows before a join
ROUNDS = 6  # records that share all letters but differ, one after another
AT_ONCE = 16  # rows of a hash that later rounds take their representatives from


@lru_cache(None)
def fold_table() -> np.ndarray:
    """For every code point 0 (skipped) or the code point it folds to."""
    table = np.zeros(TOP, np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and ud.category(chr(c))[0] in "LNM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(None)
def weights() -> np.ndarray:
    """The term of every code point in a rolling hash; 0 if it is skipped."""
    table = fold_table()
    return np.where(table > 0, spread64(1)[table], np.uint64(0))


@lru_cache(None)
def marks() -> dict[str, np.ndarray]:
    """White space, separators that need no space, and dashes and slashes that need one on both sides."""
    space, always, spaced = (np.zeros(TOP, bool) for _ in range(3))
    space[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = True
    always[[ord(c) for c in "|;"]] = True
    spaced[[ord(c) for c in "-/–—"]] = True
    return {"space": space, "always": always, "spaced": spaced}


def row_starts(at: np.ndarray) -> np.ndarray:
    """The first places of the rows that are not empty."""
    return at[:-1][at[:-1] < at[1:]]


def rolled(terms: np.ndarray, kept: np.ndarray, begin: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """The rolling polynomial hash of each segment; characters that are not kept take no place, a segment without any has 0."""
    before = np.cumsum(kept) - kept
    length = np.diff(np.append(begin, len(terms)))
    place = before - np.repeat(before[begin], length)
    n = np.add.reduceat(kept.astype(np.int64), begin)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(terms * powers(BASE, 1 << max(6, int(n.max()).bit_length()))[place], begin)
        h = mix64(h + n.astype(np.uint64) + (np.uint64(0) if salt is None else salt))
    return np.where(n > 0, h, np.uint64(0))


def row_sums(values: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sums of the segments' values by row, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:], dtype=np.uint64)
        return total[np.searchsorted(begin, at[1:])] - total[np.searchsorted(begin, at[:-1])]


def name_hashes(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each name the sum of its fields' rolling hashes, and a sum over its letters, which moved or lost separators leave as it is."""
    if not len(points):
        return np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
    t = marks()
    terms = weights()[points]
    kept = fold_table()[points] > 0
    space = t["space"][points]
    before, after = np.append(True, space[:-1]), np.append(space[1:], True)
    starts = row_starts(at)
    before[starts] = True
    after[starts[1:] - 1] = True
    split = t["always"][points] | (points == 44) & after | t["spaced"][points] & after & before
    split[starts] = True
    begin = np.flatnonzero(split)
    each = np.arange(len(points))
    return mix64(row_sums(rolled(terms, kept, begin), begin, at)), mix64(row_sums(terms, each, at))


def url_hashes(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each URL the sum of the rolling hashes of its path and of its parameters."""
    if not len(points):
        return np.zeros(len(at) - 1, np.uint64)
    starts = row_starts(at)
    mark = points == 63
    seen = np.cumsum(mark)
    tail = seen > np.repeat(np.append(0, seen)[at[:-1]], np.diff(at))  # from the first question mark on
    split = tail & (mark | (points == 38) | (points == 59))
    split[starts] = True
    begin = np.flatnonzero(split)
    equal = tail & (points == 61)  # counts inside a parameter
    terms = np.where(equal, EQUALS, weights()[points])
    salt = np.where(tail[begin], np.uint64(0x5BD1E995), np.uint64(0))
    return mix64(row_sums(rolled(terms, equal | (fold_table()[points] > 0), begin, salt), begin, at))


def fields(name: str) -> list[tuple[int, int]]:
    """The spans between separators of a name: | ; and, beside white space, , - / and dashes."""
    cuts, begin = [], 0
    for i, ch in enumerate(name):
        space = i + 1 == len(name) or name[i + 1].isspace()
        if ch in "|;" or ch == "," and space or ch in "-/–—" and space and (not i or name[i - 1].isspace()):
            cuts.append((begin, i))
            begin = i + 1
    return [*cuts, (begin, len(name))]


def same_run(a: str, i: int, end: int, b: str, j: int, fold: np.ndarray) -> int:
    """Two pointers: the place in ``b`` after all kept characters of ``a[i:end]``, or -1."""
    n = len(b)
    while True:
        while i < end and not fold[ord(a[i])]:
            i += 1
        if i == end:
            return j
        while j < n and not fold[ord(b[j])]:
            j += 1
        if j == n or fold[ord(a[i])] != fold[ord(b[j])]:
            return -1
        i += 1
        j += 1


def rest_empty(b: str, j: int, fold: np.ndarray) -> bool:
    return all(not fold[ord(ch)] for ch in b[j:])


def same_name(a: str, b: str) -> bool:
    """Whether ``b`` is made of the fields of ``a`` in some order, or ``a`` of those of ``b``."""
    if a == b:
        return True
    fold = fold_table()

    def made_of(x: str, y: str) -> bool:
        spans: dict[str, tuple[int, int]] = {}
        count: dict[str, int] = {}
        for s in fields(x):
            if kept := "".join(chr(fold[ord(ch)]) for ch in x[s[0] : s[1]] if fold[ord(ch)]):
                spans.setdefault(kept, s)
                count[kept] = count.get(kept, 0) + 1
        # depth first over the unused fields, equal ones counted; a field that fits is nearly always the only one
        kinds = list(spans.values())
        stack = [(0, tuple(count.values()))]
        seen = set(stack)  # no state is tried twice, so that the search ends without a limit of steps
        while stack:
            j, left = stack.pop()
            if not any(left):
                if rest_empty(y, j, fold):
                    return True
                continue
            for k in reversed(range(len(kinds))):
                if left[k] and (to := same_run(x, *kinds[k], y, j, fold)) >= 0 and (state := (to, (*left[:k], left[k] - 1, *left[k + 1 :]))) not in seen:
                    seen.add(state)
                    stack.append(state)
        return False

    end = same_run(a, 0, len(a), b, 0, fold)
    return end >= 0 and rest_empty(b, end, fold) or made_of(a, b) or made_of(b, a)


def same_url(a: str, b: str) -> bool:
    """Equal paths and equal parameters in any order."""
    if a == b:
        return True
    fold = fold_table()

    def cut_up(u: str) -> tuple[str, list[str]]:
        path, _, tail = u.partition("?")
        return path, [p for p in tail.replace("?", "&").replace(";", "&").split("&") if not rest_empty(p.replace("=", ""), 0, fold) or "=" in p]

    def same(x: str, y: str) -> bool:
        end = same_run(x, 0, len(x), y, 0, fold)
        return end >= 0 and rest_empty(y, end, fold)

    def same_parameter(x: str, y: str) -> bool:
        p, q = x.split("="), y.split("=")
        return len(p) == len(q) and all(map(same, p, q))

    (path_a, tail_a), (path_b, tail_b) = cut_up(a), cut_up(b)
    if len(tail_a) != len(tail_b) or not same(path_a, path_b):
        return False
    left = list(tail_b)
    for p in tail_a:
        k = next((k for k, q in enumerate(left) if same_parameter(p, q)), -1)
        if k < 0:
            return False
        left.pop(k)
    return True


def hashed(df: DataFrame, row_id: str, name: str, url: str) -> DataFrame:
    """``(id, key, fields, letters)`` of all rows that have an id, a name and a URL: the key tells rows of one id apart, the
    other two hash the URL with the name's fields and with its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "name"):
            own, letters = name_hashes(*to_codepoints(text_column(b.column("name"))))
            address = url_hashes(*to_codepoints(text_column(b.column("url"))))
            both = (mix64(h ^ (address >> np.uint64(1))).view(np.int64) for h in (own, letters))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *map(pa.array, both)], names=["id", "key", "fields", "letters"])

    return texts(df, row_id, name, url).mapInArrow(run, "id long, key long, fields long, letters long")


def texts(df: DataFrame, row_id: str, name: str, url: str) -> DataFrame:
    lean = df.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(name, url).alias("key"), F.col(name).alias("name"), F.col(url).alias("url"))
    return lean.where("id is not null and name is not null and url is not null")


def sifted(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose value is not in ``wanted``: a bitmap of ``BITS`` bits in a join that has at most
    ``BITS / 64`` rows on its broadcast side, however many values there are."""
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bitmap = wanted.select(word.alias("__marketloom_word"), bit.alias("b")).groupBy("__marketloom_word").agg(F.bit_or("b").alias("__marketloom_bits"))
    marked = rows.withColumn("__marketloom_word", word).join(F.broadcast(bitmap), "__marketloom_word")
    return marked.where(F.col("__marketloom_bits").bitwiseAND(bit) != 0).drop("__marketloom_word", "__marketloom_bits")


def same_record(name: list[str], url: list[str], rep_name: list[str], rep_url: list[str]) -> pa.Array:
    return pa.array([same_url(u, v) and same_name(n, m) for n, m, u, v in zip(name, rep_name, url, rep_url)], pa.bool_())


ROW = ["id", "letters", "name", "url"]
COMPARED = "id long, letters long, name string, url string, rep long, same boolean"


def compared(candidates: DataFrame) -> DataFrame:
    """``(id, letters, name, url, rep, same)``: each candidate beside the row that its column ``rep`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = same_record(*(b.column(c).to_pylist() for c in ("name", "url", "rep_name", "rep_url")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*ROW, "rep")), same], names=[*ROW, "rep", "same"])

    leaders = candidates.where("id = rep").groupBy("rep", "rep_key").agg(F.first("name").alias("rep_name"), F.first("url").alias("rep_url"))
    return candidates.join(leaders, ["rep", "rep_key"]).select(*ROW, "rep", "rep_name", "rep_url").mapInArrow(run, COMPARED)


def compared_at_once(candidates: DataFrame) -> DataFrame:
    """As :func:`compared` by letters, with several representatives: those of the first AT_ONCE rows of a hash that
    are no copies of each other, in the order of their ids.  A row has the first one it is the same as."""
    kind = "array<struct<id: bigint, name: string, url: string>>"

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows in b.column("leaders").to_pylist():
                kept: list[dict] = []
                for r in rows:
                    if not any(same_url(r["url"], k["url"]) and same_name(k["name"], r["name"]) for k in kept):
                        kept.append(r)
                out.append(kept)
            yield pa.RecordBatch.from_arrays([b.column("letters"), pa.array(out, b.schema.field("leaders").type)], names=["letters", "leaders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                name, url, leaders = (b.column(c).to_pylist() for c in ("name", "url", "leaders"))
                rep = [next((k["id"] for k in ks if same_url(u, k["url"]) and same_name(k["name"], n)), None) for n, u, ks in zip(name, url, leaders)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ROW), pa.array(rep, pa.int64()), pa.array([r is not None for r in rep], pa.bool_())], names=[*ROW, "rep", "same"])

    order = W.partitionBy("letters").orderBy("id")
    first = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= AT_ONCE)
    leaders = first.groupBy("letters").agg(F.sort_array(F.collect_list(F.struct("id", "name", "url"))).alias("leaders")).mapInArrow(leading, f"letters long, leaders {kind}")
    return candidates.join(leaders, "letters").select(*ROW, "leaders").mapInArrow(run, COMPARED)


def by_smallest_id(rows: DataFrame, of: str) -> DataFrame:
    """``rows`` with ``rep``, the smallest id of their hash ``of``."""
    return rows.join(rows.groupBy(of).agg(F.min("id").alias("rep")), of)


def rounds(left: DataFrame) -> list[DataFrame]:
    """``(id, rep)`` of rows ``(id, letters, name, url)``, a part per round: all rows of a record have the smallest id among them."""
    parts: list[DataFrame] = []
    for n in itertools.count():  # each round removes at least the smallest id of every hash
        done = cut(compared(by_smallest_id(left, "letters").withColumn("rep_key", F.col("letters"))) if n < ROUNDS else compared_at_once(left))
        parts.append(done.where("same").select("id", "rep"))
        left = done.where("not same").select(*ROW)
        if left.isEmpty():
            return parts


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def members(df: DataFrame, row_id: str = "crawl_id", name: str = "name", url: str = "external_url") -> DataFrame:
    """``(id, rep)`` of every row that has a copy (some rows may be alone); ``rep`` is the smallest id of its record."""
    rows = cut(hashed(df, row_id, name, url))
    twice = rows.groupBy("letters").agg(F.count("*").alias("n")).where("n > 1").select("letters")
    # an inner join, as the optimizer would run a semi join before the bitmap
    ids = cut(sifted(rows, twice, "letters").join(twice, "letters").distinct())
    first = ids.groupBy("fields").agg(F.min(F.struct("id", "key")).alias("r")).select("fields", F.col("r.id").alias("rep"), F.col("r.key").alias("rep_key"))
    several = ids.groupBy("letters").agg((F.min("fields") != F.max("fields")).alias("several"))  # field hashes
    plan = ids.join(first, "fields").join(several, "letters").select("id", "key", "letters", "rep", "rep_key", "several")
    own = cut(sifted(texts(df, row_id, name, url), ids, "id").join(plan, ["id", "key"]))
    done = cut(compared(own))
    equal = done.where("same").select("id", "rep")
    # the representatives of URLs that have one set of letters in several fields, and rows that share a hash by chance, meet again by their letters
    leading = own.where("several and id = rep and key = rep_key").select(*ROW)
    open_ = cut(leading.unionByName(done.where("not same").select(*ROW)))
    if open_.isEmpty():
        return equal
    final = cut(together(rounds(open_)).where("id <> rep").distinct())
    moved = final.select(F.col("id").alias("rep"), F.col("rep").alias("__marketloom_rep"))
    first = equal.join(moved, "rep", "left").select("id", F.coalesce("__marketloom_rep", "rep").alias("rep"))
    alone = done.where("not same").select("id").join(final, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return first.unionByName(alone)


def collapsed(df: DataFrame, row_id: str = "crawl_id", name: str = "name", url: str = "external_url") -> DataFrame:
    """One row per record: its first row's columns and ``copies``, the number of its rows (a column of
    that name is replaced)."""
    of = members(df, row_id, name, url)
    count = of.groupBy("rep").agg(F.count("*").alias("__marketloom_n")).withColumnRenamed("rep", "__marketloom_rep")
    later = of.where("id <> rep").select(F.col("id").alias("__marketloom_later"))
    kept = df.drop("copies").join(later, F.col(row_id) == F.col("__marketloom_later"), "left_anti")
    out = kept.join(count, F.col(row_id) == F.col("__marketloom_rep"), "left").withColumn("copies", F.coalesce("__marketloom_n", F.lit(1)))
    return out.drop("__marketloom_n", "__marketloom_rep")


def pairs(of: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of the rows of one record: the form TESTDATA.md fixes."""
    return of.select(F.col("id").alias("id_a"), "rep").join(of.select(F.col("id").alias("id_b"), "rep"), "rep").where("id_a < id_b").select("id_a", "id_b")
