"""Free-entered values mapped to the entries of a reference list (problem 1).

Method: a symmetric-delete dictionary of the reference list (every key with up to two letters
deleted, as sorted 64-bit hashes) is broadcast; a value's own deletes meet those of all entries within the bounded edit
distance.  Keys of over ``SHORT`` letters have too many deletes; they are cut into five pieces, one of which two edits
leave whole, and a value's pieces at the places it may have moved to meet those.  Candidates are ranked by weighted Damerau-Levenshtein distance (keys that lie side by
side on a keyboard, doubled letters and swaps cost less), then by how often the entry occurs in
the data, then by its id.  Misses are reported with reference -1.

Scale: the reference list is collected only if its deletes, which are counted first, are at most ``MOST_HASHES`` (12 bytes
each), beyond that the same deletes are joined as a table (:func:`mapped_by_join`), with the same results.  Values are resolved where they
are read, once per distinct value and task (a memo of bounded size), so nothing is shuffled and a
value that a third of all rows share costs one lookup per task.

Defined results: null and blank values take no part; a value that is byte for byte an entry takes
no part in :func:`found` and maps to that entry in :func:`mapped`; of entries with equal names the
smallest id stands for all, entries without an id or a name or with signs only for nothing; values that say "none" or "other" map to -1; very long values cannot
be within two edits of an entry and map to -1 unless their last path element does.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import cut

MOST_HASHES = 4_000_000
ENTRY_HASHES = 20  # what an entry's name and id take beside its deletes
MOST_EDITS = 2
MEMO = 200_000
SHORT = 40  # letters of a key that is looked up by deletes
PIECES = 5  # of a longer key; two swaps of neighbours reach four of them at most
# Fixed value: what is no white space, as Python strips it.
FILLED = r"[^\t\n\x0B\f\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Values that denote no entry, without accents and separators.
NOTHING = frozenset(
    "na none null nil unknown other others misc miscellaneous oem nobrand unbranded generic khac khongro khongthuonghieu khongco "
    "hanggiacong chuaphanloai linhtinh uncategorized uncategorised default".split()
)
# Words that sellers put before or after a name, without accents.
BEFORE = ("thuong hieu", "nhan hieu", "nhan hang", "nha san xuat", "hang san xuat", "brand", "brand name", "by", "hang", "nsx", "danh muc", "category", "mua", "ban", "cua hang")
AFTER = (
    "chinh hang", "official store", "official", "store", "flagship store", "co ltd", "co", "ltd", "inc", "jsc", "tm", "vn", "viet nam", "vietnam", "cac loai", "gia re", "gia tot",
    "hang moi", "moi", "html", "authentic", "genuine", "cao cap", "khuyen mai", "tot nhat",
)
# A keyboard's rows, for letters that are typed one for another.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEAR: dict[str, set[str]] = defaultdict(set)
for _r, _row in enumerate(ROWS):
    for _i, _c in enumerate(_row):
        for _other, _places in ((_row, (_i - 1, _i + 1)), (ROWS[_r + 1] if _r < 2 else "", (_i - 1, _i))):
            for _j in _places:
                if 0 <= _j < len(_other):
                    NEAR[_c].add(_other[_j])
                    NEAR[_other[_j]].add(_c)


def bare(text: str) -> str:
    """Lower case, without accents, compatibility forms resolved, other signs as one space."""
    text = ud.normalize("NFKD", text.replace("™", " ").replace("®", " ").replace("©", " ")).lower().replace("đ", "d")
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in text if not ud.combining(c))).strip()


def accents(text: str) -> str:
    """Lower case letters and digits with accents, composed."""
    return re.sub(r"[\W_]+", "", ud.normalize("NFC", ud.normalize("NFKC", text)).lower())


def undecorated(words: str) -> Iterator[str]:
    """The words, then without what sellers put before and after a name, in every amount."""
    seen, todo = set(), deque([words])
    while todo:
        w = todo.popleft()
        if not w or w in seen:
            continue
        seen.add(w)
        yield w
        todo += [w[len(b) + 1 :] for b in BEFORE if w.startswith(b + " ")]
        todo += [w[: -len(a) - 1] for a in AFTER if w.endswith(" " + a)]


def forms(value: str) -> list[str]:
    """The spellings of a value to look up: its last path element first, most complete ones first."""
    value = value.strip()
    steps = [s for s in re.split(r"\s*(?:>|»|›|\||\\|/|→|::)\s*", value) if bare(s) and bare(s) != "html"]
    last = steps[-1] if len(steps) > 1 else value
    last = re.sub(r"\.html?$", "", last.strip("/ "), flags=re.I)
    out = list(undecorated(bare(last)))
    for part in re.split(r"[;(\[]", last)[:1]:
        out += undecorated(bare(part))
    return list(dict.fromkeys(w for w in out if w))


def deletes(key: str, most: int) -> Iterator[str]:
    """The key with up to ``most`` letters deleted, itself included."""
    for n in range(min(most, len(key) - 1) + 1):
        for gone in combinations(range(len(key)), n):
            yield "".join(c for i, c in enumerate(key) if i not in gone)


def turned(split: list[str]) -> Iterator[str]:
    """The keys of the words in every rotation, as they are first."""
    for i in range(len(split)):
        yield "".join(split[i:] + split[:i])


def piece_bounds(n: int) -> list[int]:
    return [k * n // PIECES for k in range(PIECES + 1)]


def entry_lookups(key: str) -> set[str]:
    """What an entry's key is found by: its deletes, or the pieces of a long one."""
    if len(key) <= SHORT:
        return set(deletes(key, edits_allowed(key)))
    at = piece_bounds(len(key))
    return {f"{len(key)} {k} {key[at[k] : at[k + 1]]}" for k in range(PIECES)}


def value_lookups(key: str) -> set[str]:
    """What a value's key finds entries within the bounded distance by."""
    out = set(deletes(key, edits_allowed(key))) if 0 < len(key) <= SHORT + MOST_EDITS else set()
    for n in range(max(SHORT + 1, len(key) - MOST_EDITS), len(key) + MOST_EDITS + 1):
        at = piece_bounds(n)
        for k in range(PIECES):
            for begin in range(max(0, at[k] - MOST_EDITS), at[k] + MOST_EDITS + 1):
                if begin + at[k + 1] - at[k] <= len(key):
                    out.add(f"{n} {k} {key[begin : begin + at[k + 1] - at[k]]}")
    return out


def edits_allowed(key: str) -> int:
    return 0 if len(key) < 3 else 1 if len(key) < 6 else MOST_EDITS


def distance(a: str, b: str, most: int = MOST_EDITS) -> tuple[int, float]:
    """Damerau-Levenshtein distance (adjacent swaps), plain and weighted; beyond ``most`` it is (99, 99).  Only a band of the matrix is filled."""
    if abs(len(a) - len(b)) > most:
        return 99, 99.0
    far = (99, 99.0)
    before, row = [far] * (len(b) + 1), [(j, j * 1.0) if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [far] * (len(b) + 1)
        if i <= most:
            row[0] = (i, i * 1.0)
        twice_a = i > 1 and a[i - 2] == x
        low, high = max(1, i - most), min(len(b), i + most)
        for j in range(low, high + 1):
            y = b[j - 1]
            near = 0.0 if x == y else 0.7 if y in NEAR[x] else 1.0
            best = min(
                (before[j - 1][0] + (x != y), before[j - 1][1] + near),
                (before[j][0] + 1, before[j][1] + (0.6 if twice_a else 1.0)),
                (row[j - 1][0] + 1, row[j - 1][1] + (0.6 if j > 1 and b[j - 2] == y else 1.0)),
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, (two[j - 2][0] + 1, two[j - 2][1] + 0.7))
            row[j] = best
        if min(row[max(0, i - most) : high + 1])[0] > most:
            return far
    return row[-1] if row[-1][0] <= most else far


def hashes_of(lookups: set[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in lookups), np.uint64, len(lookups))


class Dictionary:
    """A symmetric-delete dictionary of a reference list ``[(id, name, frequency)]``."""

    def __init__(self, entries: list[tuple[int, str, int]]) -> None:
        self.by_key: dict[str, list[tuple[int, str]]] = defaultdict(list)
        self.by_words: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.names: dict[str, int] = {}
        self.often: dict[int, int] = {}
        self.longest = 0
        self.keys: list[str] = []
        looked: list[np.ndarray] = []
        for i, name, often in sorted((e for e in entries if e[1] and bare(e[1])), key=lambda e: e[0]):
            words = bare(name)
            key = words.replace(" ", "")
            if name in self.names:
                continue
            self.names[name] = i
            self.often[i] = often
            if key not in self.by_key:
                looked.append(hashes_of(entry_lookups(key)))
                self.keys.append(key)
            self.by_key[key].append((i, accents(name)))
            self.longest = max(self.longest, len(key))
            if " " in words:
                self.by_words[tuple(sorted(words.split()))].add(i)

        whose = np.repeat(np.arange(len(looked), dtype=np.int32), [len(x) for x in looked]) if looked else np.zeros(0, np.int32)
        hashes = np.concatenate(looked) if looked else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.whose = hashes[order], whose[order]

    def near(self, key: str) -> set[str]:
        """The entries' keys that share a lookup with a value's key (or, rarely, its hash; the distance decides)."""
        asked = hashes_of(value_lookups(key))
        low, high = np.searchsorted(self.hashes, asked, "left"), np.searchsorted(self.hashes, asked, "right")
        return {self.keys[w] for k in np.flatnonzero(high > low) for w in self.whose[low[k] : high[k]].tolist()}

    def choose(self, keys: list[tuple[float, str]], value: str) -> int:
        """Of keys at a weighted distance the best entry: distance, accents, frequency, id."""
        spelt = accents(value)
        ranked = [(d, spelt != a and a not in spelt, -self.often[i], i) for d, k in keys for i, a in self.by_key[k]]
        return min(ranked)[-1]

    def resolve(self, value: str) -> int:
        """The id of the entry that a value denotes, -1 if none."""
        if value in self.names:
            return self.names[value]
        tried = forms(value)
        if not tried or any(w.replace(" ", "") in NOTHING for w in tried):
            return -1
        tried = [w for w in tried if len(w) - w.count(" ") <= self.longest + MOST_EDITS]  # longer ones are near no entry
        for words in tried:
            if (key := words.replace(" ", "")) in self.by_key:
                return self.choose([(0.0, key)], value)
        for words in tried:
            if len(ids := self.by_words.get(tuple(sorted(words.split())), ())) == 1:
                return next(iter(ids))
        best: list[tuple[float, str]] = []
        for words in tried:
            for t, key in enumerate(turned(words.split())):
                for k in self.near(key):
                    plain, weighted = distance(key, k)
                    if plain <= min(edits_allowed(key), edits_allowed(k)):
                        best.append((weighted + (0.5 if t else 0.0), k))
        return self.choose(best, value) if best else -1


def filled(column: str) -> Column:
    """A column's values, null where they are blank: the same in both ways of mapping."""
    return F.when(F.col(column).rlike(FILLED), F.col(column))


def entries_of(reference: DataFrame, values: DataFrame, column: str) -> list[tuple[int, str, int]] | None:
    """The reference list with frequencies in the data, or None if it has too many deletes to be broadcast."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = sum(len(entry_lookups(bare(x).replace(" ", ""))) + ENTRY_HASHES for x in b.column("name").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    names = reference.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("id"))
    if (names.select("name").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0) > MOST_HASHES:
        return None
    often = values.select(F.col(column).alias("name")).join(F.broadcast(names.select("name")), "name").groupBy("name").agg(F.count("*").alias("often"))
    return [(r["id"], r["name"], r["often"] or 0) for r in names.join(often, "name", "left").collect()]


def mapped(df: DataFrame, row_id: str, columns: dict[str, DataFrame]) -> DataFrame:
    """``(record_id, field, value, ref_id, exact)`` for every filled value of the columns.

    ``columns`` has the reference list (id, name) of each column.  Lists with more than ``MOST_HASHES`` deletes
    are joined instead of broadcast.
    """
    lists = {c: entries_of(ref, df, c) for c, ref in columns.items()}
    small = {c: Dictionary(e) for c, e in lists.items() if e is not None}
    shared = df.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {c: {} for c in shared.value}
        for b in batches:
            for c, lookup in shared.value.items():
                coded = b.column(c).dictionary_encode()
                refs = []
                for v in coded.dictionary.to_pylist():
                    if v not in known[c]:
                        if len(known[c]) >= MEMO:
                            known[c].clear()
                        known[c][v] = lookup.resolve(v)
                    refs.append(known[c][v])
                exact = pc.take(pa.array([v in lookup.names for v in coded.dictionary.to_pylist()], pa.bool_()), coded.indices)
                ref = pc.take(pa.array(refs, pa.int32()), coded.indices)
                keep = pc.is_valid(ref)
                ids, values, ref, exact = (x.filter(keep) for x in (b.column("record_id"), b.column(c), ref, exact))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c] * len(ids), pa.string()), values, ref, exact], names=["record_id", "field", "value", "ref_id", "exact"])

    lean = df.select(F.col(row_id).cast("long").alias("record_id"), *(filled(c).alias(c) for c in columns))
    out = lean.select("record_id", *small).mapInArrow(run, "record_id long, field string, value string, ref_id int, exact boolean")
    for c, ref in columns.items():
        if c not in small:
            out = out.unionByName(mapped_by_join(lean, "record_id", c, ref))
    return out


def mapped_by_join(df: DataFrame, row_id: str, column: str, reference: DataFrame) -> DataFrame:
    """The same for a list of any length: distinct values meet the entries on equal deletes in a join.

    A value's candidate entries are ranked like those of a dictionary made of them alone.
    """

    def entry_marks(name: str) -> set[str]:
        words = bare(name)
        return {"w" + " ".join(sorted(words.split())), *("d" + x for x in entry_lookups(words.replace(" ", "")))} if words else set()

    def value_marks(value: str) -> set[str]:
        out = set()
        for words in {bare(value), *forms(value)} - {""}:
            out.add("w" + " ".join(sorted(words.split())))
            out |= {"d" + x for key in turned(words.split()) for x in value_lookups(key)}
        return out

    def marked(marks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(v, d) for v in b.column("v").to_pylist() for d in marks(v)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["v", "d"])

        return run

    def rank(pdf):  # one distinct value with its candidate entries
        lookup = Dictionary(list(zip(pdf["id"], pdf["name"], pdf["often"])))
        value = pdf["v"].iloc[0]
        return pdf.iloc[:1][["v"]].assign(ref_id=lookup.resolve(value))

    rows = df.select(F.col(row_id).cast("long").alias("record_id"), filled(column).alias("v")).where("v is not null")
    names = reference.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("id"))
    often = rows.groupBy(F.col("v").alias("name")).agg(F.count("*").alias("often"))
    names = names.join(often, "name", "left").fillna(0, ["often"])
    marks = cut(names.select(F.col("name").alias("v")).mapInArrow(marked(entry_marks), "v string, d string").withColumnRenamed("v", "name"))
    keys = names.join(marks, "name")
    values = rows.select("v").distinct()
    candidates = values.mapInArrow(marked(value_marks), "v string, d string").join(keys, "d").select("v", "id", "name", "often").distinct()
    resolved = candidates.groupBy("v").applyInPandas(rank, "v string, ref_id int")
    same = marks.select(F.col("name").alias("v"), F.lit(True).alias("exact")).distinct()
    out = rows.join(resolved, "v", "left").join(same, "v", "left")
    return out.select("record_id", F.lit(column).alias("field"), F.col("v").alias("value"), F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("exact", F.lit(False)).alias("exact"))


def found(df: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """``(record_id, field, ref_id)`` of the values that are not byte for byte an entry."""
    out = mapped(df, "record_id", {"brand_raw": brands, "category_raw": categories})
    return out.where("not exact").select("record_id", F.regexp_replace("field", "_raw$", "").alias("field"), "ref_id")


def misses(df: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """The values that denote no entry, with their numbers of rows."""
    out = mapped(df, "record_id", {"brand_raw": brands, "category_raw": categories}).where("ref_id = -1")
    return out.groupBy("field", "value").agg(F.count("*").alias("n_rows"))
