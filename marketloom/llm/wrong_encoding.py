"""Text read in a wrong encoding (problem 9).

Method: noisy-channel decoding.  A token may have come through a channel: UTF-8 read as one of
several code pages (once or repeatedly), Vietnamese Windows text read as a western code page, or
such text read as UTF-8 with its letters lost.  Under each channel its characters are a lattice of
bytes, with wildcards where a byte was lost; each pass of the channel makes a lattice of characters of it.
A Viterbi search takes the cheapest way through a lattice: words cost what they are rare in the whole
corpus, a run that is no word of the corpus costs most, signs that correct text seldom has cost something.  A second one runs over the tokens
of a document, whose own spelling is one of the channels, with a cost for entering a channel.  Its
path decides: a document is found if it changes a token, and the path is the restored text.

Scale: one pass counts words (combined per slice before the shuffle), one finds tokens with a
second reading.  Tables scan for lead and continuation characters over code-point arrays, so
only damaged documents reach the token code.  Words of readings are joined with the counts once per distinct
token; where bytes are lost, the words that would look like the damaged place are joined on that look, so no reading is
listed and none is left out.  Verdicts are joined back on the token; texts move only for found documents that are to be
restored; nothing is collected, AQE splits tokens that very many documents share.

Defined results: null and empty texts are never found, nor are rows without an id; correct letters of other languages, capitals
before quotes or dots, and foreign words stay, as their own spelling is the likelier word; text
with replacement or C1 control characters is found even if no reading restores it; documents
landed twice are found twice.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.codepoints import TOP, any_in_row, pieces, segment_hash, text_column, to_codepoints
from marketloom.session import cut

CODE_PAGES = ("cp1252", "cp1258", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1250")
CHANNEL_COST = 4.0  # of each span of tokens that came through a channel
TOKEN_COST = 0.8  # of each token that is changed, by pass; a sign less in a reading is worth little more
LONG_GAIN = 6.0  # more than one continuation character a pass in their places hardly ever comes by chance
SIGN_COST = 8.0
LOST = "�"
# Signs that correct text uses.
SIGNS = set("“”‘’‚„–—‒…€₫°«»·•§©®™×½²³£¥ ​‌‍﻿")
# The marks of Vietnamese Windows text and the western letters that stand in their place.
MARKS = {"̀": "Ì", "̉": "Ò", "̃": "Þ", "́": "ì", "̣": "ò"}


@lru_cache(None)
def inverse(page: str) -> tuple[dict[str, int], tuple[int, ...]]:
    """Characters to bytes of a code page, and its bytes without a character."""
    out, lost = {}, []
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            lost.append(b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out, tuple(lost)


@lru_cache(None)
def printable(ch: str) -> bool:
    """Whether correct text may hold a character: any that is assigned but controls."""
    return ud.category(ch) not in ("Cc", "Cn", "Co", "Cs")


Lattice = dict[int, list[tuple[int, str]]]  # node -> arcs (to, character); nodes are places in the token, its end is the last


def chain(token: str) -> Lattice:
    return {i: [(i + 1, ch)] for i, ch in enumerate(token)}


def decoded(arcs: Lattice, end: int, page: str) -> Lattice | None:
    """The lattice that comes of reading the characters' bytes in ``page`` as UTF-8, None if nothing can be decoded.

    A lost byte stands for each byte that the page has no character for.  An arc that begins a whole sequence is
    replaced by what the sequence stands for, others stay."""
    to, lost = inverse(page)
    spare = tuple(b for b in lost if 0x80 <= b < 0xC0)

    def tails(i: int, n: int) -> Iterator[tuple[int, bytes]]:
        if not n:
            yield i, b""
            return
        for j, ch in arcs.get(i, ()):
            for b in spare if ch == LOST else (to[ch],) if 0x80 <= to.get(ch, 0) < 0xC0 else ():
                for k, rest in tails(j, n - 1):
                    yield k, bytes([b]) + rest

    out: Lattice = {}
    any_ = False
    seen, todo = {0}, [0]
    while todo:
        i = todo.pop()
        made: dict[tuple[int, str], None] = {}
        for j, ch in arcs.get(i, ()):
            lead = to.get(ch, 0)
            size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            whole = False
            for k, rest in tails(j, size - 1) if size else ():
                try:
                    c = (bytes([lead]) + rest).decode()
                except UnicodeDecodeError:
                    continue
                if printable(c) or c in to:  # what a second pass can still decode is fine
                    made[k, c] = None
                    whole = any_ = True
            if not whole:
                made[j, ch] = None
        out[i] = sorted(made)
        for j, _ in made:
            if j not in seen and j < end:
                seen.add(j)
                todo.append(j)
    if not any_:
        return None
    alive = {end}
    for i in sorted(out, reverse=True):
        out[i] = [a for a in out[i] if a[0] in alive]
        if out[i]:
            alive.add(i)
    return {i: a for i, a in out.items() if a}


def lattices(token: str, page: str) -> Iterator[Lattice]:
    """The lattices of a token after one pass of a code page, two, and so on until nothing can be decoded."""
    arcs: Lattice | None = chain(token)
    while (arcs := decoded(arcs, len(token), page)) is not None:
        yield arcs


def only_text(arcs: Lattice, end: int) -> str | None:
    """The text of a lattice with one way through, else None."""
    i, out = 0, []
    while i < end:
        if len(arcs[i]) > 1:
            return None
        i, ch = arcs[i][0]
        out.append(ch)
    return "".join(out)


def spells(arcs: Lattice, end: int, text: str) -> bool:
    """Whether a text is one of the ways through a lattice."""
    at = {0}
    for ch in text:
        at = {j for i in at for j, c in arcs.get(i, ()) if c == ch}
    return end in at


def is_letter(ch: str) -> bool:
    return ch.isalpha() or "\u0300" <= ch <= "\u036f"


def slots(arcs: Lattice, end: int) -> dict[tuple[int, int], str]:
    """Where a word may stand in a lattice, and its first spelling: from a place where one can begin over letters to a place where one can end."""
    begins = {0} | {j for a in arcs.values() for j, ch in a if not is_letter(ch)}
    ends = {end} | {i for i, a in arcs.items() if any(not is_letter(ch) for _, ch in a)}
    out: dict[tuple[int, int], str] = {}
    for i in sorted(begins):
        best = {i: ""}
        for k in sorted(x for x in arcs if x >= i):
            if k in best:
                for j, ch in arcs[k]:
                    if is_letter(ch) and j not in best:
                        best[j] = best[k] + ch
        out |= {(i, j): w for j, w in best.items() if j in ends and w}
    return out


def cheapest(arcs: Lattice, end: int, known: dict[tuple[int, int], tuple[str, float]], rare: float) -> tuple[float, str]:
    """The Viterbi way through a lattice: ``known`` has the likeliest word and its cost by slot; other runs of letters cost ``rare``."""
    steps: dict[int, list[tuple[int, float, str]]] = {}
    for (i, j), first in slots(arcs, end).items():
        word, cost = known.get((i, j), (first, rare))
        steps.setdefault(i, []).append((j, cost, word))
    for i, a in arcs.items():
        signs = [(sign_cost(ch), ch, j) for j, ch in a if not is_letter(ch)]
        steps.setdefault(i, []).extend((j, cost, ch) for cost, ch, j in sorted(signs))
    best: dict[tuple[int, bool], tuple[float, str]] = {(0, False): (0.0, "")}  # place, whether a word ends there
    for i in sorted(steps):
        for j, cost, text in steps[i]:
            word = is_letter(text[0])
            for before in (False, True):
                if (i, before) in best and not (word and before):  # a word does not follow a word
                    was = best[i, before]
                    if (j, word) not in best or was[0] + cost < best[j, word][0]:
                        best[j, word] = (was[0] + cost, was[1] + text)
    return min(best[k] for k in ((end, False), (end, True)) if k in best)


@lru_cache(None)
def windows_letters() -> dict[int, str]:
    """Western letters to the characters of Vietnamese Windows text with the same byte."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            a, c = bytes([b]).decode("cp1252"), bytes([b]).decode("cp1258")
        except UnicodeDecodeError:
            continue
        if a != c:
            out[ord(a)] = c
    return out


def readings(token: str) -> Iterator[tuple[str, str | None, Lattice | None]]:
    """``(channel, text, lattice)`` of all second readings of a token; the text is None where lost bytes leave a choice."""
    seen = {token}
    for page in CODE_PAGES:
        for depth, arcs in enumerate(lattices(token, page), 1):
            text = only_text(arcs, len(token))
            if text is None or text not in seen:
                seen.add(text)
                yield f"{page}*{depth}", text, None if text is not None else arcs
    other = ud.normalize("NFC", token.translate(windows_letters()))
    if other not in seen:
        yield "vietnamese", other, None


def garbled(word: str, page: str, depth: int) -> str:
    """How a word looks after so many passes of a channel; bytes without a character are lost."""
    for _ in range(depth):
        word = word.encode().decode(page, "replace")
    return word


WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def sign_cost(ch: str) -> float:
    """The cost of a sign that correct text seldom has."""
    return 0.0 if ch <= "\x7f" else SIGN_COST if ch not in SIGNS else 1.0 if ud.category(ch) != "Cf" else 1.5


@lru_cache(100_000)
def script(ch: str) -> str:
    """The script of a letter, '' of a mark: the first word of its name."""
    return "LATIN" if ch < "\u0250" else "" if ud.category(ch)[0] == "M" else ud.name(ch, "").partition(" ")[0]


def is_latin(ch: str) -> bool:
    return script(ch) in ("LATIN", "")


def odd_signs(text: str) -> float:
    """The cost of a text's signs, and of letters that differ in script from most of their word."""
    foreign = 0
    if not text.isascii():
        for w in WORD.findall(text):
            scripts = Counter(filter(None, map(script, w)))
            foreign += sum(scripts.values()) - max(scripts.values(), default=0)
    return sum(map(sign_cost, WORD.sub("", text))) + SIGN_COST * foreign


@lru_cache(None)
def scan_tables() -> dict[str, np.ndarray]:
    """For every code point: its byte in each code page; letters in lower case; vowels; plausible characters."""
    bytes_of = np.zeros((len(CODE_PAGES), TOP), np.uint8)
    for k, page in enumerate(CODE_PAGES):
        for ch, b in inverse(page)[0].items():
            if len(ch) == 1:
                bytes_of[k, ord(ch)] = b
        bytes_of[k, ord(LOST)] = 0xBF  # some continuation
    lower = np.zeros(TOP, np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and ud.category(ch := chr(c))[0] in "LM":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    good = np.array([c >= 0x80 and printable(chr(c)) for c in range(1 << 16)])
    good[0x80:0xA0] = True  # what a second pass can still decode
    other = np.array([ud.category(chr(c))[0] == "L" and not is_latin(chr(c)) for c in range(1 << 16)])
    ascii_letter = np.zeros(TOP, bool)
    ascii_letter[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
    vowel = np.zeros(TOP, bool)
    vowel[[ord(c) for c in "aeioyAEIOYâêôãõýÂÊÔÃÕÝ"]] = True
    mark = np.zeros(TOP, bool)
    mark[[ord(c) for c in MARKS.values()]] = True
    sure = np.zeros(TOP, bool)
    sure[[ord(c) for c in "ðÐþÞ"]] = True
    broken = np.zeros(TOP, bool)
    broken[0x80:0xA0] = True
    broken[ord(LOST)] = True
    return {"bytes": bytes_of, "lower": lower, "good": good, "other": other, "ascii": ascii_letter, "vowel": vowel, "mark": mark, "sure": sure, "broken": broken}


def sequences(points: np.ndarray) -> np.ndarray:
    """Where a sequence begins that some code page makes of an assigned character in UTF-8; a letter of another script does not
    stand beside a plain Latin one."""
    t = scan_tables()
    hit = np.zeros(len(points), bool)
    high = np.flatnonzero((points[:-1] > 0x7F) & (points[1:] > 0x7F))
    if len(high):
        a, b = points[high], points[high + 1]
        before = t["ascii"][points[np.maximum(high - 1, 0)]]
        c, d = points[np.minimum(high + 2, len(points) - 1)], points[np.minimum(high + 3, len(points) - 1)]
        for table in t["bytes"]:
            x, y, z = table[a].astype(np.int32), table[b].astype(np.int32), table[c].astype(np.int32)
            tail = (y >> 6) == 2
            third = tail & ((z >> 6) == 2)
            made2, made3 = (x & 31) << 6 | y & 63, (x & 15) << 12 | (y & 63) << 6 | z & 63
            two = (x >= 0xC2) & (x < 0xE0) & tail & t["good"][made2] & ~(t["other"][made2] & (before | t["ascii"][c]))
            fits = t["good"][made3] & ~(t["other"][made3] & (before | t["ascii"][d])) | (c == 0xFFFD) | (b == 0xFFFD)
            three = (x >= 0xE0) & (x < 0xF0) & third & ((x > 0xE0) | (y >= 0xA0)) & fits
            four = (x >= 0xF0) & (x < 0xF5) & third & ((table[d] >> 6) == 2)
            hit[high[two | three | four]] = True
    return hit


def western(points: np.ndarray) -> np.ndarray:
    """Letters that Vietnamese Windows text shows when it is read as a western code page."""
    t = scan_tables()
    out = t["sure"][points]
    out[1:] |= t["mark"][points[1:]] & t["vowel"][points[:-1]]
    return out


def suspects(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: whether it holds a sequence that some code page makes of UTF-8, whether it looks
    like Vietnamese Windows text, whether it holds lost bytes or control characters."""
    if len(points) < 2:
        broken = any_in_row(scan_tables()["broken"][points], at)
        return np.zeros(len(at) - 1, bool), np.zeros(len(at) - 1, bool), broken
    return any_in_row(sequences(points), at), any_in_row(western(points), at), any_in_row(scan_tables()["broken"][points], at)


def damaged_places(points: np.ndarray) -> np.ndarray:
    """Characters of such sequences and their neighbours: words there say nothing about the language."""
    if len(points) < 2:
        return np.zeros(len(points), bool)
    out = western(points) | scan_tables()["broken"][points]
    lead = sequences(points)
    for k in range(3):
        out[k:] |= lead[: len(lead) - k]
    out[1:] |= out[:-1].copy()
    out[:-1] |= out[1:].copy()
    return out


SPACE = re.compile(r"[ \t\r\n]+")


def damaged(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, broken, tokens)``: the tokens with a second reading in their order, and whether bytes are lost for sure; of documents with either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in pieces(batches, "text"):
            column = text_column(b.column("text"))
            coded, vietnamese, broken = suspects(*to_codepoints(column))
            out: list[tuple[int, bool, list[str]]] = []
            for r in np.flatnonzero(coded | vietnamese | broken).tolist():
                tokens = []
                for token in SPACE.split(column[r].as_py()):
                    if token.isascii():
                        continue
                    if token not in known:
                        if len(known) > 300_000:
                            known.clear()
                        known[token] = LOST in token or any(True for p in CODE_PAGES for _ in lattices(token, p))
                    if known[token] or vietnamese[r] and any(ord(c) in windows_letters() for c in token):
                        tokens.append(token)
                if tokens or broken[r]:
                    out.append((b.column("doc_id")[r].as_py(), bool(broken[r]), tokens))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.list_(pa.string())))], names=["doc_id", "broken", "tokens"])

    lean = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return lean.mapInArrow(run, "doc_id long, broken boolean, tokens array<string>")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` over all texts: runs of letters in lower case, counted per slice before the shuffle.

    Words at damaged places do not count, so that a damaged text which very many rows repeat does
    not make its own spelling likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = scan_tables()["lower"]
        for b in pieces(batches, "text", 4_000_000):
            points, at = to_codepoints(text_column(b.column("text")))
            folded = lower[points]
            letter = folded > 0
            begin = letter.copy()
            begin[1:] &= ~letter[:-1]
            first = at[:-1][at[:-1] < len(points)]
            begin[first] = letter[first]
            start = np.flatnonzero(begin)
            if not len(start):
                continue
            kept = folded[letter]
            inner = np.flatnonzero(begin[letter])
            length = np.diff(np.append(inner, len(kept)))
            whole = np.flatnonzero(np.add.reduceat(damaged_places(points)[letter].astype(np.int32), inner) == 0)
            _, pick, n = np.unique(segment_hash(kept, inner, 7)[whole], return_index=True, return_counts=True)
            out = [kept[inner[k] : inner[k] + length[k]].tobytes().decode("utf-32-le") for k in whole[pick].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lossy(word: str) -> list[str]:
    """A word of Vietnamese Windows text as UTF-8 readers show it: each of its high bytes is lost."""
    base, marks = "", ""
    for ch in word:
        parts = ud.normalize("NFD", ch)
        tone = [c for c in parts[1:] if c in MARKS]
        rest = ud.normalize("NFC", "".join(c for c in parts if c not in MARKS))
        base += (LOST if rest > "\x7f" else rest) + LOST * len(tone)
        marks += LOST if ch > "\x7f" else ch
    return [x for x in {base, marks} if LOST in x]


PIECE = re.compile(rf"(?:[^\W\d_]|{LOST})+")


def lost_words(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """``(token, piece, word, n)``: the most frequent word for each piece of a token with lost letters."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, p.lower()) for t in b.column("token").to_pylist() for p in set(PIECE.findall(t)) if LOST in p]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["token", "piece"])

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, w, n) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) if not w.isascii() for s in lossy(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["piece", "word", "n"])

    wanted = tokens.where(F.col("token").contains(LOST)).mapInArrow(cut_up, "token string, piece string")
    best = counts.mapInArrow(shapes, "piece string, word string, n long").groupBy("piece").agg(F.max(F.struct(F.col("n"), F.col("word"))).alias("best"))
    return wanted.join(best, "piece").select("token", "piece", F.col("best.word").alias("word"), F.col("best.n").alias("n"))


def scored(tokens: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``(token, channel, reading, cost)`` of the cheapest reading of the tokens under each channel, their own spelling included ('as is')."""
    whole = math.log(total + 1)

    def gain(channel: str, token: str, reading: str) -> float:
        depth = channel.partition("*")[2]
        return TOKEN_COST * int(depth or 1) - (LONG_GAIN if depth and len(token) - len(reading) > int(depth) else 0.0)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("token").to_pylist():
                for channel, r, _ in [("as is", t, None), *readings(t)]:
                    if r is not None:
                        cost = odd_signs(r) + (0 if channel == "as is" else gain(channel, t, r))
                        rows += [(t, channel, r, cost, w) for w in words(r)] or [(t, channel, r, cost, "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))], names=["token", "channel", "reading", "signs", "word"])

    parts = tokens.mapInArrow(expand, "token string, channel string, reading string, signs double, word string")
    surprise = F.when(F.col("word") == "", 0.0).otherwise(whole - F.log(F.coalesce("n", F.lit(0)) + 0.1))
    sure = parts.join(counts, "word", "left").groupBy("token", "channel", "reading").agg((F.sum(surprise) + F.first("signs")).alias("cost"))
    return sure.unionByName(with_lost_bytes(tokens.where(F.col("token").contains(LOST)), counts, whole, gain))


def with_lost_bytes(tokens: DataFrame, counts: DataFrame, whole: float, gain) -> DataFrame:
    """The same for readings that lost bytes leave open: the Viterbi way through each lattice, whose slots meet the words of the corpus that look so when damaged."""

    def open_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, c, i, j, t[i:j]) for t in b.column("token").to_pylist() for c, _, arcs in readings(t) if arcs for i, j in slots(arcs, len(t)) or {(0, 0): ""}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["token", "channel", "i", "j", "look"])

    asked = cut(tokens.mapInArrow(open_slots, "token string, channel string, i int, j int, look string"))
    channels = [r[0] for r in asked.select("channel").distinct().collect()]  # a code page and a number of passes each

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [(c, *c.split("*")) for c in channels]
        for b in batches:
            rows = []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                for variant in {w, w.capitalize(), w.upper()}:
                    rows += [(c, garbled(variant, page, int(depth)), variant, n) for c, page, depth in passes]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["channel", "look", "variant", "n"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, c, found in zip(*(b.column(k).to_pylist() for k in ("token", "channel", "found"))):
                page, depth = c.split("*")
                arcs = next(itertools.islice(lattices(t, page), int(depth) - 1, None))
                known = {(f["i"], f["j"]): (f["best"]["variant"], whole - math.log(f["best"]["n"] + 0.1)) for f in found if f["best"]}
                cost, text = cheapest(arcs, len(t), known, whole - math.log(0.1))
                rows.append((t, c, text, cost + gain(c, t, text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["token", "channel", "reading", "cost"])

    shown = counts.mapInArrow(looks, "channel string, look string, variant string, n long") if channels else None
    if shown is None:
        return asked.select("token", "channel", F.col("look").alias("reading"), F.lit(0.0).alias("cost")).limit(0)
    best = shown.join(asked.select("channel", "look").distinct(), ["channel", "look"], "left_semi").groupBy("channel", "look").agg(F.max(F.struct("n", "variant")).alias("best"))
    each = asked.join(best, ["channel", "look"], "left").groupBy("token", "channel").agg(F.collect_list(F.struct("i", "j", "best")).alias("found"))
    return each.mapInArrow(solve, "token string, channel string, reading string, cost double")


def decided(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, path)`` of the damaged documents: their tokens with a likely second reading, in order, and what becomes of them.

    A document is damaged if its Viterbi path leaves a token's own spelling, or if bytes are lost for sure."""
    counts = cut(word_counts(df, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    by_doc = cut(damaged(df, doc_id, text))
    # few bytes but much work each, so they are spread over all cores whatever their size
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = cut(by_doc.select(F.explode("tokens").alias("token")).distinct().repartition(parts, "token"))
    own = F.min(F.when(F.col("channel") == "as is", F.col("cost")))
    options = F.collect_list(F.struct("channel", "reading", "cost"))
    other = F.min(F.when(F.col("channel") != "as is", F.col("cost")))
    # a reading that is dearer than to leave the channel and to enter it again is on no path
    table = scored(tokens, counts, total).groupBy("token").agg(options.alias("readings"), own.alias("own"), other.alias("other"))
    # nor is one that is dearer than the cheapest by two entries, or by one if it is the token's own spelling
    best = F.least("own", "other")
    fits = F.filter("readings", lambda r: F.when(r["channel"] == "as is", r["cost"] < best + CHANNEL_COST).otherwise((r["cost"] < F.col("own") + CHANNEL_COST) & (r["cost"] < best + 2 * CHANNEL_COST)))
    table = table.select("token", fits.alias("readings"), (F.col("own") - F.col("other")).alias("gain")).where(f"gain > -{CHANNEL_COST} or contains(token, '{LOST}')")
    lost = lost_words(tokens, counts).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("piece", "word"))).alias("pieces"))
    full = cut(table.join(lost, "token", "left"))
    # what all tokens of a document can gain at most must be worth an entry into a channel
    each = by_doc.select("doc_id", F.explode("tokens").alias("token"))
    gains = each.join(full.where("gain > 0").select("token", "gain"), "token").groupBy("doc_id").agg(F.sum("gain").alias("gain"))
    hopeful = gains.where(F.col("gain") > CHANNEL_COST).select("doc_id")
    by_doc = cut(by_doc.where("broken").unionByName(by_doc.where("not broken").join(hopeful, "doc_id", "left_semi")))
    each = by_doc.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token")).join(full.drop("gain"), "token")
    known = each.groupBy("doc_id").agg(F.collect_list(F.struct("token", "readings", "pieces")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, broken, own_tokens, table_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "broken", "tokens", "known"))):
                path = best_path(own_tokens, {x["token"]: x for x in table_ or []})
                if broken or any(t != r for t, r in path):
                    rows.append((i, [{"token": t, "text": r} for t, r in path]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], b_type)], names=["doc_id", "path"])

    b_type = pa.list_(pa.struct([("token", pa.string()), ("text", pa.string())]))
    return by_doc.join(known, "doc_id", "left").mapInArrow(run, "doc_id long, path array<struct<token: string, text: string>>")


def found(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id)`` of every document any part of which was read in a wrong encoding."""
    return decided(df, doc_id, text).select("doc_id").distinct()


def with_case(word: str, like: str) -> str:
    letters = [c for c in like if c != LOST]
    if len(letters) > 1 and all(c.isupper() for c in letters) or len(letters) == 1 and letters[0].isupper() and len(word) == 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def best_path(tokens: list[str], known: dict[str, dict]) -> list[tuple[str, str]]:
    """The Viterbi path over a document's tokens: the cheapest readings and entries into channels.  The known tokens in order and what it makes of them."""
    best: dict[str, tuple[float, tuple | None]] = {"as is": (0.0, None)}
    for token in tokens:
        if token not in known:
            continue
        cheapest_ = min(best.values(), key=lambda x: x[0])
        step = {}
        for r in known[token]["readings"]:
            channel, reading, cost = r["channel"], r["reading"], r["cost"]
            change = (cheapest_[0] + (0.0 if channel == "as is" else CHANNEL_COST), cheapest_[1])
            before = min(best.get(channel, change), change, key=lambda x: x[0])
            cost += before[0]
            if channel not in step or cost < step[channel][0]:
                step[channel] = (cost, (token, reading, before[1]))
        best = step
    path, out = min(best.values(), key=lambda x: x[0])[1], []
    while path:
        token, text, path = path
        pieces_ = dict(known[token]["pieces"] or {})
        if LOST in text and pieces_:
            text = PIECE.sub(lambda m: with_case(pieces_[m[0].lower()], m[0]) if m[0].lower() in pieces_ else m[0], text)
        out.append((token, text))
    return out[::-1]


def rewritten(text: str, path: list[tuple[str, str]]) -> str:
    """A text with the tokens of a path replaced, in order."""
    parts, k = SPACES_KEPT.split(text), 0
    for n, part in enumerate(parts):
        if k < len(path) and part == path[k][0]:
            parts[n] = path[k][1]
            k += 1
    return "".join(parts)


SPACES_KEPT = re.compile(r"([ \t\r\n]+)")


def restored(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, restored, complete)`` of the found documents; ``complete`` if no character is left lost."""
    paths = cut(decided(df, doc_id, text))
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(paths, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rewritten(t, [(x["token"], x["text"]) for x in p]) for t, p in zip(b.column("text").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array([LOST not in t for t in out], pa.bool_())], names=["doc_id", "restored", "complete"])

    return texts.mapInArrow(run, "doc_id long, restored string, complete boolean")
