"""Documents packed into containers of fixed token capacity (problem 7).

Method: sum-of-squares online packing.  A level array counts the open containers at each fill
level; a document goes to the level that keeps the sum of the squared counts smallest, so no level
piles up that nothing fits.  A document over the capacity fills whole containers of its own, and
its rest is placed like any document.  At the end, open containers that fit into each other are merged.

Scale: texts are tokenised where they are read; only ``(id, number of tokens)`` is shuffled, into
groups of about ``GROUP_TOKENS`` tokens that are packed independently, each by one task with
a level array and a list of open containers.  The groups' number follows the corpus, the space
lost at their ends does not grow with a group.

Defined results: null and empty texts have no tokens and lie in the first container of their group;
documents landed twice are placed twice; equal sizes are taken in the order of their hashed ids, so a
rerun gives the same containers; a text of any length is tokenised whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import cut

CAPACITY = 2048
GROUP_TOKENS = 32_000_000
GROUP_DOCS = 2_000_000
STRETCH = 200_000  # characters handed to the tokenizer at once
# Fixed value: the pattern that splits text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a rank file of a public byte-level BPE."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> Iterator[str]:
    """A text cut where the tokenizer cuts anyway: before a single space between two words."""
    begin = 0
    while len(text) - begin > STRETCH:
        at = text.rfind(" ", begin + 1, begin + STRETCH)
        while at > begin and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", begin + 1, at)
        if at <= begin:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


def count_tokens(text: str | None, path: str) -> int:
    """The number of tokens of a text; a stretch without any such cut is split by the pattern here,
    as the tokenizer's own matcher runs out of stack on very long runs."""
    if not text:
        return 0
    own, n = encoder(path), 0
    for s in stretches(text):
        if len(s) <= STRETCH:
            n += len(own.encode_ordinary(s))
        else:
            n += sum(len(own._encode_single_piece(m[0])) for m in regex.finditer(PATTERN, s))
    return n


def token_counts(df: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """``(doc_id, n_tokens)`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t.as_py(), path) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


class Packer:
    """Sum-of-squares packing of one stream of sizes."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open containers by level; 0 and the capacity stay empty
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def place(self, size: int) -> int:
        """The container for a document of 1 to ``capacity`` tokens."""
        c, count = self.capacity, self.count
        if size == c:
            return self.new()
        # by how much half the sum of squares grows, from each level; a full container counts no more
        start = count[: c - size + 1]
        end = count[size:]
        grows = np.where(start > 0, (end - start) + 1.0, np.inf)
        grows[0] = count[size] + 0.5
        if start[-1] > 0:
            grows[-1] = 0.5 - start[-1]
        level = int(c - size - np.argmin(grows[::-1]))  # of ties the fullest
        container = self.open[level].pop() if level else self.new()
        if level:
            count[level] -= 1
        if level + size < c:
            self.open[level + size].append(container)
            count[level + size] += 1
        return container

    def merged(self) -> np.ndarray:
        """For every container the one that it is merged into: open ones, the fullest first, into the tightest fit."""
        to = np.arange(self.n)
        levels = np.flatnonzero(self.count)
        spare: dict[int, list[int]] = {}
        room = np.zeros(self.capacity + 1, np.int64)  # merged containers by level
        for level in levels[::-1].tolist():
            for container in self.open[level]:
                fits = np.flatnonzero(room[: self.capacity - level + 1])
                if len(fits):
                    at = int(fits[-1])
                    host = spare[at].pop()
                    room[at] -= 1
                else:
                    at, host = 0, container
                to[container] = host
                if at + level < self.capacity:
                    spare.setdefault(at + level, []).append(host)
                    room[at + level] += 1
        return to


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every part: the number of its document, its place among the document's parts, its container, its tokens."""
    packer = Packer(capacity)
    doc, part, container, tokens = [], [], [], []
    first = packer.new() if len(sizes) and (sizes == 0).all() else -1
    for i, size in enumerate(sizes.tolist()):
        k = 0
        while size > capacity:
            doc.append(i), part.append(k), container.append(packer.new()), tokens.append(capacity)
            size -= capacity
            k += 1
        if size or not k:
            doc.append(i), part.append(k), tokens.append(size)
            container.append(packer.place(size) if size else max(first, 0))
    to = packer.merged()
    return np.array(doc, np.int64), np.array(part, np.int32), to[np.array(container, np.int64)] if doc else np.zeros(0, np.int64), np.array(tokens, np.int64)


def packed(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, part, container, first_token, n_tokens)``; ``tokenizer`` is the path of a rank file."""
    counts = cut(token_counts(df, doc_id, text, tokenizer))
    total = counts.agg(F.sum("n_tokens"), F.count("*")).first()
    groups = max(1, -(-(total[0] or 0) // GROUP_TOKENS), -(-total[1] // GROUP_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("doc_id"), b.column("n_tokens").to_numpy()) for b in batches]
        if not rows:
            return
        ids, sizes = pa.concat_arrays([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        doc, part, container, tokens = pack(sizes, capacity)
        container = container + (TaskContext.get().partitionId() << 40)
        for s in range(0, len(doc), 100_000):
            at = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[at])), pa.array(part[at]), pa.array(container[at]), pa.array(part[at].astype(np.int64) * capacity), pa.array(tokens[at])], names=["doc_id", "part", "container", "first_token", "n_tokens"])

    grouped = counts.repartition(groups, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    return grouped.mapInArrow(run, "doc_id long, part int, container long, first_token long, n_tokens long")


def fill(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers, tokens, and the share of the containers' space that is used."""
    each = parts.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("part") == 0).alias("docs"))
    return each.agg(F.sum("docs").alias("n_docs"), F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * capacity), 4).alias("fill"))


def violations(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers over the capacity, documents split though they fit, and documents whose parts leave gaps or overlap."""
    held = parts.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("n_too_full"))
    each = parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("part").alias("parts"))
    needless = F.count_if((F.col("k") > 1) & (F.col("n") <= capacity))
    gaps = F.count_if((F.col("n") != F.col("end")) | (F.col("k") != F.col("parts")))
    docs = each.agg(F.count("*").alias("n_docs"), needless.alias("n_split_needlessly"), gaps.alias("n_gaps"))
    one = F.lit(1).alias("one")
    return docs.select("*", one).join(held.select("*", one), "one").select("n_docs", "n_too_full", "n_split_needlessly", "n_gaps")
