"""Arrow text as numpy code points.

A string column becomes one array of code points and one of row offsets; every step after that
is a table gather or a segmented reduction over the whole batch, never a string call per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOP = 0x110000


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one contiguous ``large_string`` array without nulls (they become '')."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def to_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets into them."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and row offsets into them."""
    raw, at = to_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, at
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=count[1:])
    return points, count[at]


def from_codepoints(points: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of :func:`to_codepoints`."""
    data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    end = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=end[1:])
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(end[at].tobytes()), pa.py_buffer(data)).cast(pa.string())


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row number of every code point."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def any_in_row(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a flag is set anywhere in each row."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[at[1:]] > total[at[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none has over ``most`` bytes in ``column``, however long the texts are.

    A single longer text is a piece by itself; no row is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


@lru_cache(None)
def spread64(seed: int = 0) -> np.ndarray:
    """A well mixed odd 64-bit value for every code point (splitmix64 of the code point)."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(TOP, dtype=np.uint64) + np.uint64((seed * 0x51_7C_C1_B7 + 1) << 21)) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(None)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def segment_hash(values: np.ndarray, begin: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each segment; ``begin`` has its first positions, none empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = np.diff(np.append(begin, len(values)))
    place = np.arange(len(values)) - np.repeat(begin, length)
    base = (0x9E3779B97F4A7C15 ^ (seed * 0xD6E8FEB86659FD93)) % 2**64 | 5
    room = 1 << max(6, int(length.max() - 1).bit_length())
    with np.errstate(over="ignore"):
        terms = spread64(seed)[values] * powers(base, room)[place]
        return mix64(np.add.reduceat(terms, begin) + length.astype(np.uint64))
