"""Vectorised text primitives: words, word hashes and n-gram hashes of Arrow string columns.

A word is a maximal run of characters other than space, tab, carriage return and line feed. All functions work on
whole batches in numpy; nothing here loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import give_back

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = 0xD1342543DE82EF95 | 1
_GRAM_INV = pow(_GRAM, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of text handled at once in numpy; a longer single text is still taken whole.
CHUNK_BYTES = 400_000


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, np.uint64(base & (2**64 - 1)))
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of about limit bytes of text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and the offsets of its rows in them; a null is an empty text."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row bounds, hash): byte places of every word, rows' bounds in the word list, a 64-bit hash each."""
    body, offsets = raw(column)
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    full = ~_SPACE[body]
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(body))])
    before = np.empty_like(full)
    before[0] = False
    before[1:] = full[:-1]
    before[inner] = False
    start = np.flatnonzero(full & ~before)
    after = np.empty_like(full)
    after[-1] = False
    after[:-1] = full[1:]
    after[inner - 1] = False
    end = np.flatnonzero(full & ~after) + 1
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTE[body] * powers(_BASE, len(body)), out=total[1:])
    hashed = mix((total[end] - total[start]) * powers(_BASE_INV, len(body))[start])
    return start, end, np.searchsorted(start, offsets), hashed


def grams(hashed: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row bounds) of every run of n words within a row; a shorter row has none."""
    total = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * powers(_GRAM, len(hashed)), out=total[1:])
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    return mix((total[at + n] - total[at]) * powers(_GRAM_INV, len(hashed) + 1)[at]), out


def count_words(column: pa.Array) -> np.ndarray:
    """The words of each row; a null has none."""
    out = []
    for _, part in chunks(column):
        body, offsets = raw(part)
        full = np.concatenate([~_SPACE[body], [False]])
        start = full.copy()
        start[1:] &= ~full[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        start[first] = full[first]  # a row's first word may follow another row's last
        total = np.concatenate([[0], np.cumsum(start)])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def words_of(text: Column) -> Column:
    """The words of a text, counted in Arrow batches; 0 for a null."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array(count_words(texts), pa.int64())
        finally:
            give_back()

    return count(text.cast("string"))
