"""Numpy passes over the bytes of an Arrow string column: words, their hashes, and sums over stretches.

White space is ``[\\x20\\x09-\\x0D]`` and only A-Z is lower-cased. Hashes have 64 bits; two different words, or word
sequences, are taken for one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer document is handled alone.
SLICE = 1 << 19
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32



def release_memory() -> None:
    """Give freed memory back to the system at the end of a task, as Spark keeps its Python workers for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(first * np.uint64(_BASE) + mix(second + np.uint64(0x632BE59BD9B4E019)))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts in them (one entry more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of each row (one entry more than rows).

    ``between``: of each byte, whether it parts words.
    """
    word = ~between[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word
    after = before[1:].copy()
    after[:-1] = word[1:]
    if len(data):
        after[-1] = False
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(word & ~before[:-1])
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, A-Z lower-cased."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, last row (exclusive), hashes of its words, first word of each row."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, of_row = split_words(part, offsets[first : last + 1] - offsets[first])
        yield first, last, hash_words(part, starts, ends), of_row
