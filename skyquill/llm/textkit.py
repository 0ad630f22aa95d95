"""Vectorised text primitives shared by the operators: words, word hashes and shingle hashes of Arrow batches.

Everything here works on the UTF-8 bytes of a bounded slice of a batch. A word is a run of bytes outside
space and ``\\t\\n\\v\\f\\r``; all of these are ASCII, so byte borders are code point borders.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a single longer document is a slice of its own.
SLICE_BYTES = 1 << 19

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64; the table grows by doubling and is kept."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(12, (n - 1).bit_length())
        table = np.empty(size, np.uint64)
        table[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            table[done:2 * done] = table[:done] * step
            done *= 2
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def let_go() -> None:
    """Give back what earlier batches have left in the pools of a worker, which lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the border offsets of its rows; null is empty."""
    let_go()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows ``[first, last)`` with at most ``limit`` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
    let_go()


def word_borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where the words of each row begin in that list (rows + 1 entries)."""
    inside = ~IS_SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    inverse = powers(_BASE_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; runs across rows are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k:k + n] * (_ODD[k % 8] + np.uint64(2 * (k // 8)))
    return mix(total)


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle, an empty row none."""
    runs = window_hashes(words, width)
    sets = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= width:
            sets.append(np.unique(runs[s:e - width + 1]))
        elif e > s:
            whole = (words[s:e] * _ODD[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def lower_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a column with A-Z lower-cased: first row, last row, word hashes, row borders, starts, ends."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        part = LOWER[data[offsets[a]:offsets[b]]]
        starts, ends, first = word_borders(part, offsets[a:b + 1] - offsets[a])
        yield a, b, word_hashes(part, starts, ends), first, starts, ends
