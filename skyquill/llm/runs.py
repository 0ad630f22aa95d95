"""Periodic runs of words: an enhanced suffix array and the branching-tandem test (Stoye and Gusfield, 2002).

A square ``uu`` is branching if the word after it differs from the one before which it would have to repeat. With the
suffix array, its inverse (ISA) and the LCP table, the branching squares of period d are the pairs of suffixes i and
i + d in different children of an LCP interval of depth d: suffixes of all children but the largest look whether
ISA[i + d] or ISA[i - d] falls into the interval, n log n looks in all and no tree nodes. A branching square is the last
one of its run; turned to the left as far as the words agree, the squares merge into maximal runs.

Texts are worked on in slices of rows. A row is one task's, however long; memory grows in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm.textkit import IS_SEPARATOR, slices, text_bytes, word_borders

#: Elements of one step of the vectorised loops.
STEP = 1 << 20


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    sorted_ = s[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    slots = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)
    h = 1
    while True:
        at = order[slots]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        single = new & np.append(new[1:], True)
        slots = slots[~single]
        if not len(slots):
            return order, rank[:n]
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by_key = np.argsort(key, kind="stable")
        order[slots], key = at[by_key], key[by_key]
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        h *= 2


def agreement(s: np.ndarray, a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many symbols agree from ``a`` and ``b`` on (or before them, to the left), found by galloping.

    ``s`` begins and ends with symbols that occur once.
    """
    out = np.zeros(len(a), np.int64)
    sign, shift = (-1, -1) if left else (1, 0)
    active, width = np.arange(len(a)), 4
    while len(active):
        going = []
        for c in range(0, len(active), max(1, STEP // width)):
            part = active[c:c + max(1, STEP // width)]
            ahead = sign * (out[part, None] + np.arange(width)) + shift
            equal = s[np.clip(a[part, None] + ahead, 0, len(s) - 1)] == s[np.clip(b[part, None] + ahead, 0, len(s) - 1)]
            whole = equal.all(1)
            out[part] += np.where(whole, width, equal.argmin(1))
            going.append(part[whole])
        active, width = np.concatenate(going), min(2 * width, 1 << 16)
    return out


def lcp_table(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in the order; only irreducible values are compared."""
    n = len(s)
    i, j = order[1:], order[:-1]
    begins = (i == 0) | (j == 0) | (s[i - 1] != s[j - 1])
    known = np.zeros(n, bool)
    value = np.zeros(n, np.int64)
    known[order[0]] = True
    known[i[begins]] = True
    value[i[begins]] = agreement(s, i[begins], j[begins])
    last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    return (value[last] - (np.arange(n) - last))[order]


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """The nearest earlier place with a smaller value; ``v[0]`` is smaller than all others."""
    near = np.arange(-1, len(v) - 1)
    active = np.arange(1, len(v))
    for _ in range(64):
        at = near[active]
        larger = v[at] >= v[active]
        active = active[larger]
        if not len(active):
            return near
        near[active] = near[at[larger]]
    # long slopes, as of one word repeated, are faster walked once
    stack, values, found = [0], v.tolist(), near.tolist()
    for k in range(1, len(values)):
        while values[stack[-1]] >= values[k]:
            stack.pop()
        found[k] = stack[-1]
        stack.append(k)
    return np.array(found)


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, row): for each row of the table with a value, the interval of which it parts two children."""
    rows = np.flatnonzero(lcp > 0)
    if not len(rows):
        return rows, rows, rows
    before = _smaller_before(np.concatenate([[-1], lcp]))[1:] - 1
    after = len(lcp) - _smaller_before(np.concatenate([[-1], lcp[::-1]]))[1:][::-1]
    order = np.lexsort((rows, after[rows], before[rows]))
    rows = rows[order]
    return before[rows], after[rows], rows


def _small_children(first: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(child's first rank, its size, place in ``row`` of its interval) of all children but each interval's largest."""
    head = np.ones(len(row), bool)
    head[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    heads = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    start = np.concatenate([first[heads], row])
    stop = np.concatenate([row[heads], np.where(np.append(head[1:], True), end, np.append(row[1:], 0))])
    owner = np.concatenate([np.arange(len(heads)), group])
    order = np.lexsort((stop - start, owner))
    start, stop, owner = start[order], stop[order], owner[order]
    small = np.append(owner[1:] == owner[:-1], False)  # the last of its interval is the largest
    return start[small], (stop - start)[small], heads[owner[small]]


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of every branching square of ``s``, sorted."""
    order, rank = suffix_order(s)
    lcp = lcp_table(s, order)
    first, end, row = lcp_intervals(lcp)
    found = []
    if len(row):
        start, size, at = _small_children(first, end, row)
        cuts = np.searchsorted(np.cumsum(size), np.arange(STEP, int(size.sum()) + STEP, STEP)) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            n = size[a:b]
            if not len(n):
                continue
            place = np.repeat(at[a:b], n)
            ranks = np.repeat(start[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            i, depth, low, high = order[ranks], lcp[row[place]], first[place], end[place]
            for left in (i, i - depth):
                inside = left >= 0
                right = np.where(inside, left + depth, 0)
                other = rank[np.where(left == i, right, np.maximum(left, 0))]
                inside &= (other >= low) & (other < high)
                x, d = left[inside], depth[inside]
                apart = s[x + d] != s[x + 2 * d]
                found.append(np.stack([x[apart] + 2 * d[apart], d[apart]]))
    squares = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return squares[0], squares[1]


def maximal_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every maximal run with two periods or more.

    ``s`` begins and ends with symbols that occur once. Of the squares with one end, the one of the smallest period
    makes the run; multiples of that period inside the run are no runs of their own.
    """
    end, period = branching_squares(s)
    runs = []
    while len(end):
        head = np.ones(len(end), bool)
        head[1:] = end[1:] != end[:-1]
        e, p = end[head], period[head]
        start = e - 2 * p - agreement(s, e - 2 * p, e - p, left=True)
        runs.append(np.stack([start, e, p]))
        group = np.cumsum(head) - 1
        multiple = (period % p[group] == 0) & (2 * period <= (e - start)[group])
        end, period = end[~multiple], period[~multiple]
    whole = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
    return whole[0], whole[1], whole[2]


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words and no others."""
    borders = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=borders[1:])
    letters = np.ascontiguousarray(data[~IS_SEPARATOR[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def runs_of_rows(data: np.ndarray, offsets: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of the runs of a slice of texts, sorted, and the words of each row."""
    starts, ends, first = word_borders(data, offsets)
    counts = np.diff(first)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, counts
    numbers = word_numbers(data, starts, ends)
    wide = int(numbers.max()) + 2
    rows = np.repeat(np.arange(len(counts)), counts)
    # one symbol of its own before each row and after the last: runs end there, and equal words of two rows differ
    s = np.empty(len(numbers) + len(counts) + 1, np.int64)
    s[np.arange(len(numbers)) + rows + 1] = rows * wide + numbers + 1
    s[first + np.arange(len(first))] = np.arange(len(first)) * wide
    start, end, period = maximal_runs(s)
    long = end - start >= np.maximum(min_length, exponent * period)
    start, end, period = start[long], end[long], period[long]
    bases = first[:-1] + np.arange(len(counts)) + 1
    row = np.searchsorted(bases, start, "right") - 1
    order = np.lexsort((period, start))
    return row[order], (start - bases[row])[order], (end - start)[order], period[order], counts


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length over period; of ties the first, then the shortest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = ("row struct<{columns}>, n_words long, runs array<struct<start: long, length: long, period: long>>, "
           "best struct<start: long, length: long, period: long>, collapsed string")


def _find(min_length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                part, borders = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, start, length, period, counts = runs_of_rows(part, borders, min_length, exponent)
                per_row = np.searchsorted(row, np.arange(b - a + 1))
                whole, best, collapsed = part.tobytes(), [None] * (b - a), []
                for k in range(b - a):
                    words = whole[borders[k]:borders[k + 1]].split()
                    x, y = per_row[k], per_row[k + 1]
                    if x < y:
                        best[k] = _best(list(zip(start[x:y].tolist(), length[x:y].tolist(), period[x:y].tolist(), strict=True)))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, start[x:y] + period[x:y], 1)
                        np.add.at(edge, start[x:y] + length[x:y], -1)
                        words = [words[w] for w in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words).decode())
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(per_row.astype(np.int32), runs),
                     pa.array([None if x is None else dict(zip(("start", "length", "period"), x, strict=True)) for x in best], _RUN),
                     pa.array(collapsed, pa.string())],
                    ["row", "n_words", "runs", "best", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, carry: list[str] | None = None, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """Maximal runs of words in every text, and the text with each run's repetitions left out.

    Result: ``row`` (the columns ``carry``, doc_id unless named), ``n_words``, ``runs`` (start, length, period in words, sorted by
    start, then period; every stretch with smallest period q and at least max(``min_length``, ``exponent`` * q) words that
    no neighbour extends; ``exponent`` is 2 or more), ``best`` (greatest length / period; null without runs) and ``collapsed`` (the words left, joined by one
    space: what follows the first period of a run goes). Null and empty texts have no words, no runs and an empty
    ``collapsed``. Repeated rows and null ids are rows like others; columns not carried are not read.
    """
    carry = carry or ["doc_id"]
    narrow = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in narrow.schema["row"].dataType)
    return narrow.mapInArrow(_find(min_length, exponent), _SCHEMA.format(columns=columns))
