"""Vectorised inner loops that the Arrow functions run on one bounded block of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SMALL_GROUP = 96
_TILE = 1 << 21
#: Heads of a peeling round: rows compared one by one, rows kept as bits, and rows looked up at once.
_NARROW, _WIDE, _LOOKUPS = 32, 1024, 8192


def group_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """An integer per row that is equal exactly when all key columns are equal."""
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        column = table.column(key).combine_chunks()
        encoded = column.dictionary_encode(null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        part = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = codes * (len(encoded.dictionary) + 1) + part
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in columns]).astype(np.float64, copy=False)


def dominated_by(points: np.ndarray, pruners: np.ndarray, strict: bool) -> np.ndarray:
    """Mask of ``points`` for which some pruner is <= everywhere.

    With ``strict`` the pruner must also differ; without it the caller knows
    that no pruner equals a point.
    """
    n, d = points.shape
    hit = np.zeros(n, dtype=bool)
    if not n or not len(pruners):
        return hit
    step = max(1, _TILE // len(pruners))
    for start in range(0, n, step):
        block = points[start:start + step]
        le = pruners[:, None, 0] <= block[None, :, 0]
        for k in range(1, d):
            le &= pruners[:, None, k] <= block[None, :, k]
        if strict:
            lt = pruners[:, None, 0] < block[None, :, 0]
            for k in range(1, d):
                lt |= pruners[:, None, k] < block[None, :, k]
            le &= lt
        hit[start:start + step] = le.any(axis=0)
    return hit


def dominated_by_tiles(points: np.ndarray, pruners: np.ndarray, tile: int = 256) -> np.ndarray:
    """``dominated_by`` with ``strict`` for rows in an order that keeps neighbours together: tiles of
    pruners whose low corner is not below a tile's high corner are left out."""
    hit = np.zeros(len(points), dtype=bool)
    if not len(points) or not len(pruners):
        return hit
    lows = np.minimum.reduceat(pruners, np.arange(0, len(pruners), tile))
    for s in range(0, len(points), tile):
        block = points[s:s + tile]
        near = np.flatnonzero((lows <= block.max(axis=0)).all(axis=1))
        if len(near):
            rows = (near[:, None] * tile + np.arange(tile)).ravel()
            rows = rows[rows < len(pruners)]
            some = pruners[rows]
            some = some[(some <= block.max(axis=0)).all(axis=1)]
            hit[s:s + tile] = dominated_by(block, some, strict=True)
    return hit


def _score(x: np.ndarray) -> np.ndarray:
    """Monotone in every dimension, so a dominating row never scores higher."""
    x = np.clip(x, -1e300, 1e300)
    lowest = x.min(axis=0)
    span = x.max(axis=0) - lowest
    span[span == 0] = 1.0
    return ((x - lowest) / span).sum(axis=1)


def _beaten_by_head(ranks: np.ndarray, width: int) -> np.ndarray:
    """Mask of the rows of distinct ``ranks`` that another row among the first ``width`` is <= everywhere.

    A head row is a bit. In every dimension the bits of the head rows up to a rank are looked up, and what is left
    after all dimensions are the rows that beat this one, so a comparison costs a bit of a word and not a byte a dimension.
    """
    n, d = ranks.shape
    width = min(width, n)
    places = np.arange(width)
    upto, counts = [], []
    for k in range(d):
        head = ranks[:width, k]
        order = np.argsort(head)
        bits = np.zeros((width + 1, -(-width // 64)), dtype=np.uint64)
        bits[places + 1, order >> 6] = np.left_shift(np.uint64(1), (order & 63).astype(np.uint64))
        upto.append(np.bitwise_or.accumulate(bits, axis=0))
        counts.append(np.cumsum(np.bincount(head, minlength=int(ranks[:, k].max()) + 1)))
    hit = np.zeros(n, dtype=bool)
    for start in range(0, n, _LOOKUPS):
        rows = ranks[start:start + _LOOKUPS]
        left = upto[0][counts[0][rows[:, 0]]]
        for k in range(1, d):
            left &= upto[k][counts[k][rows[:, k]]]
        if start < width:  # a row does not beat itself
            own = places[start:start + _LOOKUPS]
            left[own - start, own >> 6] &= ~np.left_shift(np.uint64(1), (own & 63).astype(np.uint64))
        hit[start:start + _LOOKUPS] = left.any(axis=1)
    return hit


def _peel(points: np.ndarray) -> np.ndarray:
    """Skyline positions of distinct points sorted so that dominators come first."""
    alive = np.arange(len(points))
    found, width = [], 8
    while len(alive) and width <= _NARROW:
        head = alive[:width]
        block = points[head]
        le = np.ones((len(head), len(head)), dtype=bool)
        for k in range(points.shape[1]):
            le &= block[:, None, k] <= block[None, :, k]
        best = head[~np.triu(le, 1).any(axis=0)]
        found.append(best)
        rest = alive[width:]
        alive = rest[~dominated_by(points[rest], points[best], strict=False)]
        width *= 2
    if len(alive):
        ranks = np.column_stack([np.unique(x, return_inverse=True)[1] for x in points[alive].T]).astype(np.int32)
    while len(alive):
        hit = _beaten_by_head(ranks, _WIDE)
        found.append(alive[:_WIDE][~hit[:_WIDE]])
        alive, ranks = alive[_WIDE:][~hit[_WIDE:]], ranks[_WIDE:][~hit[_WIDE:]]
    return np.concatenate(found) if found else alive


def _peel_many(codes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """As ``_peel`` for many small groups at once: one head per group and round."""
    alive = np.arange(len(points))
    found = []
    while len(alive):
        group = codes[alive]
        first = np.r_[True, group[1:] != group[:-1]]
        head = alive[first]
        found.append(head)
        owner = head[np.cumsum(first) - 1]
        le = (points[owner] <= points[alive]).all(axis=1)
        alive = alive[~le]
    return np.concatenate(found) if found else alive


def skyline_rows(codes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Positions of the rows no other row of the same group dominates; equal rows all stay."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((*points.T[::-1], _score(points), codes))
    c, x = codes[order], points[order]
    fresh = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]).any(axis=1)]
    distinct = np.flatnonzero(fresh)
    dc, dx = c[distinct], x[distinct]
    bounds = np.flatnonzero(np.r_[True, dc[1:] != dc[:-1], True])
    sizes = np.diff(bounds)
    keep = np.zeros(len(dx), dtype=bool)
    small = np.repeat(sizes <= _SMALL_GROUP, sizes)
    if small.any():
        where = np.flatnonzero(small)
        keep[where[_peel_many(dc[where], dx[where])]] = True
    for g in np.flatnonzero(sizes > _SMALL_GROUP):
        lo, hi = bounds[g], bounds[g + 1]
        keep[lo + _peel(dx[lo:hi])] = True
    return np.sort(order[keep[np.cumsum(fresh) - 1]])


def dominance_factors(victims: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Per victim the largest count of dimensions in which a rival is no worse,
    over the rivals that are better in at least one dimension; 0 if there is none."""
    n, d = victims.shape
    best = np.zeros(n, dtype=np.int32)
    if not n or not len(rivals):
        return best
    step = max(1, _TILE // len(rivals))
    for start in range(0, n, step):
        block = victims[start:start + step]
        count = np.zeros((len(rivals), len(block)), dtype=np.uint8)
        better = np.zeros((len(rivals), len(block)), dtype=bool)
        for k in range(d):
            count += rivals[:, None, k] <= block[None, :, k]
            better |= rivals[:, None, k] < block[None, :, k]
        count[~better] = 0
        best[start:start + step] = count.max(axis=0)
    return best
