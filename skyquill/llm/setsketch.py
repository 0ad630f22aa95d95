"""SetSketch: registers that hold truncated minima on an exponential scale.

Register i of a set is ``floor(1 - log_b(min h_i))`` with ``h_i`` exponentially distributed hashes of rate ``a``.
Registers of a union are the maxima of the registers, and two registers are equal with a probability near the
Jaccard similarity, so they can be banded. Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog" (2021).
"""

from __future__ import annotations

import numpy as np

from skyquill.llm.textkit import mix

#: Registers of a sketch (a power of two), base of the scale, rate, and highest register value less one.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65_534


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of uint16 registers per set; the empty set has zeros."""
    low = np.full((len(sets), registers), np.inf)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return np.zeros((len(sets), registers), np.uint16)
    key = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    # the k-th smallest of an element's hashes comes from exponential gaps, its register from a walk of odd stride
    begin = (key >> np.uint64(8)).astype(np.int64) & (registers - 1)
    stride = (key >> np.uint64(24)).astype(np.int64) & (registers - 1) | 1
    x = np.zeros(len(key))
    flat = low.reshape(-1)
    for k in range(registers):
        random = mix(key + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        x = x - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (RATE * (registers - k))
        at = row * registers + ((begin + k * stride) & (registers - 1))
        np.minimum.at(flat, at, x)
        # an element whose hash exceeds every minimum of its row can change nothing any more
        active = x < low.max(axis=1)[row]
        if not active.any():
            break
        key, row, begin, stride, x = key[active], row[active], begin[active], stride[active], x[active]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(low) / np.log(BASE))
    return np.clip(np.where(np.isfinite(low), value, 0), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketches of the unions."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` registers, different between bands."""
    used = values[:, :bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        key = mix(key + used[:, :, k] + np.uint64(1))
    return key


def _differs(x: np.ndarray) -> np.ndarray:
    """Chance that one register exceeds the other, when a share x of the union is in its set alone."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 81)


def estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
              at: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood similarity of pairs of sketches of known set sizes, and how much less likely ``at`` is.

    The second value is twice the log-likelihood ratio of the estimate to ``at``; it is infinite where the
    sizes alone rule ``at`` out and 0 where the estimate is no lower.
    """
    up = (a > b).sum(axis=1)[:, None]
    down = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    total = np.maximum(size_a + size_b, 1).astype(float)
    u, v = (size_a / total)[:, None], (size_b / total)[:, None]
    most = np.minimum(u / np.maximum(v, 1e-300), v / np.maximum(u, 1e-300))

    def likelihood(j: np.ndarray) -> np.ndarray:
        above = _differs(np.maximum(u - v * j, 0))
        below = _differs(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return (up * np.log(np.maximum(above, tiny)) + down * np.log(np.maximum(below, tiny))
                + same * np.log(np.maximum(1 - above - below, tiny)))

    grid = _GRID[None, :] * most
    values = likelihood(grid)
    best = values.argmax(axis=1)
    rows = np.arange(len(best))
    estimate = grid[rows, best]
    ratio = 2 * (values[rows, best] - likelihood(np.full((len(a), 1), at))[:, 0])
    ratio = np.where(estimate >= at, 0.0, np.maximum(ratio, 0.0))
    return estimate, np.where(most[:, 0] < at - 1e-9, np.inf, ratio)
