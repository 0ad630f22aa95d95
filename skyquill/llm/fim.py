"""Fill-in-the-middle: texts cut at token borders that a learned rank index finds, then put in another order.

The index maps the number of a border to its byte offset. It is piecewise linear (as FITing-tree and PGM-index are):
straight pieces, each as long as a cone of slopes keeps every border within an error bound, plus the residual of each
border in one signed byte. A cut is predicted by its piece and corrected by its residual, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm.textkit import slices, text_bytes, word_borders

#: Greatest distance of a border from its piece of the index; with rounding it fits one signed byte.
BOUND = 126


@dataclass(frozen=True)
class RankIndex:
    """Offsets of borders by their number: ``first`` rank, ``base`` offset and ``slope`` of each piece, and residuals."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, bound: int = BOUND) -> RankIndex:
        """The fewest pieces that begin on a border and stay within ``bound`` of all theirs; ``offsets`` ascend."""
        if not 0 < bound <= BOUND:
            raise ValueError(f"the bound must be 1 to {BOUND}")
        n, start = len(offsets), 0
        firsts, slopes = [], []
        while start < n:
            low, high, at, width = -np.inf, np.inf, start + 1, 256
            while at < n:
                rise = (offsets[at:at + width] - offsets[start]).astype(float)
                step = np.arange(at - start, at - start + len(rise))
                highs = np.minimum(high, np.minimum.accumulate((rise + bound) / step))
                lows = np.maximum(low, np.maximum.accumulate((rise - bound) / step))
                closed = lows > highs
                fits = int(closed.argmax()) if closed.any() else len(rise)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                at += fits
                if fits < len(rise):
                    break
                width *= 2
            firsts.append(start)
            slopes.append((low + high) / 2 if at > start + 1 else 0.0)
            start = at
        first, slope = np.array(firsts, np.int64), np.array(slopes)
        base = offsets[first] if n else np.zeros(0, np.int64)
        index = cls(first, base, slope, np.zeros(n, np.int8))
        residual = offsets - index._predict(np.arange(n)) if n else np.zeros(0)
        return cls(first, base, slope, residual.astype(np.int8))

    def _predict(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[piece] + np.rint(self.slope[piece] * (ranks - self.first[piece])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the borders ``ranks``."""
        return self._predict(ranks) + self.residual[ranks]


@dataclass(frozen=True)
class Format:
    """Marks of prefix, suffix and middle; percentages of texts that are cut, and of those with the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 50
    suffix_first: int = 80
    seed: int = 42
    bound: int = BOUND


_SCHEMA = ("row struct<{columns}>, n long, form string, pieces int, prefix_units long, middle_units long, prefix_chars long, "
           "middle_chars long, output string")


def _borders(ends: np.ndarray, size: int) -> np.ndarray:
    """Byte borders of a text's units: the text's start, each word's end, and the end of white space after the last word."""
    return np.concatenate([[0], ends, [size]] if size > (ends[-1] if len(ends) else 0) else [[0], ends]).astype(np.int64)


def _chars(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def _cut(form: Format):
    marks = tuple(m.encode() for m in (form.prefix, form.suffix, form.middle))
    before, behind, between = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            ids = batch.column(1).to_pylist()
            for a, b in slices(offsets):
                part, border = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                _, ends, first = word_borders(part, border)
                whole, rows = part.tobytes(), []
                for k in range(b - a):
                    s, e = int(border[k]), int(border[k + 1])
                    text = whole[s:e]
                    units = _borders(ends[first[k]:first[k + 1]] - s, e - s)
                    n = len(units) - 1
                    drawn = hashlib.sha256(f"{form.seed}:{'' if ids[a + k] is None else ids[a + k]}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in range(0, 32, 8))
                    if not text or h3 % 100 >= form.rate or any(m in text for m in marks):
                        rows.append((n, "plain", None, None, None, None, None, text.decode()))
                        continue
                    index = RankIndex.fit(units, form.bound)
                    ranks = np.array(sorted((h1 % (n + 1), h2 % (n + 1))))
                    x, y = index.offsets(ranks).tolist()
                    spm = h4 % 100 < form.suffix_first
                    output = (behind + text[y:] + before + text[:x] if spm else before + text[:x] + behind + text[y:]) + between + text[x:y]
                    rows.append((n, "spm" if spm else "psm", len(index.first), int(ranks[0]), int(ranks[1] - ranks[0]),
                                 _chars(part[s:s + x]), _chars(part[s + x:s + y]), output.decode()))
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                names = ["n", "form", "pieces", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["row", *names])
    return run


def fill_in_middle(docs: DataFrame, form: Format = Format(), carry: list[str] | None = None) -> DataFrame:  # noqa: B008
    """Every text, cut in three at random token borders and reordered, or plain.

    A unit is a word with the white space before it, or white space that ends the text. The draw depends on the seed and
    ``doc_id`` alone (a null id draws like an empty one), so repeated ids are cut alike. Texts that are null or empty, or
    hold one of the marks, stay plain. Result: ``row`` (the columns ``carry``, doc_id unless named), ``n`` units, ``form``
    (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle), ``pieces`` of the index, ``prefix_units``,
    ``middle_units``, ``prefix_chars``, ``middle_chars`` (code points; these five are null if plain) and ``output``. Columns not carried are not read.
    """
    narrow = docs.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in narrow.schema["row"].dataType)
    return narrow.mapInArrow(_cut(form), _SCHEMA.format(columns=columns))


def restored(output: Column, kind: Column, form: Format = Format()) -> Column:  # noqa: B008
    """The text that an output of this form was made of. Marks occur once each, since texts that hold one stay plain."""
    def cut(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(output, second, 1)
        return F.substr(head, F.lit(len(first) + 1)), F.substring_index(F.substring_index(output, second, -1), form.middle, 1)
    middle = F.substring_index(output, form.middle, -1)
    prefix, suffix = cut(form.prefix, form.suffix)
    late_suffix, late_prefix = cut(form.suffix, form.prefix)
    return (F.when(kind == "plain", output).when(kind == "psm", F.concat(prefix, middle, suffix))
            .otherwise(F.concat(late_prefix, middle, late_suffix)))
