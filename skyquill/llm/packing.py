"""Packing token sequences: vector bin packing under limits on tokens, segments and loss-bearing tokens.

A bin is filled by the dot-product heuristic (Panigrahy et al., "Heuristics for vector bin packing", 2011): of the
examples that fit, the one whose demands, weighted by how scarce each limit is, point most along what the bin has
left. Examples may be cut: when none fits, one is cut to fill the bin, and its rest goes on. Each task packs the
rows it reads as they come, holding a bounded pool; there is no shuffle, and sequences never span tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm.textkit import slices, text_bytes
from skyquill.llm.tokens import encoder, forget

#: Id that ends a document.
END = 2
#: Bytes of text encoded at once: words that occur again in them are looked up once.
ENCODE_BYTES = 1 << 21
#: Tokens and examples a task's pool may hold before it is packed down to half.
POOL_TOKENS, POOL_EXAMPLES = 1 << 20, 8192


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Packer:
    """Packs examples given as (key, tokens, free): of its tokens the first ``free`` bear no loss.

    ``closed`` receives each finished sequence as a list of (key, start, length).
    """

    limits: Limits
    cut: bool = True
    closed: list[list[tuple[int, int, int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.key = np.zeros(0, np.int64)
        self.start, self.end, self.free = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def tokens(self) -> int:
        return int((self.end - self.start).sum())

    def add(self, keys: list[int], tokens: list[int], free: list[int]) -> None:
        """Take examples into the pool. What fills whole sequences by itself is cut off at once."""
        limits, kept = self.limits, []
        for key, n, lead in zip(keys, tokens, free, strict=True):
            if n > limits.tokens and not self.cut:
                raise ValueError(f"an example of {n} tokens exceeds a sequence of {limits.tokens} and may not be cut")
            start = 0
            while self.cut and n - start >= limits.tokens and limits.loss >= limits.tokens:
                self.closed.append([(key, start, limits.tokens)])
                start += limits.tokens
            if n > start:
                kept.append((key, start, n, lead))
        if kept:
            new = np.array(kept, np.int64).T
            self.key, self.start, self.end, self.free = (
                np.concatenate([old, more]) for old, more in zip((self.key, self.start, self.end, self.free), new, strict=True))

    def _loss(self) -> np.ndarray:
        return np.maximum(0, self.end - np.maximum(self.start, self.free))

    def pack(self, down_to: int = 0) -> None:
        """Close sequences until the pool holds at most ``down_to`` tokens."""
        limits = self.limits
        size = self.end - self.start
        loss = self._loss()
        alive = np.ones(len(size), bool)
        total = int(size.sum())
        # a limit weighs as much as the pool needs of it
        weight = np.array([total / limits.tokens, len(size) / limits.segments, loss.sum() / limits.loss])
        while total > down_to:
            room = np.array([limits.tokens, limits.segments, limits.loss], float)
            bin_: list[tuple[int, int, int]] = []
            while room[0] > 0 and room[1] > 0 and alive.any():
                scale = weight * room / np.array([limits.tokens, limits.segments, limits.loss]) ** 2
                score = size * scale[0] + scale[1] + loss * scale[2]
                fits = alive & (size <= room[0]) & (loss <= room[2])
                # the last segment should fill the sequence, so it may be a cut one
                if fits.any() and not (room[1] == 1 and self.cut and (alive & ~fits).any()):
                    i = int(np.where(fits, score, -1.0).argmax())
                    take = int(size[i])
                elif self.cut and (alive & ~fits).any():
                    i = int(np.where(alive & ~fits, score, -1.0).argmax())
                    lead = max(0, int(self.free[i] - self.start[i]))
                    take = min(int(size[i]), int(room[0]), lead + int(room[2]))
                    if take == 0:
                        break
                else:
                    break
                bin_.append((int(self.key[i]), int(self.start[i]), take))
                bears = max(0, int(self.start[i]) + take - max(int(self.start[i]), int(self.free[i])))
                room -= (take, 1, bears)
                total -= take
                if take == size[i]:
                    alive[i] = False
                else:
                    self.start[i] += take
                    size[i] -= take
                    loss[i] -= bears
            if not bin_:
                raise ValueError("an example fits no empty sequence")
            self._close(bin_)
        self.key, self.start, self.end, self.free = (x[alive] for x in (self.key, self.start, self.end, self.free))

    def _close(self, pieces: list[tuple[int, int, int]]) -> None:
        """A sequence that isn't full is dealt, if cuts are allowed, to sequences of powers of two, which need no padding."""
        length = sum(n for _, _, n in pieces)
        if length == self.limits.tokens or not self.cut:
            self.closed.append(pieces)
            return
        rest = [list(piece) for piece in pieces]
        for bit in reversed(range(length.bit_length())):
            if not length >> bit & 1:
                continue
            want, part = 1 << bit, []
            while want:
                key, start, n = rest[0]
                take = min(n, want)
                part.append((key, start, take))
                want -= take
                rest[0] = [key, start + take, n - take]
                if take == n:
                    rest.pop(0)
            self.closed.append(part)


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_length long")


def _pack(limits: Limits, pool_tokens: int, pool_examples: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().rows
        end = np.array([END], "<u2").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        packer = Packer(limits)
        held: dict[int, tuple[int | None, bytes, int]] = {}  # key: doc_id, ids, tokens not packed yet
        count = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            ids: list[bytes] = []
            for pieces in packer.closed:
                offset, whole = 0, sum(n for _, _, n in pieces)
                for key, start, n in pieces:
                    doc, text, left = held[key]
                    piece = np.frombuffer(text, "<u2")[start:start + n].astype("<u4").tobytes()
                    rows.append((doc, start, n, zlib.crc32(piece), len(text) // 2, sequence, offset, whole))
                    if with_ids:
                        ids.append(piece)
                    offset += n
                    if left == n:
                        del held[key]
                    else:
                        held[key] = (doc, text, left - n)
                sequence += 1
            packer.closed.clear()
            for s in range(0, len(rows), 8192):
                columns = [pa.array(column, pa.int64()) for column in zip(*rows[s:s + 8192], strict=True)]
                if with_ids:
                    columns.append(pa.array(ids[s:s + 8192], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")] + ["ids"] * with_ids)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, ENCODE_BYTES):
                ids, first = encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                whole, first = ids.astype("<u2").tobytes(), (2 * first).tolist()
                coded = [whole[s:e] for s, e in zip(first, first[1:], strict=False)]
                keys = list(range(count, count + b - a))
                count += b - a
                lengths = []
                for key, doc, text in zip(keys, batch.column(0).slice(a, b - a).to_pylist(), coded, strict=True):
                    lengths.append(len(text) // 2 + 1)
                    held[key] = (doc, text + end, lengths[-1])
                packer.add(keys, lengths, [1] * len(keys))
                if packer.tokens > pool_tokens or len(packer.key) > pool_examples:
                    packer.pack(pool_tokens // 2 if len(packer.key) <= pool_examples else 0)
                yield from emit()
        packer.pack()
        yield from emit()
        del encode
        forget()
    return run


def pack_documents(docs: DataFrame, limits: Limits | None = None, pool_tokens: int = POOL_TOKENS,
                   pool_examples: int = POOL_EXAMPLES, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence.

    Columns: doc_id, start (tokens of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (in the sequence), sequence_length, and ``ids`` (little-endian uint32) on demand. A document is the
    ids of its text and one that ends it, so a null or empty text is a document of one token. Repeated rows and
    rows of one or no ``doc_id`` are documents of their own; other columns are not read. Sequences are full but for a few at
    the end of each task, and those have lengths of powers of two.
    """
    schema = _SCHEMA + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(limits or Limits(), pool_tokens, pool_examples, with_ids), schema)
