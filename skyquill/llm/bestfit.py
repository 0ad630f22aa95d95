"""Best-fit packing of whole documents: bin completion by branch and bound over a histogram of lengths.

Bin completion (Korf, 2002; Martello and Toth, 1990) fills one bin at a time around the largest item left. Of the
fillings of what the bin has left only undominated ones are tried, the fullest (best fit) first; a branch is left when
the waste so far and a lower bound of the waste to come exceed what the best packing found allows. Items of one length
are alike, so the programme works on numbers of items by length: its input and its plan are bounded by the capacity,
whatever the number of documents, and one plan serves the whole table. Spark numbers the pieces of each length and
looks up their places in the plan.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquill.llm.storage import small_first, stored
from skyquill.llm.textkit import let_go, slices, text_bytes
from skyquill.llm.tokens import WIDE_SPACE, has_wide_space

#: Id that ends a document.
END = 2
#: Nodes the search may open after its first descent, and fillings it tries at a node. They bound the search for a better
#: packing, not what is packed: every piece has its place in the best one found.
NODES, FILLINGS = 1000, 12

Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences filled alike."""

    filling: Filling
    times: int


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound L2 of the bins that ``counts`` (items by length) need.

    For each threshold: items that no item of the threshold fits beside, those above a half, and what the rest has over
    once the room beside those is filled.
    """
    sizes = np.arange(capacity + 1)
    many, much = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    least = np.arange(0, half + 1)
    above = many[-1] - many[half]
    wide = many[-1] - many[capacity - least]
    beside = (above - wide) * capacity - (much[capacity - least] - much[half])
    small = much[half] - np.where(least > 0, much[np.maximum(least - 1, 0)], 0)
    return int((above + np.maximum(0, -(-(small - beside) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, many bins of one filling at once: the first packing the search has to beat."""
    groups: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((filling, times))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                fits = capacity // size
                if left >= fits:
                    put(capacity - fits * size, ((size, fits),), left // fits)
                left %= fits
                if left:
                    put(capacity - left * size, ((size, left),), 1)
                break
            room = rooms[at]
            filling, times = groups[room].pop()
            fits = min(room // size, left)
            taken = min(times, left // fits)
            put(room - fits * size, (*filling, (size, fits)), taken)
            left -= taken * fits
            if taken < times:
                groups[room].append((filling, times - taken))
            if not groups[room]:
                del groups[room]
                rooms.remove(room)
    return [Pattern(filling, times) for found in groups.values() for filling, times in found]


def _items(filling: Filling) -> list[int]:
    return [size for size, n in filling for _ in range(n)]


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the items of ``b`` can be dealt to the items of ``a`` so that none holds more than its own size."""
    rooms, items = _items(a), _items(b)
    if sum(rooms) < sum(items) or len(items) > 8:  # many small items: not worth the search, the filling is kept
        return False

    def deal(k: int) -> bool:
        if k == len(items):
            return True
        for r, room in enumerate(rooms):
            if room >= items[k] and room not in rooms[:r]:
                rooms[r] -= items[k]
                if deal(k + 1):
                    return True
                rooms[r] += items[k]
        return False
    return deal(0)


def fillings(counts: np.ndarray, room: int, limit: int = FILLINGS) -> Iterator[Filling]:
    """Undominated fillings of ``room``, the fullest first; at most ``limit``, each worked out when it is asked for.

    One item that fills the room dominates all others. Else sums of items are tried from the fullest reachable one down
    to the largest single item, which dominates everything below.
    """
    if room == 0:
        yield ()
        return
    if counts[room]:
        yield ((room, 1),)
        return
    sizes = np.flatnonzero(counts[:room])[::-1].tolist()
    if not sizes:
        yield ()
        return
    mask = (1 << (room + 1)) - 1
    reach = [1]  # sums of the items from each place on, as bits
    for size in reversed(sizes):
        bits, n, step = reach[-1], min(int(counts[size]), room // size), 1
        while n:
            take = min(step, n)
            bits |= bits << (size * take) & mask
            n, step = n - take, step * 2
        reach.append(bits)
    reach.reverse()

    def exactly(at: int, total: int) -> Iterator[Filling]:
        if total == 0:
            yield ()
            return
        for k in range(at, len(sizes)):
            if not reach[k] >> total & 1:
                return
            size = sizes[k]
            for n in range(min(int(counts[size]), total // size), 0, -1):
                if reach[k + 1] >> (total - n * size) & 1:
                    for rest in exactly(k + 1, total - n * size):
                        yield ((size, n), *rest)

    found: list[Filling] = []
    seen = 0
    for total in range(room, sizes[0], -1):
        if reach[0] >> total & 1:
            for filling in islice(exactly(0, total), limit):
                seen += 1
                if not any(dominates(other, filling) for other in found):
                    found.append(filling)
                    yield filling
                if len(found) == limit or seen == 4 * limit:
                    return
    alone = ((sizes[0], 1),)
    if not any(dominates(other, alone) for other in found):
        yield alone


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES, limit: int = FILLINGS) -> list[Pattern]:
    """A packing of ``counts`` (items by length, 0 to ``capacity``) into as few bins as the search finds.

    Best fit gives the first packing. The search then fills bins around the largest item; a filling is used as often as
    the items last, or (as another branch) once. It ends with a packing that meets the lower bound, when all branches are
    tried or left, or after ``nodes`` nodes.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    best = best_fit(counts, capacity)
    fewest, bound = sum(p.times for p in best), least_bins(counts, capacity)

    def branches(counts: np.ndarray) -> Iterator[Pattern]:
        size = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[size] -= 1
        whole = []
        for filling in fillings(rest, capacity - size, limit):
            need = dict(filling)
            need[size] = need.get(size, 0) + 1
            pattern = tuple(sorted(need.items(), reverse=True))
            most = min(int(counts[s]) // n for s, n in pattern)
            whole.append(pattern)
            yield Pattern(pattern, most)
        for pattern in whole if any(int(counts[s]) // n > 1 for p in whole[:1] for s, n in p) else []:
            if min(int(counts[s]) // n for s, n in pattern) > 1:
                yield Pattern(pattern, 1)

    path: list[Pattern] = []
    open_ = [branches(counts)] if counts.any() and fewest > bound else []
    used, spent, descended = 0, 0, False
    while open_ and fewest > bound and spent <= nodes:
        pattern = next(open_[-1], None)
        if pattern is None:
            open_.pop()
            if path:
                last = path.pop()
                used -= last.times
                for size, n in last.filling:
                    counts[size] += n * last.times
            continue
        spent += descended
        used += pattern.times
        for size, n in pattern.filling:
            counts[size] -= n * pattern.times
        path.append(pattern)
        # bins so far and the bound for the rest, that is the waste so far and the least to come
        if used + least_bins(counts, capacity) >= fewest or not counts.any():
            descended = True
            if not counts.any() and used < fewest:
                best, fewest = list(path), used
            path.pop()
            used -= pattern.times
            for size, n in pattern.filling:
                counts[size] += n * pattern.times
        else:
            open_.append(branches(counts))
    return best


@cache
def _tokenizer(name: str):
    """tiktoken's form of a byte-level vocabulary of ``tokenizers``: the same ids, several times as fast."""
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        model = json.load(file)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    letter = {chr(b if b in plain else next(spare)): b for b in range(256)}
    special = {token["content"]: token["id"] for token in model["added_tokens"]}
    ranks = {bytes(letter[c] for c in word): n for word, n in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, name: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids of a text, as the vocabulary's tokenizer gives them without further special tokens.

    The splitting pattern backtracks over white space before a word, and fails on very long runs. Such a run is one part
    without its last character, which goes with what follows; it is encoded by itself.
    """
    encoding = _tokenizer(name)
    if not has_wide_space(text):
        return encoding.encode_to_numpy(text, allowed_special="all")
    special = "|".join(re.escape(s) for s in encoding._special_tokens)
    found: list[np.ndarray] = []
    for part in re.split(f"({special})", text):
        pieces = WIDE_SPACE.split(part)
        carried = ""
        for k, piece in enumerate(pieces):
            if k % 2 == 0:
                found.append(encoding.encode_to_numpy(carried + piece, allowed_special="all"))
                continue
            run, carried = (piece[:-1], piece[-1]) if pieces[k + 1] else (piece, "")
            found.append(np.array(encoding._encode_single_piece(run), np.uint32))
    return np.concatenate(found)


_PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def _cut(name: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                rows, ids = [], []
                texts = batch.column(1).slice(a, b - a).to_pylist()
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    tokens = np.append(token_ids(text or "", name), END).astype("<u4")
                    cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        data = tokens[s:e].tobytes()
                        rows.append((part, doc, k, s, e - s, zlib.crc32(data), int(seen[e - s])))
                        seen[e - s] += 1
                        if with_ids:
                            ids.append(data)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        _tokenizer.cache_clear()  # a worker lives on for tasks of other kinds
        let_go()
    return run


@dataclass(frozen=True)
class Places:
    """Where the n-th piece of a length goes, as segments of a plan: sorted by length, then first number."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    #: Numbers of one length stay below this power of two.
    BITS = 50

    @classmethod
    def of(cls, plan: list[Pattern]) -> Places:
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern in plan:
            offset = 0
            for size, n in pattern.filling:
                rows.append((size, taken.get(size, 0), sequence, n, offset))
                taken[size] = taken.get(size, 0) + n * pattern.times
                offset += size * n
            sequence += pattern.times
        size, first, base, each, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        return cls((size << cls.BITS) + first, first, base, each, offset)

    def look_up(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset in it) of the pieces of these lengths and numbers."""
        at = np.searchsorted(self.key, (length << self.BITS) + number, "right") - 1
        nth = number - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def _place(places: Places, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = places.look_up(length, number)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            names = [*names, "sequence_id", "offset"] + ["ids"] * with_ids
            if with_ids:
                columns.append(batch.column("ids"))
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def pack_whole(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", nodes: int = NODES,
               with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``capacity`` tokens; the sequences are as few as the search finds.

    Columns: doc_id, piece (from 0), start (tokens of its document before it), length, ids_crc32, sequence_id, offset, and ``ids``
    (little-endian uint32) on demand. A document is the ids of its text and one that ends it, so a null or empty text is one
    token. Only documents longer than a sequence are cut, into whole sequences and a first piece for what is over. Repeated rows
    and null ids are documents of their own; other columns are not read. An empty table has no pieces.

    Texts are read once. Each task numbers its pieces by length; the numbers of earlier partitions come from a table of
    (partition, length) counts, so no length, however frequent, is sorted or held in one place. The driver sees one number a length.
    """
    schema = _PIECES + ", ids binary" * with_ids
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                    .mapInArrow(_cut(vocabulary, capacity, with_ids), schema), "bestfit-pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "bestfit-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row a length
        histogram[length] = n
    places = Places.of(complete(histogram, capacity, nodes))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(small_first(before), ["part", "length"]).withColumn("number", F.col("before") + F.col("place"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"] + ["ids"] * with_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return numbered.select(*names).mapInArrow(_place(places, with_ids), out)
