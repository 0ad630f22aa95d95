"""Repeated passages by sparse suffix arrays.

Of all suffixes (at word starts) only those at minimiser positions are kept: a position is kept if its 16-word
hash is the least of some 35 neighbouring ones, so every run of 50 words holds a kept position together with the 16
words that follow it, and equal runs keep equal positions. Suffixes whose first 16 words occur once are dropped; the
others are sorted in one distributed order, neighbours are compared, and matches are extended to the right and to the left.
Chains of matching neighbours elect their smallest occurrence, against which all others are compared once more.

The order settles all matches of suffixes whose first 16 words occur twice. Where they occur more often, suffixes with
other words before them may stand between two that match, so each run of 50 words whose least hash is that of such a
beginning is also grouped by its own hash: the smallest place of a group is its first, all others are removable.

A passage is removable from a document only if the same words stand at a smaller (doc_id, position), so of each
passage one occurrence always stays. Words are compared with A-Z lower-cased and whatever separates them. Texts that
are equal are one text, held by their smallest doc_id; the others repeat it wholly, and rows equal in text and doc_id
count once. Null or empty texts and texts of fewer than 50 words take no part. A null doc_id ranks last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.llm.storage import same, small_batches, small_first, stored
from skyquill.llm.textkit import _BASE, _BASE_INVERSE, lower_words, mix, powers, window_hashes
from skyquill.runtime import checkpointed

#: Words a repeated passage has at least, and words of the hash that selects positions and starts a suffix's order.
PASSAGE, GRAM = 50, 16
#: Sorted suffixes a partition should hold.
PARTITION_ROWS = 200_000

_LAST = (1 << 63) - 1


def text_keys(text: Column) -> list[Column]:
    """128 bits of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]


def _running(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values; shorter than ``x`` by width - 1."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def minimisers(words: np.ndarray, first: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and their hashes, over the concatenated word hashes of rows that begin at ``first``."""
    width = passage - gram + 1
    if len(words) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(words, gram)
    least = _running(grams, width, np.minimum)
    # a run of ``passage`` words must not leave its row
    at = np.arange(len(least))
    row = np.searchsorted(first, at, "right") - 1
    least[at + passage > first[row + 1]] = 0
    # the greatest least of the runs that hold a position is the position's own hash if it is some run's least
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    kept = np.flatnonzero(_running(padded, width, np.maximum) == grams)
    return kept, grams[kept]


def _anchors(passage: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first, _, _ in lower_words(batch.column(0)):
                kept, seeds = minimisers(words, first, passage, gram)
                row = np.searchsorted(first, kept, "right") - 1
                borders = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in (1, 2, 3)), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(seeds.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array((kept - first[row]).astype(np.int32)))],
                    ["doc_id", "h", "g", "words", "seeds", "places"])
    return run


def _owned(grams: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``passage`` words have their leftmost least hash at each place: they begin ``low`` up to, without,
    ``high`` words before it. ``at`` are places in ``grams``, of texts that lie between ``begin`` and ``end``."""
    width = passage - gram + 1
    least = _running(grams, width, np.minimum) if len(grams) >= width else np.zeros(0, np.uint64)
    low, high = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for back in range(width):
        start = at - back
        fits = np.flatnonzero((start >= begin) & (start + passage <= end))
        fits = fits[least[start[fits]] == grams[at[fits]]]
        low[fits[high[fits] == 0]] = back
        high[fits] = back + 1
    # an equal hash further left in the run owns it
    order = np.lexsort((at, grams[at]))
    near = (grams[at[order[1:]]] == grams[at[order[:-1]]]) & (begin[order[1:]] == begin[order[:-1]])
    gap = at[order[1:]] - at[order[:-1]]
    later = order[1:][near]
    high[later] = np.minimum(high[later], gap[near])
    return low, np.maximum(low, high)


def _contexts(passage: int, gram: int):
    """The suffix at each given place and the words before it, as big-endian hashes, so bytes sort as words do.

    Runs of words reach no further to the left of a kept position than ``passage`` less its hashed words; what a
    longer match has there is covered by the kept positions before. ``low``/``high`` say which runs of words are to be
    grouped by hash as well (see ``_owned``); none for suffixes that the order settles.
    """
    reach = passage - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first, _, _ in lower_words(batch.column(0)):
                codes = (words >> np.uint64(32)).astype(">u4")
                back = codes[::-1].copy()
                lists = batch.column(4).slice(a, b - a)
                given = lists.flatten()
                at = np.concatenate([np.zeros(0, np.int64), given.field(0).to_numpy(zero_copy_only=False)]).astype(np.int64)
                often = np.concatenate([np.zeros(0, bool), given.field(1).to_numpy(zero_copy_only=False)]).astype(bool)
                row = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                place = at + first[row]
                end, begin, n = first[row + 1], first[row], len(codes)
                low, high = np.zeros((2, len(at)), np.int32)
                if often.any():
                    low[often], high[often] = _owned(window_hashes(words, gram), place[often], begin[often], end[often], passage, gram)
                right = [codes[p:min(p + passage, e)].tobytes() for p, e in zip(place.tolist(), end.tolist(), strict=True)]
                left = [back[n - p:n - max(p - reach, s)].tobytes() for p, s in zip(place.tolist(), begin.tolist(), strict=True)]
                rows = pa.array(row + a)
                for s in range(0, len(row), 4096):
                    take = rows.slice(s, 4096)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(take) for i in (1, 2, 3)), pa.array(at[s:s + 4096].astype(np.int32)),
                         pa.array(right[s:s + 4096], pa.binary()), pa.array(left[s:s + 4096], pa.binary()),
                         pa.array(low[s:s + 4096]), pa.array(high[s:s + 4096])],
                        [*_SUFFIX, "low", "high"])
    return run


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word codes as a padded matrix, and how many each row has."""
    rows = column.to_pylist()
    sizes = np.array([len(x) for x in rows], np.int64) // 4
    out = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in rows), ">u4").reshape(len(rows), width)
    return out, sizes


def _common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    equal = a == b
    length = np.where(equal.all(axis=1), a.shape[1], equal.argmin(axis=1))
    return np.minimum(length, np.minimum(na, nb))


_SUFFIX = ["h", "g", "doc", "place", "suffix", "before"]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last suffix of a partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first if first is not None else batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        for name, row in ((0, first), (1, last)):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name], pa.int32()),
                                              *row.columns], ["part", "end", *_SUFFIX])


def _neighbours(passage: int):
    """Rows that match a neighbour in the order, with the run of matching neighbours they are in.

    ``back``/``ahead`` hold words in common with the neighbour before to the left and right, if that one is smaller
    (else 0), and the same for the neighbour after. The first and the last row of a partition are always given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the last row, whose next neighbour is still to come
        held_run, held_back, count = -1, (0, 0, 0, False), 0

        def emit(table: pa.RecordBatch, runs: np.ndarray, spans: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(runs), part, np.int32)), pa.array(runs), *(pa.array(spans[:, i]) for i in range(4))]
            return pa.RecordBatch.from_arrays(
                [*columns, *table.columns], ["part", "run", "l0", "r0", "l1", "r1", *_SUFFIX]).filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = table.num_rows
            suffix, ns = _matrix(table.column(4), passage)
            before, nb = _matrix(table.column(5), passage)
            right = _common(suffix[:-1], ns[:-1], suffix[1:], ns[1:])
            left = _common(before[:-1], nb[:-1], before[1:], nb[1:])
            match = right + left >= passage
            order = list(zip(*(table.column(i).to_pylist() for i in (2, 0, 1, 3)), strict=True))
            later = np.array([x < y for x, y in zip(order, order[1:], strict=False)], bool)
            prior = np.concatenate([[held_back[3]], match])  # matches the row before
            after = np.concatenate([match, [False]])
            runs = np.empty(n, np.int64)
            base = count - (0 if held is None else 1)
            starts = np.where(prior, 0, base + np.arange(n))
            if held is not None:
                starts[0] = held_run
            runs = np.maximum.accumulate(starts)
            spans = np.zeros((n, 4), np.int32)
            spans[0, :2] = held_back[:2]
            spans[1:, 0], spans[1:, 1] = np.where(match & later, left, 0), np.where(match & later, right, 0)
            spans[:-1, 2], spans[:-1, 3] = np.where(match & ~later, left, 0), np.where(match & ~later, right, 0)
            keep = prior | after
            if held is None:
                keep[0] = True
            if n > 1:
                yield emit(table.slice(0, n - 1), runs[:-1], spans[:-1], keep[:-1])
            held, held_run = table.slice(n - 1, 1), int(runs[-1])
            held_back = (int(spans[-1, 0]), int(spans[-1, 1]), 0, bool(prior[-1]))
            count = base + n
        if held is not None:
            spans = np.array([[held_back[0], held_back[1], 0, 0]], np.int32)
            yield emit(held, np.array([held_run], np.int64), spans, np.array([True]))
    return run


def _spans(passage: int):
    """Removable spans (and the occurrences they repeat) of rows given with their run's smallest row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)
                     if name not in ("suffix", "before", "suffix0", "before0")}
            suffix, ns = _matrix(batch.column("suffix"), passage)
            before, nb = _matrix(batch.column("before"), passage)
            suffix0, ns0 = _matrix(batch.column("suffix0"), passage)
            before0, nb0 = _matrix(batch.column("before0"), passage)
            right, left = _common(suffix, ns, suffix0, ns0), _common(before, nb, before0, nb0)
            own = (frame["h"] == frame["h0"]) & (frame["g"] == frame["g0"]) & (frame["place"] == frame["place0"])
            found = ~own & (left + right >= passage)
            out = []

            def add(mask: np.ndarray, h: str, g: str, place: str, lo: np.ndarray, hi: np.ndarray, removed: bool) -> None:
                at = frame[place][mask].astype(np.int64)
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(frame[h][mask]), pa.array(frame[g][mask]), pa.array(at - lo[mask]), pa.array(at + hi[mask]),
                     pa.array(np.full(int(mask.sum()), removed))], ["h", "g", "start", "stop", "removed"]))

            add(found, "h", "g", "place", left, right, True)
            add(found, "h0", "g0", "place0", left, right, False)
            # chains drift: a row may repeat a smaller neighbour where it is unlike the smallest
            for lo, hi in (("l0", "r0"), ("l1", "r1")):
                add(~own & (frame[lo] + frame[hi] >= passage), "h", "g", "place", frame[lo], frame[hi], True)
            yield from out
    return run


def _windows(passage: int, gram: int):
    """Each run of ``passage`` words that rows of the order own, with its place and 128 bits of its words."""
    reach, salts = passage - gram, (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                suffix, _ = _matrix(batch.column("suffix"), passage)
                before, _ = _matrix(batch.column("before"), reach)
                codes = np.concatenate([before[:, ::-1], suffix], axis=1).astype(np.uint64)
                low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
                back = np.arange(reach + 1)
                row, back = np.nonzero((back >= low[:, None]) & (back < high[:, None]))
                bits = []
                for salt in salts:
                    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
                    np.cumsum(mix(codes + salt) * powers(_BASE, codes.shape[1])[:codes.shape[1]], axis=1, out=sums[:, 1:])
                    inverse = powers(_BASE_INVERSE, codes.shape[1] + 1)
                    start = reach - back
                    bits.append(pa.array(mix((sums[row, start + passage] - sums[row, start]) * inverse[start]).view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(3)),
                     pa.array((batch.column("place").to_numpy()[row] - back).astype(np.int32)), *bits], ["h", "g", "doc", "place", "u", "v"])
    return run


def _runs(passage: int):
    """Runs of ``passage`` words at the places of a text united where they touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at, offsets = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            order = np.lexsort((at, row))
            at, row = at[order], row[order]
            begins = np.ones(len(at), bool)
            begins[1:] = (np.diff(at) > passage) | (np.diff(row) > 0)
            ends = np.append(begins[1:], True)[:len(at)]
            take = pa.array(row[begins])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at[begins]), pa.array(at[ends] + passage),
                 batch.column(2).take(take)], ["h", "g", "start", "stop", "removed"])
    return run


def _grouped(order: DataFrame, passage: int, gram: int) -> DataFrame:
    """Spans of repeated runs of words that the order may miss, by the hash of the whole run."""
    runs = stored(order.where("low < high").mapInArrow(
        _windows(passage, gram), "h long, g long, doc long, place int, u long, v long"), "suffix-windows")
    # grouped where they are first, then stored, so that a run of words that very many texts share can be split in the join
    again = stored(runs.groupBy("u", "v").agg(F.min(F.struct("doc", "h", "g", "place")).alias("x"), F.count("*").alias("n"))
                   .where("n > 1").select("u", "v", "x"), "suffix-window-groups")
    later = F.struct("doc", "h", "g", "place") != F.col("x")
    places = runs.join(small_first(again), ["u", "v"]).select("h", "g", later.alias("removed"), "place")
    return (places.groupBy("h", "g", "removed").agg(F.collect_list("place").alias("places"))
            .mapInArrow(_runs(passage), "h long, g long, start long, stop long, removed boolean"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (start, stop) of a text united where they touch, as a flat list of borders."""
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            borders: list[int] = []
            for start, stop in sorted((x["start"], x["stop"]) for x in spans):
                if borders and start <= borders[-1]:
                    borders[-1] = max(borders[-1], stop)
                else:
                    borders += [start, stop]
            out.append(borders)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["h", "g", "removed", "borders"])


def _bridges(ends: list, lasts: dict[int, int], passage: int) -> list[tuple[int, int]]:
    """(run, run it continues) for runs that begin a partition and go on from the one before. One row a partition is looked at."""
    def run(part: int, local: int) -> int:
        return (part << 40) | local

    def codes(x: bytes) -> np.ndarray:
        return np.frombuffer(bytes(x), ">u4")

    def common(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differs = np.flatnonzero(x[:n] != y[:n])
        return int(differs[0]) if len(differs) else n

    rows = {(row["part"], row["end"]): row for row in ends}
    parts = sorted({part for part, _ in rows})
    out, goes_to = [], {}
    for before, part in zip(parts, parts[1:], strict=False):
        x, y = rows[before, 1], rows[part, 0]
        if (common(codes(x["suffix"]), codes(y["suffix"])) + common(codes(x["before"]), codes(y["before"]))) >= passage:
            last = run(before, lasts[before])
            goes_to[run(part, 0)] = goes_to.get(last, last)
            out.append((run(part, 0), goes_to[run(part, 0)]))
    return out


def repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """What is repeated: per document (doc_id, h, g, words), and per text with repeats (h, g, doc, copies, spans).

    ``spans`` holds borders ``[start, stop, ...]`` of word positions under ``removed`` (also found at a smaller
    place) and ``first`` (found again at a larger place).
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
                        *text_keys(F.col("text")))
    rows = stored(keyed.mapInArrow(_anchors(passage, gram), "doc_id long, h long, g long, words long, seeds array<long>, "
                                                            "places array<int>"), "suffix-anchors")
    texts = (rows.where(F.col("words") >= passage).groupBy("h", "g")
             .agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("doc"), F.count("*").alias("copies"),
                  F.count_distinct("doc_id").alias("ids"), F.first("seeds").alias("seeds"), F.first("places").alias("places"),
                  F.first("words").alias("words")))
    texts = stored(texts, "suffix-texts")
    places = texts.select("h", "g", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("h", "g", "x.seeds", "x.places")
    # stored apart, so that the join has two exchanges and a beginning that very many texts share can be split
    again = stored(places.groupBy("seeds").agg(F.count("*").alias("n")).where("n > 1")
                   .select("seeds", (F.col("n") > 2).alias("often")), "suffix-again")
    hits = stored(places.join(again, "seeds").groupBy("h", "g")
                  .agg(F.collect_list(F.struct("places", "often")).alias("places")), "suffix-hits")
    hit_texts = hits.join(texts.select("h", "g", "doc"), ["h", "g"])

    # the suffixes themselves, one text of each key
    keys = small_first(hits.select("h", "g"))
    one = (keyed.select("text", "h", "g").join(keys, ["h", "g"], "left_semi").groupBy("h", "g")
           .agg(F.first("text").alias("text")).join(hit_texts, ["h", "g"]).select("text", "h", "g", "doc", "places"))
    row = "h long, g long, doc long, place int, suffix binary, before binary"
    suffixes = one.mapInArrow(_contexts(passage, gram), f"{row}, low int, high int")
    many = hits.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // PARTITION_ROWS + 1)
    with small_batches(spark):
        order = checkpointed(suffixes.repartitionByRange(parts, "suffix", "doc", "h", "g", "place")
                             .sortWithinPartitions("suffix", "doc", "h", "g", "place"))
    grouped = _grouped(order, passage, gram)
    order = order.select(*_SUFFIX)
    matched = stored(order.mapInArrow(_neighbours(passage), f"part int, run long, l0 int, r0 int, l1 int, r1 int, {row}"),
                     "suffix-matched")
    ends = order.mapInArrow(_ends, f"part int, end int, {row}").collect()  # two rows a partition
    lasts = {x["part"]: x["run"] for x in matched.groupBy("part").agg(F.max("run").alias("run")).collect()}
    matched = matched.withColumn("run", F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("run")))
    bridges = _bridges(ends, lasts, passage)
    if bridges:
        runs, onto = zip(*bridges, strict=True)
        bridge = F.broadcast(spark.createDataFrame(pa.table({"run": runs, "onto": onto})))  # fewer rows than partitions
        matched = matched.join(bridge, "run", "left").withColumn("run", F.coalesce("onto", "run")).drop("onto")
    smallest = matched.groupBy("run").agg(F.min(F.struct("doc", "h", "g", "place", "suffix", "before")).alias("x"), F.count("*").alias("n"))
    smallest = smallest.where("n > 1").selectExpr("run", "x.h AS h0", "x.g AS g0", "x.place AS place0", "x.suffix AS suffix0",
                                                  "x.before AS before0")
    spans = (matched.join(smallest, "run").drop("part", "run", "doc")
             .mapInArrow(_spans(passage), "h long, g long, start long, stop long, removed boolean").unionAll(grouped).distinct())
    merged = (spans.groupBy("h", "g", "removed").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
              .mapInArrow(_merged, "h long, g long, removed boolean, borders array<long>"))
    merged = merged.groupBy("h", "g").agg(F.first(F.when(F.col("removed"), F.col("borders")), True).alias("removed"),
                                          F.first(F.when(~F.col("removed"), F.col("borders")), True).alias("first"))
    found = (texts.select("h", "g", "doc", "ids", "copies").join(merged, ["h", "g"], "left")
             .where("copies > 1 OR removed IS NOT NULL OR first IS NOT NULL"))
    return rows.select("doc_id", "h", "g", "words"), stored(found, "suffix-found")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, n_words, removed): the repeated passages of every document, none for clean documents.

    ``removed`` passages also stand at a smaller (doc_id, position); the others are first occurrences.
    """
    rows, found = repeats(docs, passage, gram)
    own = F.coalesce("doc_id", F.lit(_LAST)) == F.col("doc")
    whole = F.array(F.lit(0).cast("long"), F.col("words"))
    joined = rows.where(F.col("words") >= passage).join(found, ["h", "g"])
    sides = F.array(F.struct(F.when(own, F.col("removed")).otherwise(whole).alias("borders"), F.lit(True).alias("removed")),
                    F.struct(F.when(own & (F.col("ids") + (F.col("doc") == _LAST).cast("int") > 1), whole)
                             .when(own, F.col("first")).alias("borders"), F.lit(False).alias("removed")))
    return (joined.select("doc_id", F.explode(sides).alias("side")).where("side.borders IS NOT NULL")
            .select("doc_id", "side.removed", F.explode(F.expr("sequence(0, size(side.borders) - 2, 2)")).alias("i"),
                    F.col("side.borders").alias("borders"))
            .select("doc_id", F.expr("borders[i]").alias("start_word"), F.expr("borders[i + 1] - borders[i]").alias("n_words"), "removed"))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, borders: pa.Array) -> pa.Array:
    """The text without the words between the borders and the space after them."""
    from skyquill.llm.textkit import word_borders

    out = []
    for value, cut in zip(text.to_pylist(), borders.to_pylist(), strict=True):
        if value is None or cut is None:
            out.append(value)
            continue
        data = value.encode()
        starts, _, _ = word_borders(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        starts = np.append(starts, len(data))
        kept, at = [], 0
        for a, b in zip(cut[::2], cut[1::2], strict=True):
            kept.append(data[at:starts[a]])
            at = int(starts[b])
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``docs`` with removable passages cut out of ``text`` (and ``n_chars`` counted anew, if there is such a column).

    Documents of which no word is left, and copies of a text at a larger doc_id, go; all others stay.
    """
    _, found = repeats(docs, passage, gram)
    found = found.select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("doc").alias("_doc"), F.col("removed").alias("_cut"))
    h, g = text_keys(F.col("text"))
    # numbered names, so that no column clashes and no text is carried twice
    at = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{name}`").alias(c) for name, c in at.items()], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"),
                       h.alias("_key_h"), g.alias("_key_g"))
    rows = rows.join(small_first(found), (F.col("_key_h") == F.col("_h")) & (F.col("_key_g") == F.col("_g")), "left")
    rows = rows.where(F.col("_doc").isNull() | (F.col("_id") == F.col("_doc")))
    cut = F.col("_cut").isNotNull()
    rows = rows.withColumn("_rest", _without(F.when(cut, F.col(at["text"]).cast("string")), F.col("_cut")))
    rows = rows.where(~cut | F.col("_rest").rlike(r"[^\x20\x09-\x0D]"))
    anew = {"text": F.col("_rest").cast(docs.schema["text"].dataType)}
    if "n_chars" in at:
        anew["n_chars"] = F.char_length("_rest").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(F.when(cut, anew[name]).otherwise(F.col(c)) if name in anew else F.col(c)).alias(name) for name, c in at.items()])
