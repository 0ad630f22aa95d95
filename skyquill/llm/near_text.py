"""Near-duplicate texts by SetSketch: banded registers propose, a joint likelihood estimates, full sets decide.

Two documents are linked when the Jaccard similarity of their sets of distinct shingles reaches a threshold.
Documents of one set are collapsed first, so copies cost a group-by. Links are only needed between sets that
are not connected yet: every set is first tried with the likeliest of the smallest sets of its buckets, and only
buckets that still hold several components afterwards are compared inside, in blocks. A block only looks for
partners of sets outside its largest component, first by registers; where some are plausible, the full sets of those
concerned are brought together once, and what leaves the block is links that connect components, not pairs.

Null or empty texts (or texts of separators alone) have no shingle and are linked with nothing. A null ``doc_id``
never becomes a component's id unless all of the component are null. Repeated rows are copies of each other.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.llm import setsketch
from skyquill.llm.storage import components, same, small_first, stored
from skyquill.llm.textkit import lower_words, mix, shingle_sets

#: Words of a shingle, the similarity that links (percent), and the bands: a pair at 0.75 shares no band of four
#: registers among 32 with a chance of 5e-6.
WIDTH, PERCENT, BANDS, ROWS = 5, 75, 32, 4
#: Pairs are dropped unseen when their estimate is this many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Members of a bucket that are compared in one task at once.
BLOCK = 1024

_NODE = "named_struct('p', p, 'q', q)"
_LAST = (1 << 63) - 1


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that two sets share only if they are equal."""
    p = np.array([mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) for s in sets], np.uint64)
    q = np.array([mix(s ^ np.uint64(0xC6BC279692B5CC83)).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
    return p.view(np.int64), q.view(np.int64)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first, _, _ in lower_words(batch.column(1)):
                sets = shingle_sets(words, first, width)
                p, q = fingerprints(sets)
                values = setsketch.sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(p), pa.array(q),
                     pa.array([len(s) for s in sets], pa.int64()), _binary([row.tobytes() for row in values])],
                    ["doc_id", "h", "p", "q", "n", "sketch"])
    return run


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, p, q, n, sketch) per document: hash of its text, fingerprint, size and registers of its set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       _text_hash(F.col("text")).alias("h")).mapInArrow(
        _sketch(width), "doc_id long, h long, p long, q long, n long, sketch binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 4096):
            part = batch.slice(s, 4096)
            keys = setsketch.band_keys(_registers(part.column(2)), BANDS, ROWS)
            at = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            band = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(band), part.column(0).take(at),
                                              part.column(1).take(at)], ["bucket", "band", "p", "q"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _plausible(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                size = [part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
                estimate, ratio = setsketch.estimates(_registers(part.column(4)), _registers(part.column(5)), *size, share)
                keep = pa.array(ratio <= DEVIATIONS ** 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(estimate)],
                                                 ["a", "b", "estimate"]).filter(keep)
    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = np.empty(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            shared[i] = (both[1:] == both[:-1]).sum()
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared)], ["a", "b", "na", "nb", "shared"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, first, _, _ in lower_words(batch.column(0)):
                sets = shingle_sets(words, first, width)
                p, q = fingerprints(sets)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), _binary([s.tobytes() for s in sets])],
                                                 ["p", "q", "members"])
    return run


class _Links:
    """The confirmed links so far, and the components they make."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> None:
        self.docs, self.nodes, self.width, self.percent = docs, nodes, width, percent
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def rooted(self, df: DataFrame, node: str, root: str) -> DataFrame:
        """``df`` with the component of ``node``; a node without links is its own."""
        if self.roots is None:
            return df.withColumn(root, F.col(node))
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
        return df.join(roots, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")

    def take(self, new: DataFrame) -> None:
        self.links = stored(new if self.links is None else self.links.unionAll(new), "near-links")
        self.roots = stored(components(self.links), "near-roots")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, n, members): the full sets of ``wanted`` (node), from their texts."""
        wanted = stored(wanted.distinct().join(self.nodes.select("node", "n", "one"), "node"), "near-ends")
        ids = small_first(wanted.select("one").distinct())
        texts = (self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .join(ids, same(F.col("doc_id"), F.col("one")), "left_semi").select("text"))
        sets = texts.mapInArrow(_sets(self.width), "p long, q long, members binary").selectExpr(f"{_NODE} AS node", "members")
        return stored(sets.join(wanted.select("node", "n"), "node").groupBy("node").agg(
            F.first("n").alias("n"), F.first("members").alias("members")), "near-sets")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare full sets of ``pairs`` (a, b) and take those that reach the threshold as links."""
        pairs = stored(pairs.select("a", "b"), "near-pairs")
        sets = self.sets(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))))
        left = sets.selectExpr("node AS a", "n AS na", "members AS x")
        right = sets.selectExpr("node AS b", "n AS nb", "members AS y")
        seen = (pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y")
                .mapInArrow(_overlaps, "a struct<p:long,q:long>, b struct<p:long,q:long>, na long, nb long, shared long"))
        self.take(seen.where(f"100 * shared >= {self.percent} * (na + nb - shared)").select("a", "b"))


class _Cell:
    """Two blocks of a bucket (or one with itself): the plausible pairs of sets in different components."""

    def __init__(self, table: pa.Table, share: float) -> None:
        table = table.combine_chunks()
        self.share, self.table = share, table
        self.first, self.p, self.q, self.n = (table[c].to_numpy() for c in ("first", "p", "q", "n"))
        self.values = _registers(table["sketch"].combine_chunks())
        self.band, self.diagonal = table["band"][0].as_py(), table["diagonal"][0].as_py()
        roots = np.stack([table["rp"].to_numpy(), table["rq"].to_numpy()], axis=1)
        _, self.root, sizes = np.unique(roots, axis=0, return_inverse=True, return_counts=True)
        self.root = self.root.reshape(-1)
        #: every pair of different components has an end outside the largest
        self.outside = self.root != sizes.argmax()

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, others, estimates): each plausible pair once in all buckets that hold both."""
        for i in np.flatnonzero(self.outside):
            other = self.root != self.root[i]
            if not self.diagonal:
                other &= self.first != self.first[i]
            other[:i] &= ~self.outside[:i]
            other = np.flatnonzero(other)
            equal = self.values[other] == self.values[i]
            # far below the threshold whatever the sizes; and a pair that shares several bands belongs to the first
            near = np.count_nonzero(equal, axis=1) >= (self.share - 0.2) * self.values.shape[1]
            other, equal = other[near], equal[near]
            own = equal[:, :BANDS * ROWS].reshape(len(other), BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band
            other = other[own]
            if not len(other):
                continue
            estimate, ratio = setsketch.estimates(
                np.broadcast_to(self.values[i], (len(other), self.values.shape[1])), self.values[other],
                np.full(len(other), self.n[i]), self.n[other], self.share)
            keep = ratio <= DEVIATIONS ** 2
            if keep.any():
                yield i, other[keep], estimate[keep]


def _concerned(share: float):
    """The rows of a cell that have a plausible partner."""
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, share)
        found = np.zeros(len(cell.p), bool)
        for i, other, _ in cell.pairs():
            found[i] = True
            found[other] = True
        return cell.table.filter(pa.array(found))
    return run


def _connecting(share: float, percent: int):
    """Links of a cell, on full sets: enough of them to connect what they connect."""
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, share)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.table["members"].combine_chunks()]
        above = np.arange(cell.root.max() + 1)

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        links = []
        for i, other, estimate in cell.pairs():
            for j in other[np.argsort(-estimate, kind="stable")]:
                x, y = top(cell.root[i]), top(cell.root[j])
                if x == y:
                    continue
                small, large = sorted((sets[i], sets[j]), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int(np.count_nonzero(large[at] == small))
                if 100 * shared >= percent * (len(small) + len(large) - shared):
                    above[max(x, y)] = min(x, y)
                    links.append((i, j))
        a, b = np.array(links, int).reshape(-1, 2).T

        def node(i: np.ndarray) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array(cell.p[i]), pa.array(cell.q[i])], ["p", "q"])
        return pa.table({"a": node(a), "b": node(b)})
    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, root, n_shingles, component_id, kept) per document; see the module for what counts as a link.

    ``h`` is a hash of the text, ``root`` names the component, also where ids are null or repeated.
    """
    share = percent / 100
    rows = stored(sketched(docs, width), "near-sketches")
    nodes = stored(rows.where("n > 0").groupBy("p", "q").agg(F.min("doc_id").alias("one"), F.first("n").alias("n"),
                                                             F.first("sketch").alias("sketch"))
                   .withColumn("node", F.expr(_NODE)), "near-nodes")
    found = _Links(docs, nodes, width, percent)

    members = stored(nodes.select("p", "q", "sketch").mapInArrow(_bands, "bucket long, band int, p long, q long")
                     .selectExpr("bucket", "band", f"{_NODE} AS node"), "near-bands")
    buckets = stored(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"))
                     .where("size > 1"), "near-buckets")
    members = stored(members.join(buckets, "bucket"), "near-members")
    # each set is tried with the likeliest of the smallest sets of its buckets
    side = nodes.select("node", "n", "sketch")
    stars = members.where("node <> low").selectExpr("node AS a", "low AS b").distinct()
    stars = (stars.join(side.selectExpr("node AS a", "n AS na", "sketch AS sa"), "a")
             .join(side.selectExpr("node AS b", "n AS nb", "sketch AS sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
             .mapInArrow(_plausible(share), "a struct<p:long,q:long>, b struct<p:long,q:long>, estimate double"))
    stars = stars.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
    found.confirm(stars)

    # what is left: buckets that hold several components
    rooted = found.rooted(members, "node", "root")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    cells = (rooted.join(mixed, "bucket").join(side, "node")
             .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .selectExpr("bucket", "least(block, other) AS i", "greatest(block, other) AS j", "band", "block = other AS diagonal",
                         "block <= other AS first", "node.p AS p", "node.q AS q", "root.p AS rp", "root.q AS rq", "n", "sketch"))
    concerned = stored(cells.groupBy("bucket", "i", "j").applyInArrow(_concerned(share), cells.schema), "near-cells")
    sets = found.sets(concerned.selectExpr(f"{_NODE} AS node")).selectExpr("node.p AS p", "node.q AS q", "members")
    found.take(concerned.join(sets, ["p", "q"]).groupBy("bucket", "i", "j").applyInArrow(
        _connecting(share, percent), "a struct<p:long,q:long>, b struct<p:long,q:long>"))

    rooted = found.rooted(nodes.select("node", "one"), "node", "root")
    smallest = rooted.groupBy("root").agg(F.min("one").alias("component_id"))
    rooted = stored(rooted.join(smallest, "root").selectExpr("node.p AS p", "node.q AS q", "root", "component_id"), "near-classes")
    return (rows.drop("sketch").join(rooted, ["p", "q"], "left")
            .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "h", "root", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id (of several rows, one of the least text hash).

    Documents without words are in no component and stay.
    """
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "h")
    found = near_duplicates(docs, width, percent).where("n_shingles > 0").select("root", own.alias("own"))
    found = stored(found, "near-found")
    best = found.groupBy("root").agg(F.min("own").alias("best"), F.count("*").alias("n")).where("n > 1")
    found = stored(found.join(best, "root").groupBy("own", "best").agg(F.count("*").alias("n")), "near-judged")
    gone = found.where("own <> best").select(F.col("own").alias("_gone")).distinct()
    twice = found.where("own = best AND n > 1").select(F.col("own").alias("_twice")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), _text_hash(F.col("text")).alias("h")).alias("_own"))
    rows = rows.join(small_first(gone), F.col("_own") == F.col("_gone"), "left_anti")
    if not twice.isEmpty():  # rows of one doc_id and text
        once = rows.join(small_first(twice), F.col("_own") == F.col("_twice"), "left_semi").dropDuplicates(["_own"])
        rows = rows.join(small_first(twice), F.col("_own") == F.col("_twice"), "left_anti").unionAll(once)
    return rows.select("row.*")
