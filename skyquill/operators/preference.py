"""Skylines, dominance factors and top-delta dominant skylines.

Every query runs in the same three steps. Each input partition prunes its own
rows without a shuffle, unless its buffers would keep most of them: then groups
meet first. The survivors, far fewer than the input, are cut from their
lineage and counted per group. A group within ``block_rows`` is finished by one task; a larger one is cut into blocks along a space-filling order, and a pair of blocks is one
bounded task, unless the blocks' corners show that none of its rows can matter
to the other's. No group is ever held whole however many rows survive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.functions.dominance import Dim, as_dims, dominates, usable
from skyquill.functions.kernels import (
    dominance_factors,
    dominated_by as dominated_mask,
    dominated_by_tiles,
    group_codes,
    matrix,
    skyline_rows,
)
from skyquill.operators.blocks import block_pairs, corners, in_blocks, reachable_dims, same_keys
from skyquill.operators.ordering import arrival_rank, first_rows
from skyquill.runtime import (
    BROADCAST_ROWS,
    at_most,
    checkpointed,
    checkpointed_with_count,
    estimated_bytes,
    is_plain_scan,
    spread,
)

#: Survivors of one group that one task may finish alone.
BLOCK_ROWS = 16_384
#: Inputs smaller than this go to the local prune directly.
PREFILTER_ROWS = 200_000
#: Inputs smaller than this are always pruned before their groups meet.
MEET_ROWS = 200_000
#: Scans estimated below this are tried in one pass first.
SMALL_BYTES = 64 << 20
_PRUNE_BUFFER = 65_536
_SHARE_ROWS, _SHARE_POINTS = 50_000, 20_000
_MOST_PARTS = 5_000
#: Share of a buffer expected to stay from which on pruning before the shuffle is not worth its time.
_HARDLY = 0.25


class PreferenceAggregate:
    """Extension point: a set-valued aggregate over the rows of a group.

    ``prune`` may be applied to any subset of a group, any number of times, and
    must keep every row that can be in the answer. ``finish`` sees all surviving
    rows of a group; ``against`` scores one block of survivors with another and
    ``combine`` names the Spark aggregate that merges those scores, which is how
    a group too large for one task is finished.
    """

    #: extra output column filled by ``finish``, or None
    score: str | None = None
    #: whether a row's score is raised by rows alone that are no worse in every dimension
    only_dominance = False
    #: how many times ``block_rows`` survivors of a group one task may finish
    alone = 1

    def prune(self, codes: np.ndarray, points: np.ndarray) -> np.ndarray:
        return skyline_rows(codes, points)

    def finish(self, codes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return skyline_rows(codes, points), None

    def against(self, victims: np.ndarray, rivals: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def combine(self, column: str):
        return F.max(column)

    def accept(self, column: str, n_dims: int):
        raise NotImplementedError


class Skyline(PreferenceAggregate):
    """Rows that no row of their group dominates."""

    only_dominance = True
    alone = 4

    def against(self, victims, rivals):
        return dominated_by_tiles(victims, rivals).astype(np.int32)

    def accept(self, column, n_dims):
        return F.col(column) == 0


class DominanceFactor(PreferenceAggregate):
    """Skyline rows with the largest number of dimensions in which a rival that
    is better somewhere is no worse. Dominated rows cannot raise a factor, so
    the factor over the skyline equals the factor over all rows."""

    score = "factor"

    def finish(self, codes, points):
        rows = skyline_rows(codes, points)
        factors = np.zeros(len(rows), dtype=np.int32)
        kept = codes[rows]
        order = np.argsort(kept, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(kept[order]) != 0, True]) if len(rows) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            members = order[lo:hi]
            x = points[rows[members]]
            factors[members] = dominance_factors(x, x)
        return rows, factors

    def against(self, victims, rivals):
        return dominance_factors(victims, rivals)

    def accept(self, column, n_dims):
        return F.col(column) < n_dims


def _dim_names(dims: Sequence[Dim]) -> list[str]:
    return [f"__d{i}" for i in range(len(dims))]


def _pruner(keys: list[str], names: list[str], aggregate: PreferenceAggregate):
    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def reduced() -> pa.Table:
            table = pa.Table.from_batches(held)
            return table.take(aggregate.prune(group_codes(table, keys), matrix(table, names)))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _PRUNE_BUFFER:
                table = reduced()
                held, rows = table.to_batches(), table.num_rows
                if rows > _PRUNE_BUFFER // 2:  # hardly prunable: pass on, later steps are exact
                    yield from held
                    held, rows = [], 0
        if held:
            yield from reduced().to_batches()

    return prune


def _finisher(keys: list[str], names: list[str], aggregate: PreferenceAggregate, only_prune: bool = False):
    """For partitions sorted by the keys: finishes the groups that are complete
    in the buffer and carries the survivors of the open one. With ``only_prune``
    groups are pruned, and survivors of an open one beyond the buffer passed on."""

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def finished(table: pa.Table, codes: np.ndarray) -> list[pa.RecordBatch]:
            if only_prune:
                return table.take(aggregate.prune(codes, matrix(table, names))).to_batches()
            keep, score = aggregate.finish(codes, matrix(table, names))
            out = table.take(keep)
            if score is not None:
                out = out.append_column(aggregate.score, pa.array(score, pa.int32()))
            return out.to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _PRUNE_BUFFER:
                continue
            table = pa.Table.from_batches(held)
            codes = group_codes(table, keys)
            change = np.flatnonzero(codes[1:] != codes[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from finished(table.slice(0, cut), codes[:cut])
            tail = table.slice(cut)
            tail = tail.take(aggregate.prune(codes[cut:], matrix(tail, names)))
            held, rows = tail.to_batches(), tail.num_rows
            if only_prune and rows >= _PRUNE_BUFFER:
                yield from held
                held, rows = [], 0
        if held:
            table = pa.Table.from_batches(held)
            yield from finished(table, group_codes(table, keys))

    return finish


def _prefiltered(rows: DataFrame, keys: list[str], names: list[str], least_rows: int) -> DataFrame:
    """Drop, inside the scan, rows that one of a few strong rows of their group dominates.

    Two narrow aggregates over the dimension columns find those rows, one per
    weighting of the dimensions. They pay off because what the scan drops never
    crosses to Python; small inputs and groups skip them.
    """
    seen = rows.agg(
        F.count("*").alias("n"),
        *([F.approx_count_distinct(F.struct(*keys)).alias("groups")] if keys else []),
        *[F.min(n).alias(f"min{n}") for n in names], *[F.avg(n).alias(f"avg{n}") for n in names],
    ).first()
    groups = seen["groups"] if keys else 1
    pays = least_rows == 0 or seen["n"] >= 200 * groups
    if not seen["n"] or seen["n"] < least_rows or not pays or groups > BROADCAST_ROWS:
        return rows
    scaled = []
    for n in names:
        lowest, span = seen[f"min{n}"], seen[f"avg{n}"] - seen[f"min{n}"]
        scaled.append((F.col(n) - F.lit(lowest)) / F.lit(span if 0 < span < float("inf") else 1.0))
    strong = []
    for favoured in [None, *range(len(names))] if len(names) > 1 else [None]:
        score = reduce(lambda a, b: a + b, (c * (8 if i == favoured else 1) for i, c in enumerate(scaled)))
        strong.append(F.min_by(F.struct(*names), score))

    def beaten(by) -> Column:
        no_worse = reduce(and_, (by(n) <= F.col(n) for n in names))
        return no_worse & reduce(or_, (by(n) < F.col(n) for n in names))

    if not keys:
        found = {tuple(r) for r in rows.agg(*[c.alias(f"s{i}") for i, c in enumerate(strong)]).first()}
        hits = [beaten(lambda n, r=r: F.lit(r[names.index(n)])) for r in sorted(found)]
        return rows.filter(~reduce(or_, hits))
    renamed = [f"__k{i}" for i in range(len(keys))]
    best = checkpointed(
        rows.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, renamed)])
        .agg(*[c.alias(f"__s{i}") for i, c in enumerate(strong)])
    )
    if not at_most(best, BROADCAST_ROWS):
        return rows
    match = reduce(and_, (F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, renamed)))
    hits = [beaten(lambda n, i=i: F.col(f"__s{i}.{n}")) for i in range(len(strong))]
    kept = rows.join(F.broadcast(best), match).filter(~reduce(or_, hits))
    return kept.select(*rows.columns)


def _with_score(schema: T.StructType, aggregate: PreferenceAggregate) -> T.StructType:
    fields = list(schema.fields)
    if aggregate.score:
        fields.append(T.StructField(aggregate.score, T.IntegerType()))
    return T.StructType(fields)


def _parts(df: DataFrame, count: int) -> int:
    """Shuffle partitions for ``count`` rows of many groups: two buffers of rows each, or as many as the session has."""
    return min(_MOST_PARTS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // (2 * _PRUNE_BUFFER))))


def _finish_small(
    rows: DataFrame, keys: list[str], values: dict[str, Column], aggregate: PreferenceAggregate, count: int = 0,
) -> DataFrame:
    """Every group finished by one task; ``values`` are worked out behind the shuffle."""
    names = list(values)
    rows = rows.drop(*names)
    if not keys:
        placed = rows.repartition(1)
    else:
        # Spark leaves out a shuffle by the keys of a join below it, and a join that turns into a broadcast join
        # while it runs no longer keeps those together; it does not leave out one by their hash
        by = F.xxhash64(*keys)
        # the work of a group is not seen in its bytes
        placed = rows.repartition(_parts(rows, count), by) if count >= PREFILTER_ROWS else rows.repartition(by)
        placed = placed.sortWithinPartitions(*keys)
    placed = placed.withColumns(values)
    return placed.mapInArrow(_finisher(keys, names, aggregate), _with_score(placed.schema, aggregate))


def _hardly_prunable(groups: int, n_dims: int) -> bool:
    """Whether the rows that a buffer holds of each group would mostly stay, as independent dimensions let expect.

    Of m rows in d dimensions s(m, d) are on the skyline: the sum of s(i, d - 1) / i for i up to m, with s(i, 1) = 1.
    """
    rows = np.arange(1, max(1, _PRUNE_BUFFER // max(1, groups)) + 1)
    expected = np.ones(len(rows))
    for _ in range(n_dims - 1):
        expected = np.cumsum(expected / rows)
    return expected[-1] > rows[-1] * _HARDLY


def _met(
    rows: DataFrame, keys: list[str], values: dict[str, Column], aggregate: PreferenceAggregate, sizes: DataFrame, count: int, most: int,
) -> DataFrame:
    """The groups brought together before any of their rows are pruned, in parts of about ``most`` rows if they are larger."""
    large = checkpointed(sizes.filter(F.col("n") > most).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.ceil(F.col("n") / most).alias("__parts")))
    dealt = rows.withColumn("__rid", F.monotonically_increasing_id())
    dealt = dealt.join(F.broadcast(large) if at_most(large, BROADCAST_ROWS) else large, same_keys(keys, "__k"), "left")
    dealt = dealt.withColumn("__part", F.pmod(F.col("__rid"), F.coalesce("__parts", F.lit(1))).cast("int"))
    dealt = dealt.select(*rows.columns, "__part")
    by = [*keys, "__part"]
    placed = dealt.repartition(_parts(rows, count), *by).sortWithinPartitions(*by).withColumns(values)
    return placed.mapInArrow(_finisher(by, list(values), aggregate, only_prune=True), placed.schema).drop("__part")


def _on(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in keys))


def _dealt(rows: DataFrame, hot: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Rows of the hot groups, each group dealt by hash over as many ``__block`` as it needs."""
    sized = hot.select(*keys, F.ceil(F.col("__rows") / block_rows).cast("int").alias("__blocks"))
    if keys:
        renamed = sized.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__blocks")
        joined = rows.join(renamed, same_keys(keys, "__k")).drop(*[f"__k{i}" for i in range(len(keys))])
    else:
        joined = rows.withColumn("__blocks", F.lit(sized.first()["__blocks"]))
    return joined.withColumn("__block", F.pmod(F.xxhash64("__rid"), F.col("__blocks")).cast("int")).drop("__blocks")


def _scores(victims: DataFrame, rivals: DataFrame, pairs: DataFrame, names: list[str], aggregate: PreferenceAggregate) -> DataFrame:
    """(__rid, __score) of the victims: one bounded task for each pair of blocks, whose scores meet in an aggregate."""
    columns = ["__vb", "__rb", "__rid", "__z", *names, "__victim"]
    left = victims.withColumn("__vb", F.col("__block")).join(pairs, "__vb").withColumn("__victim", F.lit(True))
    right = rivals.withColumn("__rb", F.col("__block")).join(pairs, "__rb").withColumn("__victim", F.lit(False))

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by("__z")  # neighbours share a tile
        victim = table.column("__victim").to_numpy()
        points = matrix(table, names)
        found = aggregate.against(points[victim], points[~victim])
        ids = table.column("__rid").to_numpy()[victim]
        return pa.table({"__rid": ids, "__score": pa.array(found, pa.int32())})

    return (
        left.select(*columns).unionByName(right.select(*columns)).groupBy("__vb", "__rb").applyInArrow(pair, "__rid long, __score int")
        .groupBy("__rid").agg(aggregate.combine("__score").alias("__score"))
    )


def _finish_large(
    rows: DataFrame, keys: list[str], names: list[str], aggregate: PreferenceAggregate, block_rows: int, count: int,
) -> DataFrame:
    """Scores blocks of a group against those of its blocks that the corners do not rule out."""
    blocks = in_blocks(rows, keys, names, block_rows, count)
    d = len(names)
    if isinstance(aggregate, DominanceFactor):
        # dominated rows cannot raise a factor: they go first, and what is left is dealt anew
        best = _survivors(blocks, keys, names, Skyline(), d)
        blocks = in_blocks(best.drop("__z", "__block"), keys, names, block_rows, count)
        return _factors(blocks, keys, names, aggregate)
    out = _survivors(blocks, keys, names, aggregate, d).drop("__z", "__block")
    return out.withColumnRenamed("__score", aggregate.score) if aggregate.score else out.drop("__score")


def _survivors(blocks: DataFrame, keys: list[str], names: list[str], aggregate: PreferenceAggregate, d: int) -> DataFrame:
    table = checkpointed(corners(blocks, keys, names))
    meet = reachable_dims(d) == d if aggregate.only_dominance else F.lit(True)
    pairs = checkpointed(block_pairs(table, table, keys, meet))
    scores = _scores(blocks, blocks, pairs, names, aggregate).filter(aggregate.accept("__score", d))
    out = blocks.join(scores, "__rid")
    return out if aggregate.score else out.drop("__score")


def _factors(blocks: DataFrame, keys: list[str], names: list[str], aggregate: DominanceFactor) -> DataFrame:
    """Factors of skyline rows: against their own block first; a factor of one below the number of dimensions is final."""
    d = len(names)
    own = blocks.select(F.col("__block").alias("__vb"), F.col("__block").alias("__rb")).distinct()
    first = checkpointed(blocks.select("__rid", "__block", *keys, "__z", *names).join(
        _scores(blocks, blocks, own, names, aggregate), "__rid"))
    open_ = first.filter(F.col("__score") < d - 1)
    table = checkpointed(corners(blocks, keys, names))
    least = open_.groupBy("__block").agg(F.min("__score").alias("__least"))
    victims = corners(open_, keys, names).join(least, "__block")
    rest = block_pairs(victims, table, keys, reachable_dims(d) > F.col("__least")).filter("__vb <> __rb")
    more = _scores(open_, blocks, checkpointed(rest), names, aggregate)
    scores = first.select("__rid", "__score").unionByName(more).groupBy("__rid").agg(aggregate.combine("__score").alias(aggregate.score))
    return blocks.drop("__z", "__block").join(scores, "__rid")


def evaluate(
    df: DataFrame,
    dims: Sequence[Dim | str],
    keys: Sequence[str] = (),
    aggregate: PreferenceAggregate | None = None,
    *,
    block_rows: int = BLOCK_ROWS,
    compact_rows: int | None = None,
    small_bytes: int = SMALL_BYTES,
    prefilter_rows: int = PREFILTER_ROWS,
    meet_rows: int = MEET_ROWS,
) -> DataFrame:
    """Run a preference aggregate per group of ``keys``.

    A plain scan of less than ``small_bytes`` whose groups fit a task is finished in one pass; in one of
    ``prefilter_rows`` rows or more, what a few strong rows dominate is dropped inside the scan. Both choose between
    ways to the same result; 0 turns the first off and the second on for every size. A scan of ``meet_rows`` rows or more
    with so many groups and dimensions that a buffer would keep most of its rows is shuffled first and pruned by whole groups.

    ``compact_rows`` says the input is already the small result of an earlier
    step, cheap to read twice and with at most that many rows, so the local
    prune and the checkpoint are skipped.
    """
    return evaluate_bounded(df, dims, keys, aggregate, block_rows, compact_rows, small_bytes, prefilter_rows, meet_rows)[0]


def evaluate_bounded(
    df: DataFrame, dims: Sequence[Dim | str], keys: Sequence[str] = (), aggregate: PreferenceAggregate | None = None,
    block_rows: int = BLOCK_ROWS, compact_rows: int | None = None, small_bytes: int = SMALL_BYTES,
    prefilter_rows: int = PREFILTER_ROWS, meet_rows: int = MEET_ROWS,
) -> tuple[DataFrame, int]:
    """As ``evaluate``, with an upper bound on the number of rows of the result."""
    dims, keys, aggregate = as_dims(dims), list(keys), aggregate or Skyline()
    names = _dim_names(dims)
    values = {n: d.value() for n, d in zip(names, dims)}
    columns = df.columns
    rows = df.filter(usable(dims))
    output = columns + ([aggregate.score] if aggregate.score else [])
    bound = compact_rows
    alone = block_rows * aggregate.alone

    def oversized(candidates: DataFrame) -> DataFrame:
        grouped = candidates.groupBy(*keys) if keys else candidates.groupBy()
        return grouped.agg(F.count("*").alias("__rows")).filter(F.col("__rows") > alone)

    if compact_rows is None:
        plain = is_plain_scan(df)
        small = plain and (estimated_bytes(df) or small_bytes) < small_bytes
        met = False
        if small or plain and keys:
            # the rows without a place in the order are counted too, so that the dimensions need not be read
            sizes = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count("*").alias("n"))
            seen = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
            largest, n = seen["largest"] or 0, seen["n"] or 0
            met = bool(keys) and n >= meet_rows and _hardly_prunable(seen["groups"], len(dims))
            # a small scan, or one that is shuffled anyway: when every raw group fits a task, one pass finishes it
            if small and largest <= block_rows or met and largest <= alone:
                return _finish_small(rows, keys, values, aggregate, n).select(*output), n
        if met:
            rows = _met(rows, keys, values, aggregate, sizes, n, alone)
        else:
            rows = rows.withColumns(values)
            if plain:
                rows = _prefiltered(rows, keys, names, prefilter_rows)
            rows = spread(rows).mapInArrow(_pruner(keys, names, aggregate), rows.schema)
        rows, bound = checkpointed_with_count(rows)
    else:
        rows = rows.withColumns(values)

    if bound <= alone or oversized(rows).isEmpty():
        return _finish_small(rows, keys, values, aggregate, bound).select(*output), bound

    # merge step: blocks of one group meet in one task each and prune again
    rows = checkpointed(rows.withColumn("__rid", F.monotonically_increasing_id()))
    hot = checkpointed(oversized(rows))
    dealt = _dealt(rows, hot, keys, 4 * block_rows)
    merged = dealt.repartition(*keys, "__block").mapInArrow(_pruner(keys, names, aggregate), dealt.schema)
    rest = _without(rows, hot, keys)
    rows = checkpointed(merged.drop("__block").unionByName(rest))
    hot = checkpointed(oversized(rows))
    small = _finish_small(_without(rows, hot, keys).drop("__rid"), keys, values, aggregate, bound).select(*output)
    if hot.isEmpty():
        return small, bound
    big = rows.join(hot.drop("__rows"), _on(rows, hot, keys), "left_semi") if keys else rows
    large = _finish_large(big, keys, names, aggregate, block_rows, hot.agg(F.sum("__rows")).first()[0])
    return small.unionByName(large.select(*output)), bound


def _without(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return rows.join(hot.drop("__rows"), _on(rows, hot, keys), "left_anti")
    return rows.limit(0) if not hot.isEmpty() else rows


def skyline(df: DataFrame, dims: Sequence[Dim | str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Rows no other row of the same group dominates; equal rows are all kept."""
    return evaluate(df, dims, keys, Skyline(), **options)


def dominance_factor(df: DataFrame, dims: Sequence[Dim | str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Skyline rows with their dominance factor, always below the number of dimensions."""
    return evaluate(df, dims, keys, DominanceFactor(), **options)


def k_dominant(df: DataFrame, dims: Sequence[Dim | str], k: int, keys: Sequence[str] = (), **options) -> DataFrame:
    """Rows whose dominance factor is below ``k``."""
    return dominance_factor(df, dims, keys, **options).filter(F.col("factor") < k)


def merge_factors(*parts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Factors of the same rows measured against different rival sets combine by maximum."""
    return reduce(DataFrame.unionByName, parts).groupBy(*ids).agg(F.max("factor").alias("factor"))


def top_delta(
    df: DataFrame, dims: Sequence[Dim | str], delta: int = 100, keys: Sequence[str] = (),
    ties: Sequence[str] = (), **options,
) -> DataFrame:
    """The ``delta`` rows of smallest factor per group, ties broken by dimensions and ``ties``."""
    dims = as_dims(dims)
    scored = dominance_factor(df, dims, keys, **options)
    order = [F.col("factor"), *[d.value() for d in dims], *[F.col(t) for t in ties]]
    if not keys:
        return first_rows(scored, delta, order)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("__place", place).filter(F.col("__place") <= delta).drop("__place")


def result_sizes(result: DataFrame, keys: Sequence[str], name: str = "n_points") -> DataFrame:
    return result.groupBy(*keys).agg(F.count("*").alias(name))


def merge_skylines(left: DataFrame, right: DataFrame, dims: Sequence[Dim | str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Skyline of two partial skylines."""
    return skyline(left.unionByName(right), dims, keys, **options)


def maintain_skyline(
    current: DataFrame, batch: DataFrame, dims: Sequence[Dim | str], keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Add a batch to a maintained skyline: the new skyline and the per-group number of old rows it removed."""
    marked = current.withColumn("__old", F.lit(1)).unionByName(batch.withColumn("__old", F.lit(0)))
    merged = checkpointed(skyline(marked, dims, keys))

    def count(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy(*keys) if keys else df.groupBy()).agg(F.sum("__old").alias(name))

    before, after = count(marked, "before"), count(merged, "after")
    if keys:
        removed = before.join(after, list(keys), "left")
        removed = removed.select(*keys, (F.coalesce("before", F.lit(0)) - F.coalesce("after", F.lit(0))).alias("removed"))
    else:
        removed = before.select(
            (F.coalesce("before", F.lit(0)) - F.lit(after.first()["after"] or 0)).alias("removed"))
    return merged.drop("__old"), removed


def block_skyline(
    df: DataFrame, dims: Sequence[Dim | str], block_size: int, order: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Skyline of every ``block_size`` consecutive arrivals, and the skyline of all blocks merged."""
    ranked = arrival_rank(df, order, "__rank")
    blocks = ranked.withColumn("block_id", F.expr(f"__rank div {int(block_size)}")).drop("__rank")
    per_block = checkpointed(skyline(blocks, dims, ["block_id"]))
    return per_block, skyline(per_block, dims)


def dominated_by_point(df: DataFrame, dims: Sequence[Dim | str], point: Sequence[float]) -> DataFrame:
    """Rows that one given point dominates; a plain filter."""
    dims = as_dims(dims)
    pairs = [(F.lit(float(v)) * d.sign, d.value()) for d, v in zip(dims, point, strict=True)]
    no_worse = reduce(and_, (p <= q for p, q in pairs))
    return df.filter(no_worse & reduce(or_, (p < q for p, q in pairs)))


def dominated_by(df: DataFrame, points: DataFrame, dims: Sequence[Dim | str], broadcast_rows: int | None = None) -> DataFrame:
    """Rows of ``df`` that some row of ``points`` dominates.

    Only the skyline of ``points`` matters. Up to ``broadcast_rows`` (``BROADCAST_ROWS``) it travels to the
    data; beyond that both sides meet in blocks.
    """
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    dims = as_dims(dims)
    names = _dim_names(dims)
    rows = df.filter(usable(dims)).withColumns({n: d.value() for n, d in zip(names, dims)})
    best = skyline(points, dims).select(*[d.value().alias(n) for n, d in zip(names, dims)])
    best = checkpointed(best.distinct())
    if at_most(best, broadcast_rows):
        shared = np.array([tuple(r) for r in best.collect()], dtype=np.float64).reshape(-1, len(names))

        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                mask = dominated_mask(matrix(table, names), shared, strict=True)
                yield from table.filter(pa.array(mask)).to_batches()

        return rows.mapInArrow(keep, rows.schema).drop(*names)
    worse = checkpointed(df.filter(usable(dims)).withColumn("__rid", F.monotonically_increasing_id()))  # ids must not change
    asked = best.select(*[(F.col(n) * d.sign).alias(f"point_{d.column}") for n, d in zip(names, dims)])
    left, right = _theta_blocks(worse, asked, broadcast_rows)
    met = left.hint("merge").join(right, [left["__share"] == right["__s"], left["__block"] == right["__b"], _beaten(dims)], "left_semi")
    return met.dropDuplicates(["__rid"]).select(*df.columns)


def _beaten(dims: Sequence[Dim]) -> Column:
    """The row is dominated by the point in the columns with the prefix ``point_``."""
    pairs = [(Dim(f"point_{d.column}", d.sign).value(), d.value()) for d in dims]
    return reduce(and_, (p <= q for p, q in pairs)) & reduce(or_, (p < q for p, q in pairs))


def _theta_blocks(rows: DataFrame, points: DataFrame, broadcast_points: int) -> tuple[DataFrame, DataFrame]:
    """Every row meets every point in exactly one (share, block) cell of bounded size.

    A row is copied to every block and a point to every share, so both hold thousands, however few points would be broadcast.
    Few rows have very many pairs, so the size of the copies does not tell how many tasks the cells need.
    """
    blocks = -(-max(1, points.count()) // max(_SHARE_POINTS, broadcast_points))
    shares = -(-max(1, rows.count()) // _SHARE_ROWS)
    left = rows.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)).cast("int")).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = points.withColumn("__b", F.pmod(F.xxhash64(*points.columns), F.lit(blocks)).cast("int")).withColumn(
        "__s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    if blocks * shares > 1:
        parts = min(_MOST_PARTS, max(blocks * shares, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.repartition(parts, "__share", "__block"), right.repartition(parts, "__s", "__b")
    return left, right


def dominance_pairs(df: DataFrame, points: DataFrame, dims: Sequence[Dim | str], broadcast_rows: int | None = None) -> DataFrame:
    """Every (row, point) pair in which the point dominates the row; point columns get the prefix ``point_``.

    Up to ``broadcast_rows`` (``BROADCAST_ROWS``) points are broadcast. More of them meet the rows in cells that
    hold a bounded share of both sides.
    """
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    dims = as_dims(dims)
    points = checkpointed(points)  # counted, then joined
    renamed = points.select(*[F.col(c).alias(f"point_{c}") for c in points.columns])
    if at_most(points, broadcast_rows):
        return df.join(F.broadcast(renamed), _beaten(dims))
    left, right = _theta_blocks(df, renamed, broadcast_rows)
    met = left.hint("merge").join(right, [left["__share"] == right["__s"], left["__block"] == right["__b"], _beaten(dims)])
    return met.drop("__share", "__block", "__s", "__b")


__all__ = [
    "PreferenceAggregate", "Skyline", "DominanceFactor", "evaluate", "skyline", "dominance_factor", "k_dominant",
    "merge_factors", "top_delta", "result_sizes", "merge_skylines", "maintain_skyline", "block_skyline",
    "dominated_by", "dominated_by_point", "dominance_pairs", "dominates",
]
