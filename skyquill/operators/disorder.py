"""Slack-based progress, late-row accounting and in-order emission over whole inputs.

The rules are a fold over arrival order. Over one global input they run as a
few passes over range partitions: each pass folds its partition from a carried
state, and only one summary row per partition reaches the driver, which chains
them into the carried states of the next pass. The adaptive rules are a control
loop per source and run as a relay over the partitions of a source.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.operators.ordering import PART, POS, range_ordered
from skyquill.operators.relay import relay
from skyquill.operators.windows import micros
from skyquill.runtime import checkpointed

_NONE = int(np.iinfo(np.int64).max)
_LOWEST = int(np.iinfo(np.int64).min)
#: Fixed values of the adaptive rule: proportional, integral and derivative gain, sampling period.
GAINS = (6.0, 0.6, 0.2)
SAMPLE_MICROS = 100_000


class SlackFold:
    """Progress state of one arrival sequence: highest event time, open segment, slack, progress."""

    def __init__(self, highest=0, segment_min=_NONE, slack=0, progress=0, alpha=0.0):
        self.highest, self.segment_min = highest, segment_min
        self.slack, self.progress, self.alpha = slack, progress, alpha

    def feed(self, ts: np.ndarray) -> dict[str, np.ndarray]:
        """Fold rows in arrival order; per row the advance flag, slack, punctuation and progress after it."""
        n = len(ts)
        high = np.maximum(np.maximum.accumulate(ts), self.highest)
        advance = ts > np.r_[self.highest, high[:-1]]
        at = np.flatnonzero(advance)
        count = np.cumsum(advance)
        if len(at):
            lows = np.minimum.reduceat(ts[:at[-1] + 1], np.r_[0, at[:-1] + 1])
            lows[0] = min(lows[0], self.segment_min)
            slack = np.maximum(np.maximum.accumulate(np.maximum(high[at] - lows, 0)), self.slack)
            hold = slack if self.alpha == 0 else (1 - self.alpha) * slack
            punct = high[at] - hold
            progress = np.maximum(np.maximum.accumulate(punct), self.progress)
        else:
            slack = punct = progress = np.zeros(0, dtype=np.int64)
        out = {
            "advance": advance,
            "at": at,
            "punct": punct,
            "slack": np.r_[self.slack, slack][count],
            "progress": np.r_[self.progress, progress][count],
            "prior": np.r_[self.progress, progress][count - advance],
        }
        tail = ts[at[-1] + 1:] if len(at) else ts
        if len(at):
            self.segment_min = _NONE
            self.slack, self.progress = slack[-1], progress[-1]
        if len(tail):
            self.segment_min = min(self.segment_min, tail.min())
        if n:
            self.highest = high[-1]
        return out


def with_times(df: DataFrame, *times: str) -> DataFrame:
    """The rows that have every one of the times; without them a row has no place in event time or arrival."""
    return df.where(reduce(and_, [F.col(t).isNotNull() for t in times]))


def without_times(df: DataFrame, *times: str) -> DataFrame:
    """The rows that the operators set aside."""
    return df.where(reduce(or_, [F.col(t).isNull() for t in times]))


def _one(batch: pa.RecordBatch, name: str):
    return batch.column(name)[0].as_py()


def _longs(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _carried_highest(rows: DataFrame, highest: int = 0) -> tuple[dict[int, int], int]:
    """Highest event time before each partition, and after all."""
    carried = {}
    for part, top in sorted(tuple(r) for r in rows.groupBy(PART).agg(F.max("__ts")).collect()):
        carried[part] = highest
        highest = max(highest, top)
    return carried, highest


def _carried_slack(rows: DataFrame, highest: dict[int, int], segment: int = _NONE, slack: int = 0):
    """Per partition the open segment minimum and the slack at its start; then both after the last one."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, top, head_min, first, delay, tail = None, 0, _NONE, None, 0, _NONE
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = _one(batch, PART)
                top = highest[part]
            ts = _longs(batch, "__ts")
            high = np.maximum(np.maximum.accumulate(ts), top)
            at = np.flatnonzero(ts > np.r_[top, high[:-1]])
            if not len(at):
                if first is None:
                    head_min = min(head_min, ts.min())
                else:
                    tail = min(tail, ts.min())
            else:
                lows = np.minimum.reduceat(ts[:at[-1] + 1], np.r_[0, at[:-1] + 1])
                delays = high[at] - lows
                if first is None:
                    head_min, first = min(head_min, lows[0]), high[at[0]]
                    delays = delays[1:]
                else:
                    delays[0] = max(delays[0], high[at[0]] - tail)
                if len(delays):
                    delay = max(delay, delays.max())
                rest = ts[at[-1] + 1:]
                tail = rest.min() if len(rest) else _NONE
            top = high[-1]
        if part is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "head": [int(head_min)], "first": [None if first is None else int(first)],
                 "delay": [int(delay)], "tail": [int(tail)]},
                schema=pa.schema([("part", pa.int32()), ("head", pa.int64()), ("first", pa.int64()),
                                  ("delay", pa.int64()), ("tail", pa.int64())]))

    found = rows.select(PART, "__ts").mapInArrow(summarise, "part int, head long, first long, delay long, tail long")
    carried = {}
    for r in sorted(found.collect(), key=lambda r: r["part"]):
        carried[r["part"]] = (segment, slack)
        if r["first"] is None:
            segment = min(segment, r["head"])
        else:
            slack = max(slack, r["first"] - min(segment, r["head"]), r["delay"])
            segment = r["tail"]
    return carried, (segment, slack)


def _carried_progress(rows: DataFrame, start, progress: int = 0) -> tuple[dict[int, int], dict[int, int], int]:
    """Progress at the start of every partition, highest punctuation inside it, and the final progress."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fold, best = None, None, _LOWEST
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = _one(batch, PART)
                fold = start(part)
            punct = fold.feed(_longs(batch, "__ts"))["punct"]
            if len(punct):
                best = max(best, int(punct.max()))
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "best": [best]},
                                             schema=pa.schema([("part", pa.int32()), ("best", pa.int64())]))

    before, inside = {}, {}
    found = rows.select(PART, "__ts").mapInArrow(summarise, "part int, best long").collect()
    for part, best in sorted(tuple(r) for r in found):
        before[part], inside[part] = progress, best
        progress = max(progress, best)
    return before, inside, progress


class _Passes:
    """Rows in arrival order with the carried state of every range partition.

    The passes read the times alone (``times``), in the same partitions and order as the rows.
    """

    def __init__(self, df: DataFrame, ts: str, order: Sequence[str], initial: SlackFold | None = None, more: Sequence[str] = ()):
        initial = initial or SlackFold()
        self.columns = df.columns
        df = with_times(df, ts)
        self.rows = range_ordered(df.withColumn("__ts", micros(df, ts)), order)
        self.times = checkpointed(self.rows.select(PART, POS, "__ts", *more))
        highest, top = _carried_highest(self.times, int(initial.highest))
        slack, last = _carried_slack(self.times, highest, int(initial.segment_min), int(initial.slack))

        def start(part: int) -> SlackFold:
            return SlackFold(highest[part], *slack[part])

        self.before, self.inside, self.progress = _carried_progress(self.times, start, int(initial.progress))
        self.final = SlackFold(top, *last, self.progress)
        before = self.before

        def resume(part: int) -> SlackFold:
            fold = start(part)
            fold.progress = before[part]
            return fold

        self.resume = resume


def kslack(df: DataFrame, ts: str, order: Sequence[str]) -> DataFrame:
    """Add ``slack``, the ``prior_progress`` before and the ``progress`` after each row, and ``is_late``.

    A row is late when its event time is below the highest punctuation, the
    largest of (highest event time - slack) seen at any advance so far. Rows without
    an event time are set aside (``without_times``), here and in all operators below.
    """
    return kslack_with_state(df, ts, order)[0]


def kslack_with_state(
    df: DataFrame, ts: str, order: Sequence[str], initial: SlackFold | None = None,
) -> tuple[DataFrame, SlackFold]:
    """As ``kslack`` from the state after earlier rows, with the state after these."""
    passes = _Passes(df, ts, order, initial)
    resume = passes.resume
    added = ["slack", "prior_progress", "progress", "is_late"]

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = fold or resume(_one(batch, PART))
            times = _longs(batch, "__ts")
            state = fold.feed(times)
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays += [pa.array(state[c], pa.int64()) for c in ("slack", "prior", "progress")]
            arrays.append(pa.array(times < state["progress"]))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])

    schema = T.StructType([*passes.rows.schema.fields, *[T.StructField(c, T.LongType()) for c in added[:3]],
                           T.StructField("is_late", T.BooleanType())])
    return passes.rows.mapInArrow(flag, schema).select(*passes.columns, *added), passes.final


def arrival_delay(df: DataFrame, ts: str, order: Sequence[str], name: str = "delay") -> DataFrame:
    """How far each row lies behind the largest event time that arrived before or with it."""
    rows = range_ordered(with_times(df, ts).withColumn("__ts", micros(df, ts)), order)
    highest, _ = _carried_highest(rows.select(PART, "__ts"))

    def behind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            if not batch.num_rows:
                continue
            top = highest[_one(batch, PART)] if top is None else top
            ts = _longs(batch, "__ts")
            high = np.maximum(np.maximum.accumulate(ts), top)
            top = high[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(high - ts)], names=[*batch.schema.names, name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    return rows.mapInArrow(behind, schema).select(*df.columns, name)


def kslack_progress(df: DataFrame, ts: str, order: Sequence[str]) -> int:
    """Progress after the last row: the event time up to which the input is taken as complete."""
    return _Passes(df, ts, order).progress


def kept_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("is_late"))


def in_order_rows(df: DataFrame, ts: str, gen: str, order: Sequence[str], pending_rows: int = 500_000) -> tuple[DataFrame, int | None]:
    """The rows that leave the reorder buffer in order, stored, and the event time of the last one.

    Each emission closes what lies before it: after the last, input is complete up to that time, and with it the
    windows over these rows. None if no row leaves.
    """
    seen = Observation()
    emitted = reorder(df, ts, gen, order, pending_rows)
    kept = kept_rows(emitted).select(*df.columns)
    rows = checkpointed(kept.observe(seen, F.max(micros(df, ts)).alias("last")))
    return rows, seen.get["last"]


def dropped_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_late")


def _first_at_least(values: np.ndarray, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Smallest index >= start with values[index] >= wanted, or len(values); a search in a tree of maxima."""
    n = len(values)
    found = np.full(len(start), n, dtype=np.int64)
    if not n:
        return found
    size = 1 << max(0, n - 1).bit_length()
    tree = np.full(2 * size, _LOWEST, dtype=np.int64)
    tree[size:size + n] = values
    half = size
    while half > 1:
        tree[half // 2:half] = np.maximum(tree[half:2 * half:2], tree[half + 1:2 * half:2])
        half //= 2
    live = np.flatnonzero(start < n)
    node = start[live].astype(np.int64) + size
    while len(live):
        node //= node & -node  # widest block that begins here
        good = tree[node] >= wanted[live]
        down, sought = node[good], wanted[live[good]]
        while len(down) and down.min() < size:
            inner = down < size
            left = down[inner] * 2
            down[inner] = left + (tree[left] < sought[inner])
        found[live[good]] = down - size
        live, node = live[~good], node[~good] + 1
        more = (node & -node) != node
        live, node = live[more], node[more]
    return found


def reorder(df: DataFrame, ts: str, gen: str, order: Sequence[str], pending_rows: int = 500_000) -> DataFrame:
    """Emission of the reorder buffer over a whole input.

    Adds ``release_gen``, the arrival time at which the row leaves the buffer,
    and ``is_late``, true when an earlier emission already passed its event
    time. Rows still buffered at the end leave then. The rows that are not late
    leave in the order of (event time, arrival).
    """
    df = with_times(df, ts, gen)
    passes = _Passes(df.withColumn("__gen", micros(df, gen)), ts, order, more=["__gen"])
    resume, inside = passes.resume, passes.inside
    parts = np.array(sorted(inside), dtype=np.int64)
    tops = np.array([inside[p] for p in parts], dtype=np.int64)
    names = passes.times.columns

    def release(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, part, waiting = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = _one(batch, PART) if part is None else part
            fold = fold or resume(part)
            times, gens, seqs = (_longs(batch, c) for c in ("__ts", "__gen", POS))
            state = fold.feed(times)
            at, punct = state["at"], state["punct"].astype(np.int64)
            # rows of this batch wait for a punctuation at or after them, earlier ones for any of this batch
            table = pa.Table.from_batches([batch])
            first = np.searchsorted(at, np.arange(len(times)))
            if waiting is not None:
                first = np.r_[np.zeros(waiting.num_rows, dtype=np.int64), first]
                table = pa.concat_tables([waiting, table])
            hit = _first_at_least(punct, first, _longs(table.combine_chunks(), "__ts"))
            here = hit < len(punct)
            row = at[hit[here]]
            yield from placed(table.filter(pa.array(here)), gens[row], seqs[row], None)
            waiting = table.filter(pa.array(~here))
        if waiting is not None and waiting.num_rows:
            # what still waits leaves in a later partition, or at the end
            later = _first_at_least(tops, np.full(waiting.num_rows, np.searchsorted(parts, part) + 1), _longs(waiting.combine_chunks(), "__ts"))
            target = np.where(later < len(parts), parts[np.minimum(later, len(parts) - 1)], -1)
            yield from placed(waiting, None, None, target)

    def placed(table: pa.Table, gens, seqs, target) -> list[pa.RecordBatch]:
        none = lambda kind: pa.nulls(table.num_rows, kind)
        out = table.append_column("__release", none(pa.int64()) if seqs is None else pa.array(seqs, pa.int64()))
        out = out.append_column("release_gen", none(pa.int64()) if gens is None else pa.array(gens, pa.int64()))
        out = out.append_column("__target", none(pa.int32()) if target is None else pa.array(target.astype(np.int32)))
        return out.combine_chunks().to_batches()

    schema = T.StructType([*passes.times.schema.fields, T.StructField("__release", T.LongType()),
                           T.StructField("release_gen", T.LongType()), T.StructField("__target", T.IntegerType())])
    first = checkpointed(passes.times.mapInArrow(release, schema))
    ladder = _ladder(passes.times, resume)
    end = passes.times.agg(F.max("__gen").alias("gen")).first()["gen"]
    waiting = first.filter(F.col("__target") >= 0)
    crossed = _released_later(waiting, ladder, names, pending_rows)
    flushed = first.filter(F.col("__target") == -1).select(
        *names, F.lit(None).cast("long").alias("__release"), F.lit(end).cast("long").alias("release_gen"))
    done = (
        first.filter(F.col("__target").isNull()).select(*names, "__release", "release_gen")
        .unionByName(crossed).unionByName(flushed)
    )
    # only times and positions went through the passes; their results meet the rows once
    left = _flag_overtaken(checkpointed(done))
    return passes.rows.select(POS, *df.columns).join(left, POS).select(*df.columns, "release_gen", "emit_pos", "is_late")


def _ladder(rows: DataFrame, resume) -> DataFrame:
    """Per partition the advances whose punctuation exceeds all earlier ones of that partition."""

    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, best = None, _LOWEST
        for batch in batches:
            if not batch.num_rows:
                continue
            part = _one(batch, PART)
            fold = fold or resume(part)
            state = fold.feed(_longs(batch, "__ts"))
            punct = state["punct"].astype(np.int64)
            if not len(punct):
                continue
            before = np.maximum(np.r_[best, np.maximum.accumulate(punct)[:-1]], best)
            record = punct > before
            best = max(best, int(punct.max()))
            row = state["at"][record]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(punct[record]),
                 pa.array(_longs(batch, POS)[row]), pa.array(_longs(batch, "__gen")[row])],
                names=["__target", "__ts", "__seq", "__at"])

    return rows.select(PART, POS, "__ts", "__gen").mapInArrow(climb, "__target int, __ts long, __seq long, __at long")


def _released_later(waiting: DataFrame, ladder: DataFrame, names: list[str], pending_rows: int) -> DataFrame:
    """Rows that leave in a later partition: the first step of its ladder at or above their event time.

    Both go through one window per (partition, share); a partition many rows
    wait for is shared out, each share with its own copy of the ladder.
    """
    shares = waiting.groupBy("__target").agg(F.ceil(F.count("*") / pending_rows).cast("int").alias("__shares"))
    asked = waiting.drop("__release", "release_gen").join(F.broadcast(shares), "__target").withColumn(
        "__share", F.pmod(F.xxhash64(POS), F.col("__shares")).cast("int")).drop("__shares")
    steps = ladder.join(F.broadcast(shares), "__target").withColumn(
        "__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    both = asked.withColumn("__step", F.lit(0)).unionByName(
        steps.withColumn("__step", F.lit(1)), allowMissingColumns=True)
    upward = Window.partitionBy("__target", "__share").orderBy(F.desc("__ts"), F.desc("__step")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    looked = both.withColumns({
        "__release": F.last("__seq", ignorenulls=True).over(upward),
        "release_gen": F.last("__at", ignorenulls=True).over(upward),
    })
    return looked.filter(F.col("__step") == 0).select(*names, "__release", "release_gen")


def _flag_overtaken(done: DataFrame) -> DataFrame:
    """(POS, release_gen, emit_pos, is_late): late in emission order is what lies below the running maximum of the
    event times emitted before."""
    last = F.coalesce("__release", F.lit(_NONE))
    placed = range_ordered(
        done.select(F.col(POS).alias("__arrival"), last.alias("__leave"), "__ts", "release_gen"), ["__leave", "__ts", "__arrival"])
    highest, _ = _carried_highest(placed)

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            if not batch.num_rows:
                continue
            top = highest[_one(batch, PART)] if top is None else top
            ts = _longs(batch, "__ts")
            high = np.maximum(np.maximum.accumulate(ts), top)
            top = high[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__arrival"), batch.column("release_gen"), batch.column(POS), pa.array(ts < high)],
                names=[POS, "release_gen", "emit_pos", "is_late"])

    return placed.mapInArrow(flag, f"{POS} long, release_gen long, emit_pos long, is_late boolean")


class AlphaControl:
    """Share of the slack given up so that the ratio of late rows meets a target; one step per sample."""

    def __init__(self, target: float, gains=GAINS, period: int = SAMPLE_MICROS):
        self.target, self.gains, self.period = target, gains, period
        self.alpha, self.integral, self.last = 0.0, 0.0, None
        self.received = self.dropped = 0
        self.sampled = None

    def state(self) -> list:
        return [self.alpha, self.integral, self.last, self.received, self.dropped, self.sampled]

    def restore(self, state: Sequence) -> None:
        self.alpha, self.integral, self.last, self.received, self.dropped, self.sampled = state

    def due(self, gen: int) -> bool:
        """Called per row or at the first row of a slice; starts the clock at the first arrival."""
        if self.sampled is None:
            self.sampled = gen
        return gen - self.sampled >= self.period

    def step(self, gen: int) -> None:
        """The row that triggers the sample is already counted as received, but not yet as dropped."""
        self.sampled = gen
        coverage = 1 - self.dropped / self.received
        if self.last is None:
            self.last = coverage
        kp, ki, kd = self.gains
        error = coverage - (1 - self.target)
        self.integral = min(1.0, max(-1.0, self.integral + ki * error))
        output = kp * error + self.integral + kd * (coverage - self.last)
        self.last = coverage
        self.alpha = min(1.0, max(0.0, self.alpha + min(1.0, max(-1.0, output))))
        self.received = self.dropped = 0


class AdaptiveSlack:
    """Adaptive progress of one source; sampling follows arrival time, so replays agree."""

    def __init__(self, target: float, gains=GAINS, period: int = SAMPLE_MICROS):
        self.control = AlphaControl(target, gains, period)
        self.fold = SlackFold()

    def feed(self, ts: np.ndarray, gen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Late flag and alpha per row. Alpha is constant between samples, so slices are vectorised."""
        late = np.zeros(len(ts), dtype=bool)
        alpha = np.zeros(len(ts))
        control, i = self.control, 0
        while i < len(ts):
            counted = 0
            if control.due(int(gen[i])):
                control.received += 1
                control.step(int(gen[i]))
                counted = 1
            j = max(i + 1, int(np.searchsorted(gen, control.sampled + control.period, side="left")))
            self.fold.alpha = control.alpha
            part = ts[i:j]
            late[i:j] = part < self.fold.feed(part)["progress"]
            alpha[i:j] = control.alpha
            control.received += len(part) - counted
            control.dropped += int(late[i:j].sum())
            i = j
        return late, alpha


class AdaptiveBuffer:
    """Reorder buffer of one source with an adaptive slack, worked in slices between samples, in which alpha is constant.

    Rows are known by ``numbers`` that grow with arrival.
    """

    def __init__(self, target: float | None, gains=GAINS, period: int = SAMPLE_MICROS):
        self.control = AlphaControl(target, gains, period) if target else None
        self.fold = SlackFold()
        self.emitted = 0
        self.waiting = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))  # event time, arrival time, number

    def state(self) -> list[int]:
        return [int(self.fold.highest), int(self.fold.segment_min), int(self.fold.slack), int(self.emitted)]

    def restore(self, state: Sequence[int]) -> None:
        self.fold.highest, self.fold.segment_min, self.fold.slack, self.emitted = state

    def hold(self, ts: np.ndarray, gen: np.ndarray, numbers: np.ndarray) -> None:
        """Rows that were in the buffer before."""
        self.waiting = tuple(np.r_[old, new] for old, new in zip(self.waiting, (ts, gen, numbers)))

    def feed(self, ts: np.ndarray, gen: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows that leave, in the order in which they do, and whether each is late."""
        control, i, left = self.control, 0, []
        ascending = len(gen) < 2 or (gen[1:] >= gen[:-1]).all()
        while i < len(ts):
            j, counted = len(ts), 0
            if control:
                if control.due(int(gen[i])):
                    control.received += 1
                    control.step(int(gen[i]))
                    counted = 1
                due = control.sampled + control.period
                j = int(np.searchsorted(gen, due)) if ascending else next(iter(np.flatnonzero(gen[i + 1:] >= due) + i + 1), len(ts))
                j = max(i + 1, j)
                self.fold.alpha = control.alpha
                control.received += j - i - counted
            state = self.fold.feed(ts[i:j])
            ready = np.floor(state["punct"]).astype(np.int64)
            first = np.r_[np.zeros(len(self.waiting[0]), dtype=np.int64), np.searchsorted(state["at"], np.arange(j - i))]
            self.hold(ts[i:j], gen[i:j], numbers[i:j])
            left.append(self._leave(_first_at_least(ready, first, self.waiting[0]), len(ready)))
            i = j
        return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*left)) or [(), ()]))

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """What is still waiting."""
        return self._leave(np.zeros(len(self.waiting[0]), dtype=np.int64), 1)

    def _leave(self, step: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows leave at their step, and of one step by event time, then arrival; those of ``steps`` stay."""
        go = np.flatnonzero(step < steps)
        ts, gen, numbers = self.waiting
        order = go[np.lexsort((numbers[go], gen[go], ts[go], step[go]))]
        out = ts[order]
        highest = np.maximum.accumulate(np.r_[self.emitted, out])
        late = out < highest[:-1]
        self.emitted = int(highest[-1])
        if self.control:
            self.control.dropped += int(late.sum())
        stay = step >= steps
        self.waiting = (ts[stay], gen[stay], numbers[stay])
        return numbers[order], late


class _SlackOfSource:
    """Adaptive slack as a fold that can pause at a partition border."""

    def __init__(self, target: float, gains, period: int, state: str | None):
        self.slack = AdaptiveSlack(target, gains, period)
        if state:
            fold, control = json.loads(state)
            f = self.slack.fold
            f.highest, f.segment_min, f.slack, f.progress = fold
            self.slack.control.restore(control)

    def feed(self, rows: pa.RecordBatch, held: bool) -> list[pa.RecordBatch]:
        late, alpha = self.slack.feed(_longs(rows, "__ts"), _longs(rows, "__gen"))
        return [pa.RecordBatch.from_arrays([*rows.columns, pa.array(alpha), pa.array(late)],
                                           names=[*rows.schema.names, "alpha", "is_late"])]

    def end(self) -> list[pa.RecordBatch]:
        return []

    def pause(self) -> tuple[str, None]:
        f = self.slack.fold
        state = [int(f.highest), int(f.segment_min), int(f.slack), float(f.progress)]
        return json.dumps([state, self.slack.control.state()]), None


class _BufferOfSource:
    """Reorder buffer as a fold that can pause; the rows it still holds go along."""

    def __init__(self, target: float | None, gains, period: int, state: str | None):
        self.buffer = AdaptiveBuffer(target, gains, period)
        self.arrival = self.seq = 0
        self.store: pa.Table | None = None
        self.numbers = np.zeros(0, dtype=np.int64)
        if state:
            saved, self.seq, control = json.loads(state)
            self.buffer.restore(saved)
            if self.buffer.control:
                self.buffer.control.restore(control)

    def feed(self, rows: pa.RecordBatch, held: bool) -> list[pa.RecordBatch]:
        ts, gen = _longs(rows, "__ts"), _longs(rows, "__gen")
        numbers = np.arange(self.arrival, self.arrival + rows.num_rows)
        self.arrival += rows.num_rows
        table = pa.Table.from_batches([rows])
        self.store = table if self.store is None else pa.concat_tables([self.store, table])
        self.numbers = np.r_[self.numbers, numbers]
        if held:  # numbered again from 0, in arrival order and before all new rows
            self.buffer.hold(ts, gen, numbers)
            return []
        return self._take(*self.buffer.feed(ts, gen, numbers))

    def _take(self, left: np.ndarray, late: np.ndarray) -> list[pa.RecordBatch]:
        """Emitted rows in emission order; the store keeps the others."""
        if not len(left):
            return []
        where = np.searchsorted(self.numbers, left)
        out = self.store.take(where)
        out = out.append_column("emit_seq", pa.array(np.arange(self.seq, self.seq + len(left))))
        out = out.append_column("is_late", pa.array(late, pa.bool_()))
        self.seq += len(left)
        stay = np.ones(len(self.numbers), dtype=bool)
        stay[where] = False
        self.store, self.numbers = self.store.filter(pa.array(stay)), self.numbers[stay]
        return out.combine_chunks().to_batches()

    def end(self) -> list[pa.RecordBatch]:
        return self._take(*self.buffer.flush())

    def pause(self) -> tuple[str, pa.Table | None]:
        b = self.buffer
        return json.dumps([b.state(), self.seq, b.control.state() if b.control else None]), self.store


def _timed(df: DataFrame, ts: str, gen: str) -> DataFrame:
    return with_times(df, ts, gen).withColumns({"__ts": micros(df, ts), "__gen": micros(df, gen)})


def adaptive_kslack(
    df: DataFrame, ts: str, gen: str, source: str, order: Sequence[str], target: float,
    gains=GAINS, period: int = SAMPLE_MICROS,
) -> DataFrame:
    """Slack scaled by (1 - alpha) per source, alpha steered to a ratio of late rows.

    Adds ``alpha`` and ``is_late``. The control loop of one source is sequential
    by definition; a source larger than a partition is relayed from one to the next.
    """
    added = [T.StructField("alpha", T.DoubleType()), T.StructField("is_late", T.BooleanType())]
    out = relay(_timed(df, ts, gen), source, order, lambda state: _SlackOfSource(target, gains, period, state), added)
    return out.drop("__ts", "__gen")


def adaptive_reorder(
    df: DataFrame, ts: str, gen: str, source: str, order: Sequence[str], target: float | None,
    gains=GAINS, period: int = SAMPLE_MICROS,
) -> DataFrame:
    """In-order emission per source with an adaptive (or, without target, fixed) slack.

    Rows come out with their ``emit_seq`` within the source and ``is_late``.
    Only buffered rows are held.
    """
    added = [T.StructField("emit_seq", T.LongType()), T.StructField("is_late", T.BooleanType())]
    out = relay(_timed(df, ts, gen), source, order, lambda state: _BufferOfSource(target, gains, period, state), added)
    return out.drop("__ts", "__gen")


def late_ratio(flagged: DataFrame) -> DataFrame:
    """Rows received and dropped, and the ratio of the two."""
    return flagged.agg(
        F.count("*").alias("received"),
        F.count_if("is_late").alias("dropped"),
        (F.count_if("is_late") / F.count("*")).alias("drop_ratio"),
    )


def watermark_baseline(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Fixed-delay progress: Spark's own watermark."""
    return df.withWatermark(ts, delay)
