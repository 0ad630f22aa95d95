"""Pane-based sliding windows and the windowed preference queries built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.functions.dominance import Dim
from skyquill.operators.ordering import arrival_rank
from skyquill.operators.preference import (
    BLOCK_ROWS,
    DominanceFactor,
    PreferenceAggregate,
    Skyline,
    evaluate,
    evaluate_bounded,
    top_delta,
)
from skyquill.runtime import BROADCAST_ROWS, checkpointed_with_count


@dataclass(frozen=True)
class Windows:
    """Time windows of ``length`` every ``slide`` microseconds from ``origin``.

    Window w covers the panes ``w * per_slide .. w * per_slide + per_window - 1``;
    a pane is the greatest common divisor of length and slide, so every window
    is a whole number of panes and a pane result serves all windows around it.
    """

    length: int
    slide: int
    origin: int = 0

    def __post_init__(self):
        if self.length < self.slide:
            raise ValueError(f"window length {self.length} is shorter than its slide {self.slide}")
        if self.slide <= 0:
            raise ValueError("the slide must be positive")

    @property
    def pane(self) -> int:
        return gcd(self.length, self.slide)

    @property
    def per_window(self) -> int:
        return self.length // self.pane

    @property
    def per_slide(self) -> int:
        return self.slide // self.pane

    def pane_of(self, micros: Column) -> Column:
        shifted = micros - F.lit(self.origin)
        return ((shifted - F.pmod(shifted, F.lit(self.pane))) / F.lit(self.pane)).cast("long")

    def first_window(self, pane: Column) -> Column:
        behind = pane - F.lit(self.per_window)
        steps = F.floor((behind - F.pmod(behind, F.lit(self.per_slide))) / self.per_slide).cast("long") + 1
        return F.when(behind < 0, F.lit(0).cast("long")).otherwise(steps)

    def last_window(self, pane: Column) -> Column:
        return ((pane - F.pmod(pane, F.lit(self.per_slide))) / self.per_slide).cast("long")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP column; a number is taken as microseconds already."""
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def with_pane(df: DataFrame, ts: str, windows: Windows, name: str = "pane_id") -> DataFrame:
    """Add the pane number; rows before the origin belong to no window and go (``before_origin`` has them)."""
    return df.withColumn(name, windows.pane_of(micros(df, ts))).filter(F.col(name) >= 0)


def before_origin(df: DataFrame, ts: str, windows: Windows) -> DataFrame:
    """The rows that ``with_pane`` leaves out: before the origin or without a time."""
    return df.filter(~F.coalesce(windows.pane_of(micros(df, ts)) >= 0, F.lit(False)))


def to_windows(panes: DataFrame, windows: Windows, pane: str = "pane_id", name: str = "window_id") -> DataFrame:
    """One copy of each pane row per window that contains the pane."""
    p = F.col(pane)
    return panes.withColumn(name, F.explode(F.sequence(windows.first_window(p), windows.last_window(p))))


def windows_per_pane(panes: DataFrame, windows: Windows, pane: str = "pane_id") -> DataFrame:
    p = F.col(pane)
    return panes.withColumn("n_windows", windows.last_window(p) - windows.first_window(p) + 1)


def complete_windows(rows: DataFrame, ts: str, windows: Windows, progress: int | None = None) -> DataFrame:
    """Ids of the windows all of whose panes arrive.

    A pane arrives when it has a row, or is empty and lies wholly before
    ``progress``, the event time the input is known to be complete up to (the
    largest event time when the input is in order).
    """
    sure, tail = _sure_and_late(rows, ts, windows, progress)
    return rows.sparkSession.range(sure).select(F.col("id").alias("window_id")).unionByName(tail)


def _sure_and_late(rows: DataFrame, ts: str, windows: Windows, progress: int | None) -> tuple[int, DataFrame]:
    """The number of windows before the progress, all of them complete, and the complete ones that reach past it."""
    if progress is None:
        progress = rows.agg(F.max(micros(rows, ts))).first()[0]
        if progress is None:
            return 0, rows.sparkSession.range(0).select(F.col("id").alias("window_id"))
    closed = max(0, (progress - windows.origin) // windows.pane)
    sure = max(0, (closed - windows.per_window) // windows.per_slide + 1) if closed >= windows.per_window else 0
    # windows that reach past the progress need a row in each of their later panes
    late = with_pane(rows.select(ts), ts, windows).filter(F.col("pane_id") >= closed).select("pane_id").distinct()
    w = F.col("window_id")
    first_late = F.greatest(w * windows.per_slide, F.lit(closed))
    needed = w * windows.per_slide + windows.per_window - first_late
    tail = (
        to_windows(late, windows).filter(w >= sure).groupBy("window_id").agg(F.count("*").alias("__have"))
        .filter(F.col("__have") == needed).select("window_id")
    )
    return sure, tail


def pane_query(
    df: DataFrame, dims: Sequence[Dim | str], ts: str, windows: Windows, keys: Sequence[str] = (),
    aggregate: PreferenceAggregate | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Result of every pane, without windows."""
    return evaluate(with_pane(df, ts, windows), dims, [*keys, "pane_id"], aggregate, block_rows=block_rows)


def _window_rows(df, dims, ts, windows, keys, progress, block_rows) -> tuple[DataFrame, int]:
    """Rows of the pane skylines, copied to their complete windows, and a bound on their number."""
    sure, late = _sure_and_late(df, ts, windows, progress)
    panes, bound = evaluate_bounded(
        with_pane(df, ts, windows), dims, [*keys, "pane_id"], Skyline(), block_rows)
    copies = -(-windows.per_window // windows.per_slide)
    if bound * copies > block_rows:  # read twice below unless the pane results prove few
        panes, bound = checkpointed_with_count(panes)
    bound *= copies
    rows = to_windows(panes, windows).drop("pane_id")
    # the windows before the progress need no list, so the copies are not shuffled to meet it
    late, n_late = checkpointed_with_count(late.withColumn("__late", F.lit(True)))
    rows = rows.join(F.broadcast(late) if n_late <= BROADCAST_ROWS else late, "window_id", "left")
    return rows.filter((F.col("window_id") < sure) | F.col("__late")).drop("__late"), bound


def window_skyline(
    df: DataFrame, dims: Sequence[Dim | str], ts: str, windows: Windows, keys: Sequence[str] = (),
    progress: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Skyline of every complete window: pane skylines, copied to their windows and merged there."""
    rows, bound = _window_rows(df, dims, ts, windows, keys, progress, block_rows)
    return evaluate(rows, dims, [*keys, "window_id"], Skyline(), block_rows=block_rows, compact_rows=bound)


def window_factors(
    df: DataFrame, dims: Sequence[Dim | str], ts: str, windows: Windows, keys: Sequence[str] = (),
    progress: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidates of every complete window with their dominance factor."""
    rows, bound = _window_rows(df, dims, ts, windows, keys, progress, block_rows)
    return evaluate(rows, dims, [*keys, "window_id"], DominanceFactor(), block_rows=block_rows, compact_rows=bound)


def window_top_delta(
    df: DataFrame, dims: Sequence[Dim | str], ts: str, windows: Windows, delta: int = 100,
    keys: Sequence[str] = (), ties: Sequence[str] = (), progress: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``delta`` rows of smallest factor in every complete window."""
    rows, bound = _window_rows(df, dims, ts, windows, keys, progress, block_rows)
    return top_delta(rows, dims, delta, [*keys, "window_id"], ties, block_rows=block_rows, compact_rows=bound)


def window_sizes(
    result: DataFrame, complete: DataFrame, name: str = "n_points", key: str = "window_id",
) -> DataFrame:
    """Result size of every complete window (or pane); windows of empty panes count 0."""
    sizes = result.groupBy(key).agg(F.count("*").alias(name))
    return complete.join(sizes, key, "left").select(key, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def window_positions(result: DataFrame, ties: Sequence[str], name: str = "position") -> DataFrame:
    """0-based place of every row in the order of windows and ``ties``, without a one-task sort."""
    return arrival_rank(result, ["window_id", *ties], name)


def in_window_order(result: DataFrame, *ties: str) -> DataFrame:
    return result.orderBy("window_id", *ties)


def split_plan(rows: DataFrame, how: str = "adaptive", parts: int = 8, alpha: float = 1.0) -> DataFrame:
    """Rows and number of parts of every pane (``pane_id``) when panes are split over workers.

    ``none`` keeps a pane whole, ``round_robin`` deals every pane into ``parts``,
    ``adaptive`` deals only panes larger than (mean + one standard deviation) / ``alpha``
    of the pane sizes, into as many parts as bring each below that size.
    """
    sizes = rows.groupBy("pane_id").agg(F.count("*").alias("n_rows"))
    if how == "none":
        return sizes.withColumn("n_parts", F.lit(1))
    if how == "round_robin":
        return sizes.withColumn("n_parts", F.lit(parts))
    if how != "adaptive":
        raise ValueError(f"unknown split {how!r}")
    limit = sizes.agg(((F.avg("n_rows") + F.stddev_pop("n_rows")) / F.lit(alpha)).alias("limit")).first()["limit"]
    if limit is None:
        return sizes.withColumn("n_parts", F.lit(1))
    return sizes.withColumn("n_parts", F.ceil(F.col("n_rows") / F.lit(limit)).cast("int"))


def pane_split(df: DataFrame, ts: str, windows: Windows, how: str = "adaptive", parts: int = 8,
               alpha: float = 1.0) -> DataFrame:
    """Rows with their pane and the part of the pane they go to."""
    rows = with_pane(df, ts, windows)
    deal = F.xxhash64(*[F.col(c) for c in df.columns])
    if how != "adaptive":
        n = F.lit(1 if how == "none" else parts)
        return rows.withColumn("part_id", F.pmod(deal, n).cast("int"))
    # only panes that are split are listed, and their number shrinks as they grow
    split = split_plan(rows, how, alpha=alpha).filter("n_parts > 1").select("pane_id", "n_parts")
    return (
        rows.join(split, "pane_id", "left")
        .withColumn("part_id", F.pmod(deal, F.coalesce("n_parts", F.lit(1))).cast("int"))
        .drop("n_parts")
    )


def parts_per_pane(split: DataFrame) -> DataFrame:
    """Mean number of parts per pane."""
    parts = split.groupBy("pane_id").agg(F.count_distinct("part_id").alias("__parts"))
    return parts.agg(F.avg("__parts").alias("avg_parts"))
