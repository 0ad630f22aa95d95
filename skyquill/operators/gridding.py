"""Hierarchical grid that turns "boxes that meet" into an equality join.

A box lives at the level whose size is at least that of the box on every axis. A level has cells of that size, or
of a half or a quarter of it where rows are dense, so a box covers at most two, three or five cells per axis however
large it is. At every coarser
level that the other side uses it is looked up by the cells it covers there.
Each pair is thus matched at the coarser of its two levels, and kept only in
the cell that holds the low corner of the intersection, which makes it unique
without a distinct.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, isfinite, log

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyquill.runtime import BROADCAST_ROWS, checkpointed, spread

_BASE = 4.0
_DEPTH = 12
_BOTTOM = -200

#: Rows of one cell above which the cell is shared out over several keys.
HOT_CELL_ROWS = 200_000
HOT_SAMPLE_ROWS = 5_000_000
#: Pairs of one cell that one key compares, about; and keys that any row of a cell is copied to for the bound on rows alone.
SHARE_PAIRS = 2_000_000
_ROW_SHARES = 4
#: Pairs of one partition of a join, about, up to a number of partitions.
TASK_PAIRS = 8_000_000
_MOST_PARTS = 5_000
#: Rows of the smaller side a cell above which its level is cut finer.
_DENSE = 64


def _axis_level(low: Column, high: Column) -> Column:
    """Smallest power of the base that is at least the side; null for a side of 0."""
    side = high - low
    return F.ceil(F.log(_BASE, F.when(side > 0, side)))


class Grid:
    """Levels in use on both sides, from one narrow aggregate over both.

    Axes are scaled by their typical side (``units``, exponents of the base), so
    a price axis and a day axis are both cut finely.
    """

    def __init__(self, left: DataFrame, right: DataFrame, axes: int, extra: Sequence[str] = ()):
        self.axes = axes
        span = range(axes)
        sides = []
        for side, name in ((left, "l"), (right, "r")):
            corners = [(F.col(f"__{name}lo{i}"), F.col(f"__{name}hi{i}")) for i in span]
            sides.append(side.select(
                F.xxhash64(*extra).alias("kept_apart") if extra else F.lit(0).alias("kept_apart"), F.lit(name).alias("side"), *[_axis_level(lo, hi).alias(f"level{i}") for i, (lo, hi) in enumerate(corners)],
                *[F.greatest(F.abs(lo), F.abs(hi)).alias(f"reach{i}") for i, (lo, hi) in enumerate(corners)],
                *[c.alias(f"{k}{i}") for i, corner in enumerate(corners) for k, c in zip(("low", "high"), corner)]))
        # one row per combination of levels in use, a few dozen
        found = sides[0].unionByName(sides[1]).groupBy("side", *[f"level{i}" for i in span]).agg(
            *[F.max(f"reach{i}").alias(f"reach{i}") for i in span], *[F.min(f"low{i}").alias(f"low{i}") for i in span],
            *[F.max(f"high{i}").alias(f"high{i}") for i in span], F.approx_count_distinct("kept_apart").alias("apart"), F.count("*").alias("n")).collect()
        reach = [max([r[f"reach{i}"] for r in found], default=0.0) for i in span]
        for i, far in enumerate(reach):
            if not isfinite(far):
                raise ValueError(f"boxes must have finite coordinates; axis {i} holds {far}")
        reach_level = [ceil(log(v, _BASE)) if v > 0 else 0 for v in reach]
        self.units = []
        for i in span:
            means = []
            for name in ("l", "r"):
                sized = [(r[f"level{i}"], r["n"]) for r in found if r["side"] == name and r[f"level{i}"] is not None]
                if sized:
                    means.append(sum(v * n for v, n in sized) / sum(n for _, n in sized))
            self.units.append(round(max(means)) if means else reach_level[i] - 8)

        def level_of(r) -> int:
            return max([r[f"level{i}"] - self.units[i] for i in span if r[f"level{i}"] is not None], default=_BOTTOM)

        top = max([level_of(r) for r in found if level_of(r) > _BOTTOM], default=0)
        # cell numbers must stay exact integers in a double
        exact = max(v - 24 - u for v, u in zip(reach_level, self.units))
        # typical rows live about level 0; the finer its cells the fewer pairs are compared in vain, and the more keys a row has
        filled = min(sum(r["n"] for r in found if r["side"] == name) for name in ("l", "r")) / max([r["apart"] for r in found], default=1)
        for i in span:
            extent = max([r[f"high{i}"] for r in found], default=0.0) - min([r[f"low{i}"] for r in found], default=0.0)
            filled /= 1 + extent / _BASE ** self.units[i]
        self.parts = 1 if filled < _DENSE else 2 if filled < 4 * _DENSE or axes > 2 else 4
        self.floor = max(top - _DEPTH, exact)
        self.left_levels, self.right_levels = (
            {max(level_of(r), self.floor) for r in found if r["side"] == name} for name in ("l", "r"))
        #: a row has a key at most once, so no key has more rows of a side than this
        self.left_rows, self.right_rows = (sum(r["n"] for r in found if r["side"] == name) for name in ("l", "r"))

    def _level(self, lows: Sequence[Column], highs: Sequence[Column]) -> Column:
        scaled = [_axis_level(lo, hi) - u for lo, hi, u in zip(lows, highs, self.units)]
        return F.greatest(F.lit(self.floor), *scaled).cast("int")  # nulls, sides of 0, are ignored

    def _cell(self, coord: Column, level: Column, axis: int) -> Column:
        return F.floor(coord / (F.pow(F.lit(_BASE), (level + self.units[axis]).cast("double")) / self.parts)).cast("long")

    def keys(self, df: DataFrame, name: str) -> DataFrame:
        """One row per (role, level, cell), with flags that tell whether the cell is the row's first on each axis. Role 0
        pairs a left row with right rows of its own or a coarser level, role 1 with right rows of a finer level."""
        lows = [F.col(f"__{name}lo{i}") for i in range(self.axes)]
        highs = [F.col(f"__{name}hi{i}") for i in range(self.axes)]
        own = self._level(lows, highs)
        others = self.right_levels if name == "l" else self.left_levels
        ladder = F.array(*[F.lit(v) for v in sorted(others)]) if others else F.array().cast("array<int>")
        if name == "l":
            climbing = F.transform(F.filter(ladder, lambda v: v >= own), lambda v: F.struct(
                F.lit(0).alias("role"), v.alias("level")))
            at_home = F.array(F.struct(F.lit(1).alias("role"), own.alias("level")))
        else:
            climbing = F.transform(F.filter(ladder, lambda v: v > own), lambda v: F.struct(
                F.lit(1).alias("role"), v.alias("level")))
            at_home = F.array(F.struct(F.lit(0).alias("role"), own.alias("level")))
        out = df.withColumn("__at", F.explode(F.concat(at_home, climbing)))
        level = F.col("__at.level")
        out = out.withColumns({"__role": F.col("__at.role"), "__level": level}).drop("__at")
        for i in range(self.axes):
            first = self._cell(lows[i], F.col("__level"), i)
            span = F.sequence(first, self._cell(highs[i], F.col("__level"), i))
            out = out.select("*", F.posexplode(span).alias(f"__{name}f{i}", f"__c{i}"))
            out = out.withColumn(f"__{name}f{i}", F.col(f"__{name}f{i}") == 0)
        return out

    def in_reference_cell(self) -> Column:
        """The cell holds the low corner of the intersection: on every axis it is the first of one of the two boxes."""
        return reduce(lambda a, b: a & b, (F.col(f"__lf{i}") | F.col(f"__rf{i}") for i in range(self.axes)))


def cell_rows(side: DataFrame, keys: list[str], name: str, scale: float) -> DataFrame:
    """(keys, name): about how many rows of this side each key has."""
    return side.groupBy(*keys).agg((F.count("*") / F.lit(scale)).alias(name))


def shared_cells(met: DataFrame, keys: list[str], hot_rows: int, most_pairs: int) -> DataFrame:
    """(keys, __lshares, __rshares): cells that too many rows share, and into how many parts each side is dealt there.

    The pairs of a cell are what a task works off, so parts are as many as its pairs need, split so that few rows are
    copied. A cell that only has more than ``hot_rows`` rows of a side is cut into a few parts on that side.
    """
    cells = met.filter((F.col("__l") > hot_rows) | (F.col("__r") > hot_rows) | (F.col("__l") * F.col("__r") > most_pairs))
    needed = F.ceil(F.col("__l") * F.col("__r") / most_pairs).cast("double")
    on_left = F.least(F.greatest(F.lit(1.0), F.round(F.sqrt(needed * F.col("__l") / F.col("__r")))), needed)
    few = lambda c: F.least(F.ceil(F.col(c) / hot_rows), F.lit(_ROW_SHARES))
    return cells.select(*keys, F.greatest(on_left, few("__l")).cast("int").alias("__lshares"),
                        F.greatest(F.ceil(needed / on_left), few("__r")).cast("int").alias("__rshares"))


def share_out(left: DataFrame, right: DataFrame, cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Deal the rows of both sides over the parts of shared cells and copy them to the other side's parts there.

    ``cells`` are broadcast only below the row bound and joined by shuffle above it.
    """
    found = cells.limit(BROADCAST_ROWS + 1).collect()
    if not found:
        return left, right, keys
    if len(found) <= BROADCAST_ROWS:
        cells = F.broadcast(left.sparkSession.createDataFrame(found, cells.schema))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        # by the row itself: a task that runs again on a lost executor deals as the first one did
        whole = [F.col(f.name) for f in side.schema if "map<" not in f.dataType.simpleString()]
        part = F.pmod(F.xxhash64(*whole), F.coalesce(f"__{own}shares", F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"__{other}shares", F.lit(1)) - 1))
        out = side.join(cells, keys, "left").withColumn(f"__{own}share", part).withColumn(f"__{other}share", copies)
        return out.drop("__lshares", "__rshares")

    return dealt(left, "l", "r"), dealt(right, "r", "l"), [*keys, "__lshare", "__rshare"]


def spread_pairs(left: DataFrame, right: DataFrame, left_rows: DataFrame, right_rows: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys``, full cells shared out, in as many partitions as their pairs need.

    ``left_rows`` and ``right_rows`` tell how many rows a key has, about. Few rows may have very many pairs, so
    the size of the rows does not tell how many tasks the join needs.
    """
    seen = Observation()
    met = left_rows.join(right_rows, keys).observe(seen, F.sum(F.col("__l") * F.col("__r")).alias("pairs"))
    cells = checkpointed(shared_cells(met, keys, hot_rows, SHARE_PAIRS))
    left, right, keys = share_out(left, right, cells, keys)
    parts = min(_MOST_PARTS, ceil((seen.get["pairs"] or 0) / TASK_PAIRS))
    if parts > 1:
        parts = max(parts, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left, right, keys


def equal_pairs(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Inner join on ``keys``, which many rows of both sides may share."""
    left, right, shared = spread_pairs(left, right, cell_rows(left, keys, "__l", 1.0), cell_rows(right, keys, "__r", 1.0), keys, hot_rows)
    return left.hint("merge").join(right, shared).drop("__lshare", "__rshare")


def meeting_pairs(
    left: DataFrame, right: DataFrame, left_box, right_box, extra: Sequence[str] = (), hot_rows: int = HOT_CELL_ROWS,
    axes: int | None = None,
) -> DataFrame:
    """Pairs of rows whose closed boxes meet on the first ``axes`` axes (two at most by default).

    ``extra`` are equality columns both sides have. Column names must not clash.
    """
    axes = min(axes or 2, left_box.n)
    left = left.withColumns({f"__llo{i}": left_box.low[i] for i in range(axes)}
                            | {f"__lhi{i}": left_box.high[i] for i in range(axes)})
    right = right.withColumns({f"__rlo{i}": right_box.low[i] for i in range(axes)}
                              | {f"__rhi{i}": right_box.high[i] for i in range(axes)})
    # an empty or unordered box meets nothing
    for i in range(axes):
        left = left.filter(F.col(f"__llo{i}") <= F.col(f"__lhi{i}"))
        right = right.filter(F.col(f"__rlo{i}") <= F.col(f"__rhi{i}"))
    left, right = spread(left), spread(right)
    grid = Grid(left, right, axes, extra)
    keys = [*extra, "__role", "__level", *[f"__c{i}" for i in range(axes)]]
    l, r = grid.keys(left, "l"), grid.keys(right, "r")

    def counted(side: DataFrame, name: str, rows: int) -> DataFrame:
        # which cells are shared out only shapes the plan, so a sample of the rows may tell
        fraction = min(1.0, HOT_SAMPLE_ROWS / max(1, rows))
        seen = side if fraction == 1.0 else side.sample(fraction, seed=17)
        return cell_rows(grid.keys(seen, name), keys, f"__{name}", fraction)

    if max(grid.left_rows, grid.right_rows) > hot_rows or grid.left_rows * grid.right_rows > SHARE_PAIRS:
        l, r, keys = spread_pairs(l, r, counted(left, "l", grid.left_rows), counted(right, "r", grid.right_rows), keys, hot_rows)
    # rows have many keys, which the size of their table does not tell: no side is broadcast
    joined = l.hint("merge").join(r, keys)
    overlap = reduce(lambda a, b: a & b, (
        (F.col(f"__llo{i}") <= F.col(f"__rhi{i}")) & (F.col(f"__rlo{i}") <= F.col(f"__lhi{i}")) for i in range(axes)))
    kept = joined.filter(overlap & grid.in_reference_cell())
    helpers = ["__role", "__level", "__lshare", "__rshare", *[f"__{s}{i}" for s in ("c", "llo", "lhi", "rlo", "rhi", "lf", "rf") for i in range(axes)]]
    return kept.drop(*helpers)
