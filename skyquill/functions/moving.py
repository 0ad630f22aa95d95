"""Validity intervals, versioned boxes and linearly moving boxes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.functions.geometry import EPS, Box, _col, contains, intersects, same_shape, touches, touches_point

FOREVER = float("inf")


class Interval(NamedTuple):
    """Right-open ``[start, end)``."""

    start: Column
    end: Column


def interval(start, end) -> Interval:
    return Interval(_col(start), _col(end))


def overlaps(a: Interval, b: Interval) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def covers(a: Interval, b: Interval) -> Column:
    """``b`` lies within ``a``, ends included."""
    return (a.start <= b.start) & (a.end >= b.end)


def same_interval(a: Interval, b: Interval) -> Column:
    def near(x: Column, y: Column) -> Column:
        return (x == y) | (F.abs(x - y) <= EPS)

    return near(a.start, b.start) & near(a.end, b.end)


# versioned boxes: a box and the interval it is valid in

def intersects_in_time(a: Box, when_a: Interval, b: Box, when_b: Interval) -> Column:
    return overlaps(when_a, when_b) & intersects(a, b)


def contains_in_time(a: Box, when_a: Interval, b: Box, when_b: Interval) -> Column:
    return overlaps(when_a, when_b) & contains(a, b)


def touches_in_time(a: Box, when_a: Interval, b: Box, when_b: Interval) -> Column:
    return overlaps(when_a, when_b) & touches(a, b)


def touches_point_in_time(a: Box, when_a: Interval, p: Box, when_p: Interval) -> Column:
    """The point lies on a side's coordinate of the box, and both are valid at some time."""
    return overlaps(when_a, when_p) & touches_point(a, p)


def combine_in_time(a: Interval, b: Interval) -> Interval:
    return Interval(F.least(a.start, b.start), F.greatest(a.end, b.end))


def same_version(a: Box, when_a: Interval, b: Box, when_b: Interval) -> Column:
    return same_shape(a, b) & same_interval(when_a, when_b)


# moving boxes

class MovingBox(NamedTuple):
    """Box at ``start`` and the velocities of its low and high sides; valid in ``[start, end)``."""

    low: tuple[Column, ...]
    high: tuple[Column, ...]
    v_low: tuple[Column, ...]
    v_high: tuple[Column, ...]
    start: Column
    end: Column

    @property
    def n(self) -> int:
        return len(self.low)

    @property
    def valid(self) -> Interval:
        return Interval(self.start, self.end)


def moving_box(low: Sequence, high: Sequence, v_low: Sequence, v_high: Sequence, start, end) -> MovingBox:
    return MovingBox(*[tuple(map(_col, c)) for c in (low, high, v_low, v_high)], _col(start), _col(end))


def moving_point(coords: Sequence, velocity: Sequence, start, end) -> MovingBox:
    at, v = tuple(map(_col, coords)), tuple(map(_col, velocity))
    return MovingBox(at, at, v, v, _col(start), _col(end))


def still_box(b: Box, start, end) -> MovingBox:
    zero = tuple(F.lit(0.0) for _ in b.low)
    return MovingBox(b.low, b.high, zero, zero, _col(start), _col(end))


def box_at(m: MovingBox, t: Column, clamp: bool = False) -> Box:
    """Box at time ``t``; with ``clamp`` it rests outside its interval."""
    if clamp:
        t = F.greatest(m.start, F.least(t, m.end))
    dt = t - m.start
    return Box(tuple(x + v * dt for x, v in zip(m.low, m.v_low)),
               tuple(x + v * dt for x, v in zip(m.high, m.v_high)))


def velocity_box(m: MovingBox) -> Box:
    return Box(m.v_low, m.v_high)


def swept_box(m: MovingBox, t0: Column, t1: Column) -> Box:
    """Box that covers the moving box over ``[t0, t1]``."""
    a, b = box_at(m, t0), box_at(m, t1)
    return Box(tuple(F.least(x, y) for x, y in zip(a.low, b.low)),
               tuple(F.greatest(x, y) for x, y in zip(a.high, b.high)))


def grows(m: MovingBox) -> Column:
    """No axis shrinks; the operators on moving boxes require it."""
    return reduce(and_, (lo <= hi for lo, hi in zip(m.v_low, m.v_high)))


def within_horizon(q: MovingBox, now, horizon) -> Column:
    return (q.start >= _col(now)) & (q.end < _col(now) + _col(horizon))


def same_motion(a: MovingBox, b: MovingBox) -> Column:
    return (same_shape(Box(a.low, a.high), Box(b.low, b.high)) & same_shape(velocity_box(a), velocity_box(b))
            & same_interval(a.valid, b.valid))


def _window(a: MovingBox, b: MovingBox, during: Interval | None) -> tuple[Column, Column]:
    starts, ends = [a.start, b.start], [a.end, b.end]
    if during is not None:
        starts.append(during.start)
        ends.append(during.end)
    return F.greatest(*starts), F.least(*ends)


def meeting_interval(a: MovingBox, b: MovingBox, during: Interval | None = None) -> tuple[Column, Interval]:
    """Whether two moving boxes meet within their common time, and when.

    Each axis gives two linear inequalities in time, each an upper or a lower
    bound; the boxes meet between the greatest lower and the least upper bound.
    Meeting only at the very end of the common time does not count.
    """
    first, last, t1 = _meeting_bounds(a, b, during)
    return (first <= last) & (first < t1), Interval(first, last)


def _meeting_bounds(a: MovingBox, b: MovingBox, during: Interval | None) -> tuple[Column, Column, Column]:
    t0, t1 = _window(a, b, during)
    lower, upper = [t0], [t1]
    sides = [(a.low[i], a.v_low[i], a.start, b.high[i], b.v_high[i], b.start) for i in range(a.n)]
    sides += [(b.low[i], b.v_low[i], b.start, a.high[i], a.v_high[i], a.start) for i in range(a.n)]
    for x, vx, sx, y, vy, sy in sides:
        # x + vx (t - sx) <= y + vy (t - sy)   <=>   slope * t <= room
        slope = vx - vy
        room = (y - vy * sy) - (x - vx * sx)
        lower.append(F.when(slope < 0, room / slope))  # null bounds are ignored
        upper.append(F.when(slope > 0, room / slope).when((slope == 0) & (room < 0), F.lit(-FOREVER)))
    return F.greatest(*lower), F.least(*upper), t1


def with_meeting(df: DataFrame, a: MovingBox, b: MovingBox, during: Interval | None = None,
                 names: tuple[str, str] = ("meet_from", "meet_to")) -> DataFrame:
    """Rows whose two boxes meet, with the interval. The bounds are generated columns,
    so they are worked out once per row and not again in every condition on them."""
    first, last, t1 = _meeting_bounds(a, b, during)
    bounds = F.struct(first.alias(names[0]), last.alias(names[1]), t1.alias("__until"))
    found = df.select("*", F.inline(F.array(bounds)))
    return found.filter((F.col(names[0]) <= F.col(names[1])) & (F.col(names[0]) < F.col("__until"))).drop("__until")


def meets_in_time(a: MovingBox, b: MovingBox, during: Interval | None = None) -> Column:
    return meeting_interval(a, b, during)[0]


def holds_in_time(a: MovingBox, b: MovingBox, during: Interval | None = None) -> Column:
    """``a`` contains ``b`` throughout the time ``b`` is valid (in the period, if given).

    Sides move linearly, so containment at both ends is containment in between.
    """
    t0 = F.greatest(b.start, during.start) if during else b.start
    t1 = F.least(b.end, during.end) if during else b.end
    in_time = (t0 < t1) & (t0 >= a.start) & (t1 <= a.end)
    return in_time & contains(box_at(a, t0), box_at(b, t0)) & contains(box_at(a, t1), box_at(b, t1))


def with_holding(df: DataFrame, a: MovingBox, b: MovingBox, during: Interval | None = None) -> DataFrame:
    """Rows for which ``holds_in_time`` is true. Times are generated columns: worked out once, and what a join runs
    for each of its pairs stays small enough to be compiled."""
    t0 = F.greatest(b.start, during.start) if during else b.start
    t1 = F.least(b.end, during.end) if during else b.end
    times = {"__from": t0, "__until": t1}
    found = df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in times.items()]))))
    t0, t1 = map(F.col, times)
    found = found.filter((t0 < t1) & (t0 >= a.start) & (t1 <= a.end))
    for t in (t0, t1):
        since = {"__a": t - a.start, "__b": t - b.start}
        found = found.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in since.items()]))))
        at = lambda m, dt: Box(tuple(x + v * dt for x, v in zip(m.low, m.v_low)), tuple(x + v * dt for x, v in zip(m.high, m.v_high)))
        found = found.filter(contains(at(a, F.col("__a")), at(b, F.col("__b")))).drop(*since)
    return found.drop(*times)


def holds_after(a: MovingBox, b: MovingBox, t) -> Column:
    return holds_in_time(a, b, Interval(_col(t), b.end))


def _alive(m: MovingBox, t: Column) -> Column:
    return (m.start <= t) & (t < m.end)


def meets_at(a: MovingBox, b: MovingBox, t) -> Column:
    t = _col(t)
    return _alive(a, t) & _alive(b, t) & intersects(box_at(a, t), box_at(b, t))


def holds_at(a: MovingBox, b: MovingBox, t) -> Column:
    t = _col(t)
    return _alive(a, t) & _alive(b, t) & contains(box_at(a, t), box_at(b, t))


# integrals over time: widths are linear, so areas are polynomials in the duration

def _poly_mul(p: list[Column], q: list[Column]) -> list[Column]:
    out: list[Column | None] = [None] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] = a * b if out[i + j] is None else out[i + j] + a * b
    return out


def _poly_integral(p: list[Column], h: Column) -> Column:
    return reduce(add, (c * F.pow(h, F.lit(float(i + 1))) / float(i + 1) for i, c in enumerate(p)))


def _widths(m: MovingBox, t0: Column) -> list[list[Column]]:
    at = box_at(m, t0)
    return [[hi - lo, vh - vl] for lo, hi, vl, vh in zip(at.low, at.high, m.v_low, m.v_high)]


def _clip(m: MovingBox, during: Interval | None) -> tuple[Column, Column]:
    if during is None:
        return m.start, m.end - m.start
    t0 = F.greatest(m.start, during.start)
    return t0, F.least(m.end, during.end) - t0


def swept_volume(m: MovingBox, during: Interval | None = None) -> Column:
    """Integral of the area (length, volume) over the valid time."""
    t0, h = _clip(m, during)
    value = _poly_integral(reduce(_poly_mul, _widths(m, t0)), h)
    return F.when(h > 0, value).otherwise(F.lit(0.0))


def projected_surface(m: MovingBox, during: Interval | None = None) -> Column:
    """Integral over time of the summed widths, in three dimensions plus the summed
    face areas; one dimension has none."""
    if m.n == 1:
        return F.lit(0.0)
    if m.n > 3:
        raise ValueError("projected surface is defined for up to three dimensions")
    t0, h = _clip(m, during)
    widths = _widths(m, t0)
    terms = list(widths)
    if m.n == 3:
        terms += [_poly_mul(widths[i], widths[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    value = reduce(add, (_poly_integral(p, h) for p in terms))
    return F.when(h > 0, value).otherwise(F.lit(0.0))


def with_center_distance(df: DataFrame, a: MovingBox, b: MovingBox, name: str, during: Interval | None = None) -> DataFrame:
    """Add the distance of the centres integrated over the common time.

    The squared distance is A t^2 + B t + C; its root has a closed integral.
    The coefficients are generated columns, worked out once per row.
    """
    columns = df.columns
    t0, t1 = _window(a, b, during)
    rows = df.select("*", F.inline(F.array(F.struct(t0.alias("__t0"), (t1 - t0).alias("__h")))))
    at_a, at_b = box_at(a, F.col("__t0")), box_at(b, F.col("__t0"))
    terms = []
    for i in range(a.n):
        terms.append(((at_b.low[i] + at_b.high[i]) / 2.0 - (at_a.low[i] + at_a.high[i]) / 2.0).alias(f"__x{i}"))
        terms.append(((b.v_low[i] + b.v_high[i]) / 2.0 - (a.v_low[i] + a.v_high[i]) / 2.0).alias(f"__v{i}"))
    rows = rows.select("*", F.inline(F.array(F.struct(*terms))))
    gap, drift = ([F.col(f"__{c}{i}") for i in range(a.n)] for c in "xv")
    rows = rows.select("*", F.inline(F.array(F.struct(
        reduce(add, (v * v for v in drift)).alias("__a"),
        reduce(add, (F.lit(2.0) * x * v for x, v in zip(gap, drift))).alias("__b"),
        reduce(add, (x * x for x in gap)).alias("__c")))))
    qa, qb, qc, h = (F.col(f"__{c}") for c in "abch")

    def primitive(t: Column) -> Column:
        # with u = t + B / 2A and K = C / A - (B / 2A)^2: sqrt(A) * integral of sqrt(u^2 + K)
        u = t + qb / (qa * 2.0)
        k = F.greatest(qc / qa - F.pow(qb / (qa * 2.0), F.lit(2.0)), F.lit(0.0))
        bend = F.when(k > 0, k * F.asinh(u / F.sqrt(F.when(k > 0, k)))).otherwise(F.lit(0.0))
        return F.sqrt(qa) * (u * F.sqrt(u * u + k) + bend) / 2.0

    value = (F.when(h <= 0, F.lit(0.0))
             .when(qa == 0, h * F.sqrt(qc))
             .otherwise(primitive(h) - primitive(F.lit(0.0))))
    return rows.select(*columns, value.alias(name))


def with_common_area(df: DataFrame, a: MovingBox, b: MovingBox, name: str, during: Interval | None = None,
                     when: Interval | None = None) -> DataFrame:
    """Add the area of the common region integrated over the time the boxes meet.

    On each axis the sides that bound the common region change where two sides
    cross. Between consecutive crossings every width is linear, so its value
    half-way is the mean of its ends and Simpson's rule is exact up to three
    axes. ``when`` gives the meeting interval of rows already known to meet.
    Crossing times and widths are generated columns: each is worked out once.
    """
    if a.n > 3:
        raise ValueError("defined for up to three dimensions")
    columns = df.columns
    if when is None:
        first, last, t1 = _meeting_bounds(a, b, during)
        bounds = F.struct(first.alias("__first"), last.alias("__last"), t1.alias("__until"))
        rows = df.select("*", F.inline(F.array(bounds)))
        meets = (F.col("__first") <= F.col("__last")) & (F.col("__first") < F.col("__until"))
    else:
        rows, meets = df.withColumns({"__first": when.start, "__last": when.end}), F.lit(True)
    first, last = F.col("__first"), F.col("__last")
    times = [first, last]
    for i in range(a.n):
        for x, vx, y, vy in ((a.low[i], a.v_low[i], b.low[i], b.v_low[i]),
                             (a.high[i], a.v_high[i], b.high[i], b.v_high[i])):
            slope = vx - vy
            t = ((y - vy * b.start) - (x - vx * a.start)) / F.when(slope != 0, slope)
            times.append(F.coalesce(F.least(F.greatest(t, first), last), first))
    knots = range(len(times))
    rows = rows.select("*", F.explode(F.array(F.sort_array(F.array(*times)))).alias("__times"))
    rows = rows.select("*", F.inline(F.array(F.struct(*[F.get("__times", F.lit(k)).alias(f"__t{k}") for k in knots]))))
    for i in range(a.n):
        widths = []
        for k in knots:
            ta, tb = F.col(f"__t{k}") - a.start, F.col(f"__t{k}") - b.start
            upper = F.least(a.high[i] + a.v_high[i] * ta, b.high[i] + b.v_high[i] * tb)
            lower = F.greatest(a.low[i] + a.v_low[i] * ta, b.low[i] + b.v_low[i] * tb)
            widths.append(F.greatest(upper - lower, F.lit(0.0)).alias(f"__w{i}_{k}"))
        rows = rows.select("*", F.inline(F.array(F.struct(*widths))))

    def product(pick) -> Column:
        return reduce(lambda p, q: p * q, (pick(i) for i in range(a.n)))

    pieces = []
    for k in knots[:-1]:
        at, to = (lambda i, k=k: F.col(f"__w{i}_{k}")), (lambda i, k=k: F.col(f"__w{i}_{k + 1}"))
        half = product(lambda i: (at(i) + to(i)) / 2.0)
        pieces.append((F.col(f"__t{k + 1}") - F.col(f"__t{k}")) / 6.0 * (product(at) + half * 4.0 + product(to)))
    total = F.when(meets, reduce(add, pieces)).otherwise(F.lit(0.0))
    return rows.select(*columns, total.alias(name))
