"""Boxes, points and segments as Column expressions.

A box is a ``Box`` of low and high columns per axis; a point is a box whose low
and high columns are the same. Flat double columns keep every predicate inside
generated code and let Parquet prune on them.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import add, and_, mul, or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


class Box(NamedTuple):
    """Low and high Column per axis."""

    low: tuple[Column, ...]
    high: tuple[Column, ...]

    @property
    def n(self) -> int:
        return len(self.low)


def box(low: Sequence, high: Sequence) -> Box:
    if len(low) != len(high):
        raise ValueError("low and high must have the same number of axes")
    return Box(tuple(map(_col, low)), tuple(map(_col, high)))


def ordered_box(a: Sequence, b: Sequence) -> Box:
    """Box from two opposite corners in any order."""
    a, b = list(map(_col, a)), list(map(_col, b))
    return Box(tuple(F.least(x, y) for x, y in zip(a, b)), tuple(F.greatest(x, y) for x, y in zip(a, b)))


def point(*coords) -> Box:
    cols = tuple(map(_col, coords))
    return Box(cols, cols)


def _all(items) -> Column:
    return reduce(and_, items)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPS


# predicates -----------------------------------------------------------------

def intersects(a: Box, b: Box) -> Column:
    """Closed intersection: shared boundaries count."""
    return _all((a.low[i] <= b.high[i]) & (a.high[i] >= b.low[i]) for i in range(a.n))


def contains(a: Box, b: Box) -> Column:
    """Closed containment of ``b`` (box or point) in ``a``."""
    return _all((a.low[i] <= b.low[i]) & (a.high[i] >= b.high[i]) for i in range(a.n))


def touches_point(a: Box, p: Box) -> Column:
    """Some coordinate of the point lies on the boundary coordinate of its axis."""
    return reduce(or_, (_near(a.low[i], p.low[i]) | _near(a.high[i], p.low[i]) for i in range(a.n)))


def touches(a: Box, b: Box) -> Column:
    """The closed boxes meet and their interiors do not."""
    apart = reduce(or_, ((a.high[i] <= b.low[i]) | (b.high[i] <= a.low[i]) for i in range(a.n)))
    return intersects(a, b) & apart


def same_shape(a: Box, b: Box) -> Column:
    return _all(_near(a.low[i], b.low[i]) & _near(a.high[i], b.high[i]) for i in range(a.n))


# box measures ---------------------------------------------------------------

def area(a: Box) -> Column:
    return reduce(mul, (a.high[i] - a.low[i] for i in range(a.n)))


def margin(a: Box) -> Column:
    """Sum of the widths times 2^(axes - 1)."""
    return reduce(add, (a.high[i] - a.low[i] for i in range(a.n))) * float(2 ** (a.n - 1))


def center(a: Box) -> tuple[Column, ...]:
    return tuple((a.low[i] + a.high[i]) / 2.0 for i in range(a.n))


def min_distance(a: Box, b: Box) -> Column:
    """Euclidean distance between the nearest points of two boxes (or points); 0 when they meet."""
    gaps = [F.greatest(a.low[i] - b.high[i], b.low[i] - a.high[i], F.lit(0.0)) for i in range(a.n)]
    return F.sqrt(reduce(add, (g * g for g in gaps)))


def intersection(a: Box, b: Box) -> Box:
    """Common region; meaningful where ``intersects`` holds."""
    return Box(tuple(F.greatest(x, y) for x, y in zip(a.low, b.low)),
               tuple(F.least(x, y) for x, y in zip(a.high, b.high)))


def intersection_area(a: Box, b: Box) -> Column:
    return F.when(intersects(a, b), area(intersection(a, b))).otherwise(F.lit(0.0))


def union_box(a: Box, b: Box) -> Box:
    return Box(tuple(F.least(x, y) for x, y in zip(a.low, b.low)),
               tuple(F.greatest(x, y) for x, y in zip(a.high, b.high)))


# segments (two axes unless said otherwise) ----------------------------------

class Segment(NamedTuple):
    start: tuple[Column, ...]
    end: tuple[Column, ...]


def segment(start: Sequence, end: Sequence) -> Segment:
    return Segment(tuple(map(_col, start)), tuple(map(_col, end)))


def segment_box(s: Segment) -> Box:
    return ordered_box(s.start, s.end)


def segment_center(s: Segment) -> tuple[Column, ...]:
    return tuple((a + b) / 2.0 for a, b in zip(s.start, s.end))


def flat_area() -> Column:
    """Points and segments have no area."""
    return F.lit(0.0)


def same_segment(s: Segment, t: Segment) -> Column:
    return _all(_near(a, b) & _near(c, d) for a, b, c, d in zip(s.start, t.start, s.end, t.end))


def double_area(a, b, c) -> Column:
    """Twice the signed area of a triangle; positive when a, b, c turn left."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def left_of(a, b, c) -> Column:
    return double_area(a, b, c) > 0


def collinear(a, b, c) -> Column:
    return double_area(a, b, c) == 0


def between(a, b, c) -> Column:
    """``c`` lies on the segment a-b."""
    return collinear(a, b, c) & contains(ordered_box(a, b), point(*c))


def segments_intersect(s: Segment, t: Segment) -> Column:
    """Two segments share a point, ends included: their boxes meet and neither
    segment has both ends strictly on one side of the other."""
    def straddles(u: Segment, v: Segment) -> Column:
        return F.signum(double_area(*u, v.start)) * F.signum(double_area(*u, v.end)) <= 0

    return intersects(segment_box(s), segment_box(t)) & straddles(s, t) & straddles(t, s)


def segment_intersects_box(s: Segment, b: Box) -> Column:
    """The segment and the closed box share a point: nothing separates them, neither
    an axis (their boxes meet) nor the segment's line (the corners are not all on one side)."""
    corners = [(b.low[0], b.low[1]), (b.low[0], b.high[1]), (b.high[0], b.high[1]), (b.high[0], b.low[1])]
    sides = [double_area(s.start, s.end, c) for c in corners]
    return intersects(segment_box(s), b) & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def signed_line_distance(s: Segment, p: Sequence[Column]) -> Column:
    """Distance of a point to the infinite line through the segment, positive on the left
    hand side when going from start to end. A segment of no length has no sides: the
    distance is that to its start."""
    length = F.hypot(s.end[0] - s.start[0], s.end[1] - s.start[1])
    to_start = F.hypot(p[0] - s.start[0], p[1] - s.start[1])
    return F.when(length > 0, double_area(s.start, s.end, p) / length).otherwise(to_start)


def line_distance(s: Segment, p: Sequence[Column]) -> Column:
    return F.abs(signed_line_distance(s, p))


def max_line_distance(s: Segment, b: Box) -> Column:
    """Largest signed distance over the corners of a box."""
    return F.greatest(*[signed_line_distance(s, c) for c in product(*zip(b.low, b.high, strict=True))])


def perpendicular_angle(s: Segment) -> Column:
    """Angle of the line perpendicular to the segment, above -pi/2 and up to pi/2: the normal of
    the direction, turned to the right half plane."""
    dx, dy = s.end[0] - s.start[0], s.end[1] - s.start[1]
    turned = F.when(dy != 0, F.signum(dy)).otherwise(-F.signum(dx))
    return F.atan2(-dx * turned, F.abs(dy)) + F.lit(0.0)
