"""Preference dimensions and the dominance predicate as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Dim(NamedTuple):
    """One preference dimension: a column and +1 (lower is better) or -1 (higher is better)."""

    column: str
    sign: int = 1

    def value(self, qualifier: str | None = None) -> Column:
        ref = F.col(f"{qualifier}.{self.column}" if qualifier else self.column).cast("double")
        return ref if self.sign > 0 else -ref


def low(column: str) -> Dim:
    return Dim(column, 1)


def high(column: str) -> Dim:
    return Dim(column, -1)


def as_dims(dims: Sequence[Dim | str]) -> list[Dim]:
    """Plain names mean "lower is better"."""
    parsed = [d if isinstance(d, Dim) else Dim(d) for d in dims]
    if not parsed:
        raise ValueError("at least one preference dimension is needed")
    return parsed


def dominates(p: str, q: str, dims: Sequence[Dim | str]) -> Column:
    """Row aliased ``p`` is no worse than ``q`` everywhere and better somewhere."""
    pairs = [(d.value(p), d.value(q)) for d in as_dims(dims)]
    return reduce(and_, (a <= b for a, b in pairs)) & reduce(or_, (a < b for a, b in pairs))


def same_point(p: str, q: str, dims: Sequence[Dim | str]) -> Column:
    """Equality on the dimensions only; timestamps do not count."""
    return reduce(and_, (d.value(p) == d.value(q) for d in as_dims(dims)))


def no_worse_count(p: str, q: str, dims: Sequence[Dim | str]) -> Column:
    """Number of dimensions in which ``p`` is no worse than ``q``."""
    return reduce(lambda a, b: a + b, ((d.value(p) <= d.value(q)).cast("int") for d in as_dims(dims)))


def usable(dims: Sequence[Dim | str]) -> Column:
    """Rows with a null or NaN dimension have no place in a preference order."""
    checks = []
    for d in as_dims(dims):
        ref = F.col(d.column).cast("double")
        checks.append(ref.isNotNull() & ~F.isnan(ref))
    return reduce(and_, checks)


def canonical_order(df: DataFrame, dims: Sequence[Dim | str], *ties: str) -> DataFrame:
    """Lexicographic by the dimensions, then by the tie columns (event time, arrival time)."""
    return df.orderBy(*[d.value() for d in as_dims(dims)], *ties)
