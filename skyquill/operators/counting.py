"""How many rows each point dominates, without building the pairs.

Every dimension is cut at quantiles into slabs of a bounded number of rows. A row dominates-or-equals a point's slabs in
one of two ways. Either it lies in a later slab in every dimension: then only the numbers of slabs matter, and cells of
slabs are counted dimension after dimension, each but the last by the dyadic nodes of slab numbers (a cell is in one
node a level, "all later slabs" is one node a level at most), the last by a running sum. Or some dimension is the
first in which both share a slab: then they meet in that slab, which holds a bounded number of rows, and are compared.
With n rows and slabs of b rows that is b comparisons a point and dimension, and log(n / b) keys a cell and dimension.

A dimension with no more different values than slabs has a slab for each value, however many rows that holds. There the
number of the slab tells all, so nothing is compared for sharing one: the row's own value counts as later.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquill.functions.dominance import Dim, as_dims, usable
from skyquill.runtime import checkpointed

#: Rows of one slab, about; points that meet them in one task.
SLAB_ROWS = 4096
#: Slabs of a dimension at most; beyond, slabs hold more rows and are shared out.
_MOST_SLABS = 4096
_TILE = 1 << 22


def _cut_points(rows: DataFrame, names: list[str], slab_rows: int) -> tuple[list[list[float]], list[int]]:
    """Upper edges of the slabs of every dimension, and the dimensions that are cut at quantiles, not at every value."""
    n = rows.count()
    slabs = max(1, min(_MOST_SLABS, -(-n // slab_rows)))
    every = list(range(len(names)))
    if slabs == 1:
        return [[] for _ in names], every
    shares = [i / slabs for i in range(1, slabs)]
    found = rows.agg(*[F.percentile_approx(c, shares, max(10_000, 4 * slabs)).alias(c) for c in names],
                     *[F.approx_count_distinct(c).alias(f"{c}n") for c in names]).first()
    cuts = [sorted(set(found[c])) for c in names]
    wide = []
    for i, c in enumerate(names):
        values = rows.select(c).distinct().limit(slabs + 1).collect() if found[f"{c}n"] <= 2 * slabs else []
        if 0 < len(values) <= slabs:
            cuts[i] = sorted(r[0] for r in values)
        else:
            wide.append(i)
    return cuts, wide


def _with_slabs(df: DataFrame, names: list[str], cuts: list[list[float]]) -> DataFrame:
    edges = np.array([len(c) for c in cuts])
    if not edges.any():
        return df.withColumns({f"__s{i}": F.lit(0).cast("long") for i in range(len(names))})

    def located(batches):
        arrays = [np.array(c) for c in cuts]
        for batch in batches:
            found = [pa.array(np.searchsorted(a, batch.column(c).to_numpy(zero_copy_only=False), "left").astype(np.int64)) for a, c in zip(arrays, names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *[f"__s{i}" for i in range(len(names))]])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"__s{i} long" for i in range(len(names))])
    return df.mapInArrow(located, fields)


def _ancestor(slab: Column, k: str, c: str) -> Callable[[Column], Column]:
    return lambda level: F.struct(level.alias(k), F.call_function("shiftright", slab, level).alias(c))


def _later(cells: DataFrame, asked: DataFrame, d: int, slabs: list[int]) -> DataFrame:
    """(__pid, n): rows of ``cells`` in later slabs than the point's in every dimension."""
    left, right, keys = cells, asked, []
    *noded, summed = sorted(range(d), key=lambda i: slabs[i])  # few slabs have few levels of nodes
    for i in noded:
        levels = max(1, slabs[i].bit_length())
        k, c = f"__k{i}", f"__c{i}"
        nodes = F.transform(F.sequence(F.lit(0), F.lit(levels)), _ancestor(F.col(f"__s{i}"), k, c))
        left = left.select("*", F.inline(nodes))
        # the later slabs are tiled by the right siblings on the way up from the point's own slab
        siblings = F.transform(F.filter(nodes, lambda x: x[c].bitwiseAND(F.lit(1)) == 0), lambda x: F.struct(x[k].alias(k), (x[c] + 1).alias(c)))
        right = right.select("*", F.inline(siblings))
        keys += [k, c]
    last = f"__s{summed}"
    key = [*keys, last]
    counted = left.groupBy(*key).agg(F.sum("__n").alias("__n")).unionByName(right.select(*key).distinct().withColumn("__n", F.lit(0).cast("long")))
    # a window holds two rows a slab number at most, however many rows and points there are
    above = Window.partitionBy(*keys).orderBy(F.col(last).desc()).rangeBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*key).agg(F.sum("__n").alias("__n")).withColumn("n", F.coalesce(F.sum("__n").over(above), F.lit(0))).filter("n > 0")
    # a point has many keys, which the size of its table does not tell: no side is broadcast
    return right.hint("merge").join(sums.drop("__n"), key).groupBy("__pid").agg(F.sum("n").alias("n"))


def _beside(rows: DataFrame, asked: DataFrame, names: list[str], wide: list[int], slab_rows: int) -> DataFrame:
    """(__pid, n): rows dominated that share the point's slab in some dimension of ``wide``, counted in the first such."""
    d = len(names)
    columns = [*names, *[f"__s{i}" for i in range(d)]]

    def compare(table: pa.Table) -> pa.Table:
        point = table.column("__point").to_numpy(zero_copy_only=False)
        first = int(table.column("__dim")[0].as_py())
        values = np.column_stack([table.column(c).to_numpy() for c in names])
        slabs = np.column_stack([table.column(f"__s{i}").to_numpy() for i in range(d)])
        x, p, xs, ps = values[~point], values[point], slabs[~point], slabs[point]
        counts = np.zeros(len(p), np.int64)
        for s in range(0, len(p), max(1, _TILE // max(1, len(x)))):
            e = s + max(1, _TILE // max(1, len(x)))
            meets = np.ones((len(p[s:e]), len(x)), bool)
            for j in wide[:wide.index(first)]:
                meets &= xs[None, :, j] > ps[s:e, None, j]
            worse = np.zeros_like(meets)
            for j in range(d):
                meets &= x[None, :, j] >= p[s:e, None, j]
                worse |= x[None, :, j] > p[s:e, None, j]
            counts[s:e] = (meets & worse).sum(axis=1)
        ids = pa.array(table.column("__pid").to_numpy(zero_copy_only=False)[point].astype(np.int64))
        return pa.table({"__pid": ids, "n": pa.array(counts)})

    every = F.explode(F.array(*[F.lit(i) for i in wide])).alias("__dim")
    slab = F.array(*[F.col(f"__s{i}") for i in range(d)])[F.col("__dim")].alias("__slab")
    left = rows.select(*columns, F.lit(None).cast("long").alias("__pid"), F.lit(False).alias("__point"), "__row", every).select("*", slab)
    right = asked.select(*columns, "__pid", F.lit(True).alias("__point"), F.col("__pid").alias("__row"), every).select("*", slab)
    # both sides of a crowded slab are dealt over shares, so a task holds a bounded number of each; equal values cannot be
    # cut, so a slab may be far larger than asked for, and shares as small as slabs would copy its rows very often
    share_rows = 4 * max(slab_rows, SLAB_ROWS)
    size = lambda df, name: df.groupBy("__dim", "__slab").agg(F.ceil(F.count("*") / share_rows).cast("int").alias(name))
    shares = checkpointed(size(left, "__x").join(size(right, "__y"), ["__dim", "__slab"]))
    deal = lambda name: F.pmod(F.xxhash64("__row"), F.col(name)).cast("int")
    left, right = left.join(shares, ["__dim", "__slab"]), right.join(shares, ["__dim", "__slab"])
    left = left.withColumns({"__a": deal("__x"), "__b": F.explode(F.sequence(F.lit(0), F.col("__y") - 1))})
    right = right.withColumns({"__b": deal("__y"), "__a": F.explode(F.sequence(F.lit(0), F.col("__x") - 1))})
    whole = left.unionByName(right).drop("__x", "__y", "__row")
    return whole.groupBy("__dim", "__slab", "__a", "__b").applyInArrow(compare, "__pid long, n long").groupBy("__pid").agg(F.sum("n").alias("n"))


def dominance_counts(df: DataFrame, points: DataFrame, dims: Sequence[Dim | str], point_id: str, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(point_id, n_beaten): for each point how many rows it dominates, 0 included.

    Rows and points with a null or NaN dimension take no part. ``point_id`` may repeat; each row of ``points`` counts for itself.
    """
    dims = as_dims(dims)
    names = [f"__d{i}" for i in range(len(dims))]
    d = len(names)
    values = {n: x.value().cast("double") for n, x in zip(names, dims)}
    # numbers are stored before anything is dealt by them
    rows = checkpointed(df.filter(usable(dims)).select(*[c.alias(n) for n, c in values.items()], F.monotonically_increasing_id().alias("__row")))
    asked = checkpointed(points.filter(usable(dims)).select(point_id, *[c.alias(n) for n, c in values.items()])
                         .withColumn("__pid", F.monotonically_increasing_id()))
    cuts, wide = _cut_points(rows, names, slab_rows)
    rows, placed = checkpointed(_with_slabs(rows, names, cuts)), checkpointed(_with_slabs(asked.drop(point_id), names, cuts))
    slabs = [f"__s{i}" for i in range(d)]
    parts = [_beside(rows, placed, names, wide, slab_rows)] if wide else []
    if all(cuts):  # else no row is in a later slab in every dimension
        # where a slab is one value, a row of the point's own slab is no better than the point: it counts as one slab later
        shifted = [F.col(s) if i in wide else (F.col(s) + 1).alias(s) for i, s in enumerate(slabs)]
        cells = rows.groupBy(*slabs).agg(F.count("*").alias("__n")).select(*shifted, "__n")
        parts.append(_later(cells, placed.select("__pid", *slabs), d, [len(c) for c in cuts]))
    if not wide:  # rows equal to the point are not dominated
        equal = rows.groupBy(*names).agg((-F.count("*")).alias("n"))
        parts.append(placed.hint("merge").join(equal, names).select("__pid", "n"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("__pid").agg(F.sum("n").alias("__found"))
    return asked.hint("merge").join(counts, "__pid", "left").select(point_id, F.coalesce("__found", F.lit(0)).cast("long").alias("n_beaten"))
