"""Bounds, sort-tile-recursive packing and tile reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.functions.moving import MovingBox, box_at
from skyquill.operators.ordering import arrival_rank


def bounds(df: DataFrame, low: Sequence[str], high: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Smallest box around all rows, or around the rows of each group."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high])


def versioned_bounds(df: DataFrame, low, high, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds of versioned boxes: the box and the interval around them."""
    return bounds(df, [*low, start], [*high, end], keys)


def moving_bounds(df: DataFrame, shape: MovingBox, t, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds of moving boxes at time ``t`` and the extreme velocities: ``lo0, hi0, v_lo0, v_hi0, ...``."""
    at = box_at(shape, F.lit(float(t)))
    aggs = []
    for i in range(shape.n):
        aggs += [F.min(at.low[i]).alias(f"lo{i}"), F.max(at.high[i]).alias(f"hi{i}"),
                 F.min(shape.v_low[i]).alias(f"v_lo{i}"), F.max(shape.v_high[i]).alias(f"v_hi{i}")]
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)


def pack_tiles(df: DataFrame, low: Sequence[str], high: Sequence[str], per_tile: int, ties: Sequence[str],
               name: str = "tile_id") -> DataFrame:
    """Sort-tile-recursive packing: slices along each axis in turn, ``per_tile`` rows per tile.

    Every axis costs one range-partitioned sort. A slice is known by the global
    rank of its first row and its number of rows, so the position in it follows
    from the global rank. A slice that needs no further cut keeps its order.
    """
    axes = len(low)
    start, size, pos = F.col("__start"), F.col("__size"), F.col("__rank") - F.col("__start")
    rows = df.withColumns({
        "__start": F.lit(0).cast("long"), "__size": F.lit(df.count()).cast("long"),
        "__done": F.lit(False), "__kept": F.lit(0).cast("long")})
    for axis in range(axes):
        center = F.when(F.col("__done"), F.col("__kept")).otherwise(F.col(low[axis]) + F.col(high[axis]))
        rows = arrival_rank(rows.withColumn("__center", center), ["__start", "__center", *ties], "__rank")
        if axis == axes - 1:
            break
        width = F.ceil(F.sqrt(F.ceil(size / per_tile))) * per_tile
        done = F.col("__done") | (width == per_tile) | (width == size)
        offset = pos - pos % width
        rows = rows.withColumns({
            "__start": F.when(done, start).otherwise(start + offset).cast("long"),
            "__size": F.when(done, size).otherwise(F.least(width, size - offset)).cast("long"),
            "__done": done, "__kept": pos,
        }).drop("__rank", "__center")
    helpers = ["__start", "__size", "__done", "__kept", "__center", "__rank"]
    return rows.withColumn(name, F.expr(f"__rank div {int(per_tile)}")).drop(*helpers)


def tile_report(tiles: DataFrame, id_col: str, low: Sequence[str], high: Sequence[str], name: str = "tile_id") -> DataFrame:
    """Per tile the box around it and the sorted ids in it; a tile is bounded by its capacity."""
    return tiles.groupBy(name).agg(
        F.count("*").alias("n_rows"), *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high],
        F.array_sort(F.collect_list(id_col)).alias("ids"))


def write_tiled(tiles: DataFrame, path: str, name: str = "tile_id") -> None:
    """Files laid out by tile, so box filters skip most of them by their statistics."""
    tiles.repartitionByRange(name).sortWithinPartitions(name).write.mode("overwrite").parquet(path)
