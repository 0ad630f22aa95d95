"""Total orders over whole tables without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.runtime import BROADCAST_ROWS, checkpointed

PART = "__part"
POS = "__pos"


def range_ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partitioned and sorted by ``order``, with the partition number and a row number
    that grows along the order. Both are stored, so every later pass sees the same cut."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(
        placed.withColumn(PART, F.spark_partition_id()).withColumn(POS, F.monotonically_increasing_id())
    )


def arrival_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based position of every row in the order; one count per partition is all the driver sees."""
    rows = range_ordered(df, order)
    spark = df.sparkSession
    offsets, total = [], 0
    for part, first, n in sorted(
        tuple(r) for r in rows.groupBy(PART).agg(F.min(POS), F.count("*")).collect()
    ):
        offsets.append((part, total - first))
        total += n
    shift = spark.createDataFrame(offsets, f"{PART} int, __shift long")
    return (
        rows.join(F.broadcast(shift), PART)
        .withColumn(name, F.col(POS) + F.col("__shift"))
        .drop(PART, POS, "__shift")
    )


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str], gathered_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows in an order. A list of up to ``gathered_rows`` (``BROADCAST_ROWS``) is taken from the
    top of every partition; a longer one is cut by rank, so it never gathers in one place."""
    if n <= (BROADCAST_ROWS if gathered_rows is None else gathered_rows):
        return df.orderBy(*order).limit(n)
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({a: F.col(o) if isinstance(o, str) else o for a, o in zip(names, order)})
    return arrival_rank(keyed, names, "__rank").filter(F.col("__rank") < n).drop("__rank", *names)


def arrival_prefix(df: DataFrame, n: int, order: Sequence[str], gathered_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows in arrival order."""
    return first_rows(df, n, order, gathered_rows)
