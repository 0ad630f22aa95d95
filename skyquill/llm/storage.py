"""Lineage cuts, size-checked joins and connected components for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.runtime import at_most, checkpointed

#: Rows of a narrow table (keys and a few numbers) that may be broadcast; beyond, both sides are shuffled.
SMALL_ROWS = 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        checkpointed(spark.range(1))  # a session without the setting, as in tests: let the helper choose
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch while an operator writes its own tables: whole texts make large rows.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for the time of an action of our own; the session's setting is put back."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: spark.conf.get(name) for name in (rows, size)}
    held = int(before[rows])
    spark.conf.set(rows, str(min(held, BATCH_ROWS) if held > 0 else BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, columns can be pruned."""
    path = folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_first(keys: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if a count proves it small; else as it is, and the join shuffles."""
    return F.broadcast(keys) if at_most(keys, rows) else keys


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``links``, for every node that has one.

    Large-star and small-star in turns (Kiveris et al., 2014) until the links are stars. Each step is a grouped
    minimum with map-side combine and a join that Spark may split where a node is hot; nothing reaches the driver
    but two numbers a round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionAll(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
