"""Operation logs of boxes, versioned boxes and moving points, and bulk entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.operators.ordering import arrival_rank
from skyquill.sources.tuples import split_fields

# Fixed values of the log format.
DELETE, INSERT, QUERY = 0, 1, 2


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines numbered from 0 in the order of file names and of lines within a file.

    A task may read several files, or blocks of files, in any order; lines of one block are read as they stand."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"))
    ranked = arrival_rank(lines, ["__file", "__block", "__line"], "seq")
    return ranked.select("value", "seq")


def _f(i: int, kind: str = "double") -> Column:
    return F.get(F.col("f"), F.lit(i)).cast(kind)


def _box_columns(at: int) -> list[Column]:
    """Corners may come in any order."""
    x1, y1, x2, y2 = (_f(at + i) for i in range(4))
    return [F.least(x1, x2).alias("x_lo"), F.least(y1, y2).alias("y_lo"),
            F.greatest(x1, x2).alias("x_hi"), F.greatest(y1, y2).alias("y_hi")]


def box_log(lines: DataFrame) -> DataFrame:
    """Operations from lines (``seq``, ``value``) of ``op id x1 y1 x2 y2``."""
    return split_fields(lines).select("seq", _f(0, "int").alias("op"), _f(1, "long").alias("id"), *_box_columns(2))


def versioned_log(lines: DataFrame) -> DataFrame:
    """Operations from lines of ``t op id x1 y1 x2 y2``; query lines add their interval."""
    return split_fields(lines).select(
        "seq", _f(0).alias("t"), _f(1, "int").alias("op"), _f(2, "long").alias("id"), *_box_columns(3),
        _f(7).alias("q_start"), _f(8).alias("q_end"))


def moving_log(lines: DataFrame) -> DataFrame:
    """Operations from lines of ``id op ct rt - ax vx - ay vy``. Updates carry position and velocity at
    ``ct``; query lines carry the x and y extents and the interval ``[ct, rt]``."""
    return split_fields(lines).select(
        "seq", _f(0, "long").alias("id"), _f(1, "int").alias("op"), _f(2).alias("ct"), _f(3).alias("rt"),
        _f(5).alias("ax"), _f(6).alias("vx"), _f(8).alias("ay"), _f(9).alias("vy"))


def read_box_log(spark: SparkSession, path: str) -> DataFrame:
    return box_log(_numbered(spark, path))


def read_versioned_log(spark: SparkSession, path: str) -> DataFrame:
    return versioned_log(_numbered(spark, path))


def read_moving_log(spark: SparkSession, path: str) -> DataFrame:
    return moving_log(_numbered(spark, path))


def moving_queries(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == QUERY).select(
        F.col("seq").alias("query_id"), F.least("ax", "vx").alias("x_lo"), F.greatest("ax", "vx").alias("x_hi"),
        F.least("ay", "vy").alias("y_lo"), F.greatest("ay", "vy").alias("y_hi"),
        F.col("ct").alias("t_start"), F.col("rt").alias("t_end"))


def inserts(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == INSERT)


def updates(log: DataFrame) -> DataFrame:
    """Inserts and deletes."""
    return log.filter(F.col("op") != QUERY)


def queries(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == QUERY)


def bulk_entries(df: DataFrame, id_col: str, low: Sequence[str], high: Sequence[str], payload: str | None = None) -> DataFrame:
    """Entries of a bulk load: id, corners and an opaque payload."""
    body = F.col(payload).cast("binary") if payload else F.lit(None).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in low]).alias("low"),
                     F.array(*[F.col(c).cast("double") for c in high]).alias("high"), body.alias("payload"))
