"""Window-result and per-second metric sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.operators.metrics import per_second


def window_lines(sizes: DataFrame, key: str = "window_id", size: str = "n_points") -> DataFrame:
    """One text line per window, in window order."""
    line = F.format_string("Window %d with %d result points", F.col(key).cast("long"), F.col(size).cast("long"))
    return sizes.orderBy(key).select(line.alias("value"))


def write_window_sizes(sizes: DataFrame, path: str) -> None:
    window_lines(sizes).write.mode("overwrite").text(path)


def write_window_rows(result: DataFrame, path: str) -> None:
    """Result rows laid out by window; a window may span files, so a large one is not one task."""
    result.repartitionByRange("window_id").sortWithinPartitions("window_id").write.mode("overwrite").parquet(path)


def second_series(latencies: DataFrame, emit: str = "emit_gen", latency: str = "latency") -> DataFrame:
    """``second results avg_latency_ms`` from the first emission on, gaps filled with zeros."""
    start = latencies.agg(F.min(emit)).first()[0]
    return per_second(latencies, emit, {
        "results": F.count("*"), "avg_latency_ms": F.round(F.avg(F.col(latency) / 1000.0), 6)}, start or 0)


def write_second_series(series: DataFrame, path: str) -> None:
    series.orderBy("second").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in series.columns])).write.mode(
        "overwrite").text(path)
