"""Statistics over inputs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquill.operators.windows import Windows, micros, to_windows, with_pane

SECOND = 1_000_000


def size_stats(sizes: DataFrame, size: str = "n_points") -> DataFrame:
    """Mean and population standard deviation of result sizes."""
    return sizes.agg(F.count("*").alias("n_results"), F.avg(size).alias("avg_size"), F.stddev_pop(size).alias("std_size"))


def result_rate(results: DataFrame, at: str) -> DataFrame:
    """Results per second between the first and the last one (``at`` in microseconds)."""
    seconds = (F.max(at) - F.min(at)) / SECOND
    return results.agg(F.count("*").alias("n_results"), (F.count("*") / F.nullif(seconds, F.lit(0.0))).alias("per_second"))


def pane_closings(flagged: DataFrame, gen: str, windows: Windows, name: str = "closed_gen") -> DataFrame:
    """Arrival time of the row whose progress closed each pane.

    A row closes the panes between the progress before and after it, so no
    ordering is needed here.
    """
    before = F.greatest(windows.pane_of(F.col("prior_progress")), F.lit(0))
    after = windows.pane_of(F.col("progress"))
    return flagged.filter(after > before).select(
        F.explode(F.sequence(before, after - 1)).alias("pane_id"), micros(flagged, gen).alias(name))


def pane_latency(flagged: DataFrame, ts: str, gen: str, windows: Windows) -> DataFrame:
    """Per pane with kept rows: closing time minus first and last arrival. Panes still
    open at the end close with the last arrival."""
    closings = pane_closings(flagged, gen, windows)
    end = flagged.agg(F.max(micros(flagged, gen)).alias("end")).first()["end"]
    kept = with_pane(flagged.filter(~F.col("is_late")), ts, windows).groupBy("pane_id").agg(
        F.min(micros(flagged, gen)).alias("first_gen"), F.max(micros(flagged, gen)).alias("last_gen"),
        F.count("*").alias("n_rows"))
    closed = F.coalesce("closed_gen", F.lit(end))
    return kept.join(closings, "pane_id", "left").select(
        "pane_id", "n_rows", closed.alias("closed_gen"), "first_gen",
        (closed - F.col("first_gen")).alias("latency"), (closed - F.col("last_gen")).alias("closing_delay"))


def window_latency(flagged: DataFrame, ts: str, gen: str, windows: Windows) -> DataFrame:
    """Per window with kept rows: emission time minus earliest arrival of its rows.
    A window is emitted when its last pane closes, or at the end of the input."""
    closings = pane_closings(flagged, gen, windows)
    end = flagged.agg(F.max(micros(flagged, gen)).alias("end")).first()["end"]
    panes = with_pane(flagged.filter(~F.col("is_late")), ts, windows).groupBy("pane_id").agg(
        F.min(micros(flagged, gen)).alias("first_gen"))
    firsts = to_windows(panes, windows).groupBy("window_id").agg(F.min("first_gen").alias("first_gen"))
    last_pane = (F.col("window_id") * windows.per_slide + windows.per_window - 1).alias("pane_id")
    joined = firsts.withColumn("pane_id", last_pane).join(closings, "pane_id", "left")
    emitted = F.coalesce("closed_gen", F.lit(end))
    return joined.select("window_id", "first_gen", emitted.alias("emit_gen"), (emitted - F.col("first_gen")).alias("latency"))


def buffer_time(emitted: DataFrame, gen: str) -> DataFrame:
    """Mean time in the reorder buffer."""
    return emitted.agg(F.avg(F.col("release_gen") - micros(emitted, gen)).alias("avg_buffer_time"))


def per_second(df: DataFrame, at: str, aggs: dict[str, Column], start: int = 0, unit: int = SECOND) -> DataFrame:
    """Series by second (or another ``unit`` in microseconds) with gaps filled by zero;
    ``aggs`` maps names to aggregate columns."""
    elapsed = micros(df, at) - F.lit(start)
    found = df.groupBy(F.floor(elapsed / unit).alias("second")).agg(*[c.alias(n) for n, c in aggs.items()])
    span = df.agg(F.min(elapsed).alias("lo"), F.max(elapsed).alias("hi")).first()
    if span["lo"] is None:
        return found
    seconds = df.sparkSession.range(span["lo"] // unit, span["hi"] // unit + 1).withColumnRenamed("id", "second")
    return seconds.join(found, "second", "left").select("second", *[F.coalesce(n, F.lit(0)).alias(n) for n in aggs])


def arrivals_per_second(df: DataFrame, gen: str) -> DataFrame:
    return df.groupBy(F.floor(micros(df, gen) / SECOND).alias("second")).agg(F.count("*").alias("n_rows"))


def disorder_profile(delayed: DataFrame, gen: str) -> DataFrame:
    """Summary of an input with its ``delay`` per row (microseconds): late rows, delays,
    arrival rate and the index of dispersion of the rows per second, empty seconds included.

    One aggregate per second carries everything the summary needs.
    """
    at = micros(delayed, gen)
    seconds = delayed.groupBy(F.floor(at / SECOND).alias("second")).agg(
        F.count("*").alias("n"), F.count_if(F.col("delay") > 0).alias("late"), F.max("delay").alias("top"),
        F.sum("delay").alias("total"), F.min(at).alias("first"), F.max(at).alias("last"))
    n, span = F.sum("n"), F.max("last") - F.min("first")
    n_seconds = F.max("second") - F.min("second") + 1  # seconds without a row add nothing to the sums
    mean = n / n_seconds
    return seconds.agg(
        n.alias("n_rows"), F.sum("late").alias("n_late"), F.max("top").alias("max_delay"),
        (F.sum("total") / n).alias("mean_delay"), (span / (n - 1)).alias("mean_inter_arrival"),
        (n * F.lit(float(SECOND)) / span).alias("rows_per_second"),
        ((F.sum(F.col("n") * F.col("n")) / n_seconds - mean * mean) / mean).alias("dispersion"))


def throughput_variation(series: DataFrame, column: str) -> DataFrame:
    """Coefficient of variation in percent of a zero-filled series."""
    mean = F.avg(column)
    return series.agg((F.stddev_pop(column) / mean * 100.0).alias("cv_percent"), mean.alias("mean"))
