"""Windowed and maintained skylines on streams, batch by batch.

Each micro-batch runs the batch operators on its rows and the stored pane
results. What one batch stores carries its number and is overwritten when the
batch is run again, so a restart repeats nothing and loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.functions.dominance import Dim
from skyquill.operators.disorder import SlackFold, kept_rows, kslack_with_state
from skyquill.operators.preference import skyline
from skyquill.operators.windows import Windows, split_plan, to_windows, with_pane
from skyquill.runtime import checkpointed


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """What an earlier batch stored, or None where there is nothing; any other error is the caller's."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class WindowSkylineSink:
    """``foreachBatch`` target for a stream in arrival order.

    Late rows are dropped by the slack rule, pane skylines are merged into the
    stored ones, and windows that the progress has closed are written to
    ``<path>/windows``, with their sizes (empty ones too) in ``<path>/sizes``.
    """

    def __init__(self, path: str, dims: Sequence[Dim | str], ts: str, order: Sequence[str], windows: Windows):
        self.path, self.dims, self.ts, self.order, self.windows = path, dims, ts, order, windows

    def _state(self, spark: SparkSession, batch_id: int) -> tuple[SlackFold, int, DataFrame | None]:
        saved = _read(spark, f"{self.path}/progress/batch={batch_id}")
        if saved is None:
            return SlackFold(), 0, None
        r = saved.first()
        fold = SlackFold(r["highest"], r["segment_min"], r["slack"], r["progress"])
        return fold, r["emitted"], _read(spark, f"{self.path}/panes/batch={batch_id}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fold, emitted, stored = self._state(spark, batch_id - 1)
        flagged, fold = kslack_with_state(batch, self.ts, self.order, fold)
        panes = self._merge(kept_rows(flagged).select(*batch.columns), stored)
        closed = max(0, (int(fold.progress) - self.windows.origin) // self.windows.pane)
        ready = max(emitted, (closed - self.windows.per_window) // self.windows.per_slide + 1)
        self._emit(panes, spark.range(emitted, ready).withColumnRenamed("id", "window_id"), f"batch={batch_id}")
        keep = panes.filter(F.col("pane_id") >= ready * self.windows.per_slide)
        keep.write.mode("overwrite").parquet(f"{self.path}/panes/batch={batch_id}")
        progress = spark.createDataFrame(
            [(int(fold.highest), int(fold.segment_min), int(fold.slack), int(fold.progress), int(ready))],
            "highest long, segment_min long, slack long, progress long, emitted long")
        progress.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}")

    def finish(self, spark: SparkSession, batch_id: int) -> None:
        """End of the stream after batch ``batch_id``: windows whose open panes all have rows leave too."""
        fold, emitted, panes = self._state(spark, batch_id)
        if panes is None:
            return
        w, closed = self.windows, max(0, (int(fold.progress) - self.windows.origin) // self.windows.pane)
        open_panes = panes.select("pane_id").distinct().filter(F.col("pane_id") >= closed)
        first_open = F.greatest(F.col("window_id") * w.per_slide, F.lit(closed))
        needed = F.col("window_id") * w.per_slide + w.per_window - first_open
        ids = (to_windows(open_panes, w).filter(F.col("window_id") >= emitted).groupBy("window_id")
               .agg(F.count("*").alias("have")).filter(F.col("have") == needed).select("window_id"))
        self._emit(panes, ids, "batch=end")

    def _merge(self, rows: DataFrame, stored: DataFrame | None) -> DataFrame:
        fresh = with_pane(rows, self.ts, self.windows)
        both = fresh if stored is None else fresh.unionByName(stored)
        return checkpointed(skyline(both, self.dims, ["pane_id"]))

    def _emit(self, panes: DataFrame, ids: DataFrame, name: str) -> None:
        rows = to_windows(panes, self.windows).join(ids, "window_id", "left_semi").drop("pane_id")
        result = checkpointed(skyline(rows, self.dims, ["window_id"]))
        result.write.mode("overwrite").parquet(f"{self.path}/windows/{name}")
        sizes = ids.join(result.groupBy("window_id").agg(F.count("*").alias("n")), "window_id", "left")
        sizes.select("window_id", F.coalesce("n", F.lit(0)).alias("n_points")).write.mode("overwrite").parquet(
            f"{self.path}/sizes/{name}")


class SkylineView:
    """``foreachBatch`` target that keeps the skyline of everything seen so far."""

    def __init__(self, path: str, dims: Sequence[Dim | str], keys: Sequence[str] = ()):
        self.path, self.dims, self.keys = path, dims, keys

    def process(self, batch: DataFrame, batch_id: int) -> None:
        current = self.read(batch.sparkSession, batch_id - 1)
        both = batch if current is None else batch.unionByName(current)
        skyline(both, self.dims, self.keys).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return _read(spark, f"{self.path}/batch={batch_id}")


class FeedbackSplit:
    """Splitting threshold per micro-batch, scaled by 1 / alpha.

    After each batch alpha moves by the gap between the target and the balance
    of the parts just planned, their mean size over their largest: uneven parts
    lower the threshold of the next batch, so more panes are split.
    """

    def __init__(self, target: float, gain: float = 0.5, bounds: tuple[float, float] = (0.25, 8.0)):
        self.target, self.gain, self.bounds = target, gain, bounds
        self.alpha = 1.0

    def plan(self, batch: DataFrame, ts: str, windows: Windows) -> DataFrame:
        """Rows and parts per pane of this batch; moves alpha for the next."""
        planned = checkpointed(split_plan(with_pane(batch, ts, windows), alpha=self.alpha))
        part = F.col("n_rows") / F.col("n_parts")
        seen = planned.agg((F.sum("n_rows") / F.sum("n_parts") / F.max(part)).alias("balance")).first()["balance"]
        if seen is not None:
            low, high = self.bounds
            self.alpha = min(high, max(low, self.alpha + self.gain * (self.target - seen)))
        return planned
