"""Slack-based progress and in-order release per source on streams.

The rules are those of the batch operators; the state kept between batches is
the same fold, plus the buffered rows of the reorder form. The state store must
be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyquill.operators.disorder import GAINS, SAMPLE_MICROS, AdaptiveBuffer, AdaptiveSlack
from skyquill.operators.windows import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FOLD = "highest long, segment_min long, slack long, progress double"
_CONTROL = "alpha double, integral double, last double, received long, dropped long, sampled long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _named(rows: Iterator[pd.DataFrame], names: Sequence[str]) -> pd.DataFrame:
    """The rows of a key in this batch; columns whose names begin with "_" arrive without them."""
    data = pd.concat(list(rows))
    data.columns = names
    return data


class SlackProcessor(StatefulProcessor):
    """Late flag per row; with a target the slack is scaled by (1 - alpha)."""

    def __init__(self, names: Sequence[str], order: Sequence[str], columns: Sequence[str], target: float | None, gains, period: int):
        self.names, self.order, self.columns = list(names), list(order), list(columns)
        self.target, self.gains, self.period = target, gains, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", f"{_FOLD}, {_CONTROL}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = _named(rows, self.names).sort_values(self.order, kind="stable")
        slack = AdaptiveSlack(self.target or 0.0, self.gains, self.period)
        fold = slack.fold
        if self.state.exists():
            saved = self.state.get()
            fold.highest, fold.segment_min, fold.slack = (int(v) for v in saved[:3])
            fold.progress = saved[3] if self.target else int(saved[3])
            slack.control.restore(saved[4:])
        ts = data["__ts"].to_numpy(np.int64)
        if self.target:
            late, _ = slack.feed(ts, data["__gen"].to_numpy(np.int64))
        else:
            late = ts < fold.feed(ts)["progress"]
        self.state.update((int(fold.highest), int(fold.segment_min), int(fold.slack), float(fold.progress),
                           *slack.control.state()))
        yield data[self.columns].assign(is_late=late)

    def close(self) -> None:
        pass


class ReorderProcessor(StatefulProcessor):
    """Rows released in event-time order. A row whose ``end`` column is true carries no
    data; it ends its source, and what is still buffered leaves."""

    def __init__(self, names: Sequence[str], order: Sequence[str], columns: Sequence[str], types: str, integers: Sequence[str],
                 target: float | None, gains, period: int, end: str):
        self.names, self.order, self.columns, self.types, self.end = list(names), list(order), list(columns), types, end
        self.integers = list(integers)
        self.target, self.gains, self.period = target, gains, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "progress", f"highest long, segment_min long, slack long, emitted long, seq long, arrival long, {_CONTROL}")
        self.waiting = handle.getListState("waiting", f"{self.types}, arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = _named(rows, self.names).sort_values(self.order, kind="stable")
        ended = data[self.end].to_numpy(bool)
        data = data[~ended]
        for c in self.integers:  # an end row's nulls made these floats
            data[c] = data[c].astype("Int64").astype(object).where(data[c].notna(), None)
        buffer = AdaptiveBuffer(self.target, self.gains, self.period)
        seq = arrival = 0
        held = {}
        ts_at, gen_at = self.columns.index("__ts"), self.columns.index("__gen")
        if self.state.exists():
            saved = self.state.get()
            buffer.restore([int(v) for v in saved[:4]])
            seq, arrival = int(saved[4]), int(saved[5])
            if buffer.control:
                buffer.control.restore(saved[6:])
            held = {row[-1]: row[:-1] for row in self.waiting.get()}
            buffer.hold(*(np.array([row[at] for row in held.values()], dtype=np.int64) for at in (ts_at, gen_at)),
                        np.array(list(held), dtype=np.int64))
        rows = list(data[self.columns].itertuples(index=False, name=None))
        numbers = np.arange(arrival, arrival + len(rows))
        held.update(zip(numbers.tolist(), rows))
        arrival += len(rows)
        left, late = buffer.feed(*(np.array([row[at] for row in rows], dtype=np.int64) for at in (ts_at, gen_at)), numbers)
        if ended.any():
            left, late = (np.r_[x, y] for x, y in zip((left, late), buffer.flush()))
        out = [(*held.pop(number), seq + i, overtaken) for i, (number, overtaken) in enumerate(zip(left.tolist(), late.astype(bool).tolist()))]
        seq += len(out)
        control = buffer.control or AdaptiveBuffer(0.5).control
        self.state.update((*buffer.state(), seq, arrival, *control.state()))
        self.waiting.clear()
        if held:
            self.waiting.put([(*row, number) for number, row in held.items()])
        yield pd.DataFrame(out, columns=[*self.columns, "emit_seq", "is_late"])

    def close(self) -> None:
        pass


def _prepared(stream: DataFrame, ts: str, gen: str, end: str | None = None) -> DataFrame:
    """Rows without an event or an arrival time are set aside, as in the batch operators; those that end a source have none."""
    timed = F.col(ts).isNotNull() & F.col(gen).isNotNull()
    stream = stream.where(timed if end is None else timed | F.coalesce(F.col(end), F.lit(False)))
    return stream.withColumns({"__ts": micros(stream, ts), "__gen": micros(stream, gen)})


def kslack_stream(
    stream: DataFrame, source: str, ts: str, gen: str, order: Sequence[str], target: float | None = None,
    gains=GAINS, period: int = SAMPLE_MICROS,
) -> DataFrame:
    """Stream rows with ``is_late`` by the progress of their source."""
    rows = _prepared(stream, ts, gen)
    out = T.StructType([*stream.schema.fields, T.StructField("is_late", T.BooleanType())])
    return rows.groupBy(source).transformWithStateInPandas(
        SlackProcessor(rows.columns, order, stream.columns, target, gains, period), out, "append", "none")


def reorder_stream(
    stream: DataFrame, source: str, ts: str, gen: str, order: Sequence[str], target: float | None = None,
    gains=GAINS, period: int = SAMPLE_MICROS, end: str | None = None,
) -> DataFrame:
    """Stream rows in order per source, with ``emit_seq`` and ``is_late``."""
    rows = _prepared(stream, ts, gen, end)
    marker = end or "__end"
    if end is None:
        rows = rows.withColumn(marker, F.lit(False))
    kept = [f for f in rows.schema.fields if f.name != marker]
    columns = [f.name for f in kept]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    integers = [f.name for f in kept if isinstance(f.dataType, T.IntegralType)]
    out = T.StructType([*kept, T.StructField("emit_seq", T.LongType()), T.StructField("is_late", T.BooleanType())])
    done = rows.groupBy(source).transformWithStateInPandas(
        ReorderProcessor(rows.columns, order, columns, types, integers, target, gains, period, marker), out, "append", "none")
    return done.drop("__ts", "__gen")

