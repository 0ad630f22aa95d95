"""Sequential folds per source that may span any number of range partitions.

Rows are range-partitioned by (source, arrival), so a source with very many
rows covers several partitions of ordinary size. All sources run at once from
the partition they begin in; only the rows of a source that goes on in the next
partition wait for a later round, from the state the partition before ended in.
There are as many rounds as partitions that one source covers. A state is a short
text, and rows that must be held over (a reorder buffer) go through a table in the
checkpoint folder, never through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.operators.ordering import PART, POS, range_ordered

_OUT, _HELD, _STATE = 0, 1, 2


class SourceFold(Protocol):
    """Fold over the rows of one source in arrival order."""

    def feed(self, rows: pa.RecordBatch, held: bool) -> list[pa.RecordBatch]:
        """Output for these rows; ``held`` rows come back from the partition before."""

    def end(self) -> list[pa.RecordBatch]:
        """Output when the source ends."""

    def pause(self) -> tuple[str, pa.Table | None]:
        """State, and rows to hold, when the source goes on in the next partition."""


def _runs(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Maximal slices with equal values in ``columns``."""
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for name in columns:
        encoded = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= encoded[1:] != encoded[:-1]
    cuts = np.flatnonzero(np.r_[True, change, True])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield tuple(batch.column(c)[lo].as_py() for c in columns), batch.slice(lo, hi - lo)


def relay(
    df: DataFrame, source: str, order: Sequence[str], start: Callable[[str | None], SourceFold], added: Sequence[T.StructField],
) -> DataFrame:
    """Run the fold ``start(state)`` over every source; returns the rows with the ``added`` columns."""
    rows = range_ordered(df, [source, *order])
    edges = sorted(
        (tuple(r) for r in rows.groupBy(PART).agg(F.min_by(source, POS), F.max_by(source, POS)).collect()),
        key=lambda r: r[0])
    onward = {a[0]: b[0] for a, b in zip(edges, edges[1:]) if a[2] == b[1]}
    # the round of the first source of a partition; what begins in a partition waits for nothing
    depth: dict[int, int] = {}
    for part, first, last in edges:
        if part in onward:
            depth[onward[part]] = depth.get(part, 0) + 1 if first == last else 1
    lasts = {part: last for part, _, last in edges if part in onward}
    firsts = {part: first for part, first, _ in edges}

    held_flag = "__held"
    data = rows.withColumn(held_flag, F.lit(False))
    names = [c for c in data.columns if c != held_flag]
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in data.schema.fields if f.name != held_flag], *added,
        T.StructField("__kind", T.IntegerType()), T.StructField("__state", T.StringType())])
    added_names = [f.name for f in added]

    def run(states: dict[int, str]):
        def fold_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current: tuple | None = None
            fold = None
            arrow = None

            def output(batch: pa.RecordBatch) -> pa.RecordBatch:
                n = batch.num_rows
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in (*names, *added_names)], pa.array(np.full(n, _OUT, np.int32)),
                     pa.nulls(n, pa.string())], names=[*names, *added_names, "__kind", "__state"])

            def padded(table: pa.Table, kind: int, state: str | None, types: list[pa.DataType]) -> list[pa.RecordBatch]:
                n = table.num_rows
                columns = [*table.columns, *[pa.nulls(n, t) for t in types], pa.array(np.full(n, kind, np.int32)),
                           pa.array([state] * n, pa.string())]
                return pa.table(columns, names=[*names, *added_names, "__kind", "__state"]).to_batches()

            def closed() -> Iterator[pa.RecordBatch]:
                part, name = current
                types = [_ARROW[f.dataType.typeName()] for f in added]
                if part in onward and lasts[part] == name:
                    state, held = fold.pause()
                    target = pa.array([onward[part]], pa.int32())
                    marker = pa.table({c: target if c == PART else pa.nulls(1, arrow.field(c).type) for c in names})
                    yield from padded(marker, _STATE, state, types)
                    if held is not None and held.num_rows:
                        moved = held.set_column(names.index(PART), PART, pa.array(np.full(held.num_rows, onward[part], np.int32)))
                        yield from padded(moved, _HELD, None, types)
                else:
                    for batch in fold.end():
                        yield output(batch)

            for batch in batches:
                arrow = batch.schema
                for (part, name, held), piece in _runs(batch, [PART, source, held_flag]):
                    if current != (part, name):
                        if current is not None:
                            yield from closed()
                        resumed = states.get(part) if firsts[part] == name else None
                        current, fold = (part, name), start(resumed)
                    for out in fold.feed(piece.select(names), held):
                        yield output(out)
            if current is not None:
                yield from closed()

        return fold_all

    result = [*df.columns, *added_names]
    if not onward:
        return data.mapInArrow(run({}), schema).filter(F.col("__kind") == _OUT).select(*result)

    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir()}/relay-{uuid4()}"
    depths = spark.createDataFrame(
        [(part, firsts[part], level) for part, level in depth.items()],
        T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__first", df.schema[source].dataType), T.StructField("relay_depth", T.IntegerType())]))
    continued = (F.col(PART) == F.col("__p")) & F.col(source).eqNullSafe(F.col("__first"))
    # a broadcast leaves the rows in their partitions and order
    begun = data.join(F.broadcast(depths), continued, "left_anti")
    begun.mapInArrow(run({}), schema).write.parquet(f"{folder}/out/round=0")
    data.join(F.broadcast(depths), continued).drop("__p", "__first").write.partitionBy("relay_depth").parquet(f"{folder}/rows")
    for level in range(1, max(depth.values()) + 1):
        turn = spark.read.schema(data.schema).parquet(f"{folder}/rows/relay_depth={level}")
        last = spark.read.schema(schema).parquet(f"{folder}/out/round={level - 1}")
        states = {r[PART]: r["__state"] for r in last.filter(F.col("__kind") == _STATE).select(PART, "__state").collect()}
        turn = turn.unionByName(last.filter(F.col("__kind") == _HELD).select(*names).withColumn(held_flag, F.lit(True)))
        placed = turn.repartition(PART).sortWithinPartitions(PART, source, F.desc(held_flag), *order)
        placed.mapInArrow(run(states), schema).write.parquet(f"{folder}/out/round={level}")
    done = spark.read.schema(schema).parquet(*[f"{folder}/out/round={i}" for i in range(max(depth.values()) + 1)])
    return done.filter(F.col("__kind") == _OUT).select(*result)


_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
