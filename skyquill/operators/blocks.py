"""Blocks of bounded size along a space-filling order, for groups too large for one task.

Rows that lie together in all dimensions share a block, so the box between a block's corners is small, and the
corners alone tell most pairs of blocks apart: a block whose low corner is not below another's high corner in every
dimension holds no row that dominates one of the other's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquill.functions.kernels import group_codes
from skyquill.runtime import checkpointed

#: Bits of each dimension in the order, and dimensions that take part in it.
_BITS, _AXES = 4, 15
_CUTS = [i / (1 << _BITS) for i in range(1, 1 << _BITS)]
#: Blocks that one range partition of the order holds, about.
_BLOCKS_A_PART = 4


def same_keys(keys: list[str], other: str) -> Column:
    """The key columns equal those with the prefix ``other``, nulls included."""
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)), F.lit(True))


def _with_order(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Adds ``__z``: the bits of the rows' places among 16 quantiles of their group, dimension by dimension in turns."""
    used = names[:_AXES]
    cuts = [F.percentile_approx(n, _CUTS, 1000).alias(f"__q{i}") for i, n in enumerate(used)]
    if keys:
        table = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*cuts)
        rows = rows.join(table, same_keys(keys, "__k")).drop(*[f"__k{i}" for i in range(len(keys))])
    else:
        found = rows.agg(*cuts).first()
        rows = rows.withColumns({f"__q{i}": F.array(*[F.lit(v) for v in found[f"__q{i}"]]) for i in range(len(used))})
    z = F.lit(0).cast("long")
    for i, n in enumerate(used):
        place = sum(((F.col(f"__q{i}")[j] < F.col(n)).cast("long") for j in range(len(_CUTS))), F.lit(0).cast("long"))
        for b in range(_BITS):
            bit = F.shiftright(place, b).bitwiseAND(F.lit(1).cast("long"))
            z = z.bitwiseOR(F.shiftleft(bit, b * len(used) + i))
    return rows.withColumn("__z", z).drop(*[f"__q{i}" for i in range(len(used))])


def _numbered(keys: list[str], block_rows: int):
    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        last, block, filled = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            codes = group_codes(table, keys)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ids = np.empty(len(codes), np.int64)
            for s, e in zip(starts, np.r_[starts[1:], len(codes)]):
                key = tuple(table.column(k)[int(s)].as_py() for k in keys)
                if last is None or key != last:
                    block, filled, last = block + 1, 0, key
                place = filled + np.arange(e - s)
                ids[s:e] = block + place // block_rows
                block, filled = int(ids[e - 1]), int(place[-1] % block_rows) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + ids)], names=[*batch.schema.names, "__block"])
    return number


def in_blocks(rows: DataFrame, keys: list[str], names: list[str], block_rows: int, count: int) -> DataFrame:
    """``rows`` (``count`` of them, with a unique ``__rid``) with ``__z`` and ``__block``, stored. A block has at most ``block_rows`` rows of one group."""
    ordered = _with_order(rows, keys, names)
    parts = max(1, -(-count // (block_rows * _BLOCKS_A_PART)))
    by = [*keys, "__z", "__rid"]
    placed = ordered.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return checkpointed(placed.mapInArrow(_numbered(keys, block_rows), T.StructType([*placed.schema.fields, T.StructField("__block", T.LongType())])))


def corners(blocks: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row per block: its keys and the least and greatest value of every dimension, as arrays ``low`` and ``high``."""
    ends = [f(n).alias(f"__{a}{i}") for i, n in enumerate(names) for f, a in ((F.min, "l"), (F.max, "h"))]
    table = blocks.groupBy(*keys, "__block").agg(*ends)
    return table.select(*keys, "__block", *[F.array(*[F.col(f"__{a}{i}") for i in range(len(names))]).alias(name) for a, name in (("l", "low"), ("h", "high"))])


def reachable_dims(n: int) -> Column:
    """In how many dimensions the rival block's low corner is no higher than the victim block's high corner."""
    return sum(((F.col("rlow")[i] <= F.col("high")[i]).cast("int") for i in range(n)), F.lit(0))


def block_pairs(victims: DataFrame, rivals: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """(__vb, __rb): the pairs of blocks of one group that meet ``condition`` on ``low``, ``high``, ``rlow`` and ``rhigh``.

    The tables of blocks have a row for some thousand rows each.
    """
    other = rivals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__rb"),
                          F.col("low").alias("rlow"), F.col("high").alias("rhigh"))
    return victims.withColumnRenamed("__block", "__vb").join(other, same_keys(keys, "__k") & condition).select("__vb", "__rb")
