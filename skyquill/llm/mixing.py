"""Mixing sources to target weights: subset-sum fits on counts by exact length, and a seeded choice of documents.

Every source gets a share of the budget by weight, but at most ``most`` times its own size; what exceeds that goes to
the others by weight. A target is met by whole passes over the source and one partial pass. The partial pass is fitted on
the source's histogram of lengths: each length gives in proportion, and a bounded-knapsack dynamic programme spends the
remaining budget. Which documents of a length are taken is decided by a seeded hash, so reruns agree.

A null text has size 0; a null source is a source, ordered last. Rows equal in doc_id, text and source are numbered, and
each number draws anew, so how many of them are taken is as fine as with different rows. Only the histogram and one row per source meet in single tasks, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquill.llm.storage import same, small_first, stored

#: Weights of the sources in their order, repeating; the budget as a share of all sizes; passes over a source at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Remaining budget that the dynamic programme spends; more than that is first brought down from the longest lengths.
WINDOW = 1 << 17
#: Buckets of the seeded hash in which the cut within one length is looked up.
BUCKETS = 4096

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """The seeded number that decides which documents of a length are taken."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))


def drawn_apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with a new ``draw`` for all but one of those that draw alike; ``repeated`` holds the draws of several rows.

    Rows that draw alike are numbered 0, 1, ... within and across partitions; which of them has which number makes no
    difference, as they are equal. No group is brought together but as counts by partition.
    """
    if repeated.isEmpty():
        return rows
    alike = rows["draw"] == F.col("_draw")
    single = rows.join(small_first(repeated), alike, "left_anti")
    several = stored(rows.join(small_first(repeated), alike, "left_semi").withColumn("_part", F.spark_partition_id()), "mix-repeated")
    earlier = Window.partitionBy("_draw").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = (several.groupBy(F.col("draw").alias("_draw"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
              .select("_draw", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    local = F.row_number().over(Window.partitionBy("_part", "draw").orderBy(F.lit(0))) - 1
    number = F.col("_before") + F.col("_local")
    several = (several.withColumn("_local", local).join(before, (F.col("draw") == F.col("_draw")) & (F.col("_part") == F.col("_at")))
               .withColumn("draw", F.when(number > 0, F.xxhash64("draw", number)).otherwise(F.col("draw"))))
    return single.unionByName(several.select(*single.columns))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many of each size to take, at most ``counts``, for a sum as near below ``budget`` as the programme finds."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    taken = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = counts - taken
    rest = budget - int((sizes * taken).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if rest <= window:
            break
        more = min(int(left[i]), max(0, rest - window // 2) // int(sizes[i]))
        taken[i] += more
        left[i] -= more
        rest -= more * int(sizes[i])
    # reach[v]: some choice sums to v; by[v]: the item that first made v, on top of items before it
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    by = np.full(rest + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        many, step = int(left[i]), 1
        while many > 0 and not reach[rest]:
            n = min(step, many)
            shift = n * int(sizes[i])
            if shift <= rest:
                new = np.zeros(rest + 1, bool)
                new[shift:] = reach[:rest + 1 - shift] & ~reach[shift:]
                by[new] = len(items)
                items.append((int(i), n))
                reach |= new
            many -= n
            step *= 2
        if reach[rest]:
            break
    value = int(np.flatnonzero(reach)[-1])
    while value:
        i, n = items[by[value]]
        taken[i] += n
        value -= n * int(sizes[i])
    return taken


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Resharing what exceeds a limit until no target is above its own ends at one level: each target is the smaller
    of its limit and level times weight. The level is found along the limits in order of limit over weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = (ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                       (F.col("rank") % len(weights) + 1).cast("int")))
              .withColumn("limit", most * F.col("source_size")).withColumn("bound", F.col("limit") / F.col("weight")))
    before = Window.orderBy("bound", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bound", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (ranked.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
              .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", (share * F.sum("source_size").over(every) - F.col("spent"))
                          / (F.sum("weight").over(every) - F.col("gone")))
              .withColumn("level", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "rank", "level")))
                          .over(every)["level"]))
    return ranked.select("source", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"))
                         .alias("target"))


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", ignore_index=True)
    size = float(frame["source_size"].iloc[0])
    passes = int(frame["passes"].iloc[0])
    budget = int(round(float(frame["target"].iloc[0]) - passes * size))
    taken = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), budget)
    return frame.assign(pick=taken)[["source", "size", "n", "passes", "pick"]]


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, size, passes, every, cut) for each length of a source: taken once more if ``every`` or draw <= cut.

    ``rows``: (doc_id, source, size, draw); ``goal``: targets with ``passes``.
    """
    lengths = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(goal.withColumnRenamed("source", "_source"),
                           same(F.col("source"), F.col("_source"))).drop("_source")
    picks = stored(lengths.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, n long, passes long, pick long"), "mix-picks")
    part = picks.where("pick > 0 AND pick < n").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "pick")
    inside = (rows.join(small_first(part), same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")))
              .drop("_source", "_size").withColumn("bucket", F.shiftrightunsigned("draw", 64 - BUCKETS.bit_length() + 1)))
    # which bucket of the hash holds the last document taken, then which document in it; signed order within a bucket holds
    tally = inside.groupBy("source", "size", "pick", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("bucket")
    edge = (tally.withColumn("upto", F.sum("n").over(upto)).where("upto > pick AND upto - n <= pick")
            .selectExpr("source AS _source", "size AS _size", "bucket AS _bucket", "pick - (upto - n) AS want"))
    in_bucket = inside.join(small_first(edge), same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size"))
                            & (F.col("bucket") == F.col("_bucket")))
    in_bucket = in_bucket.groupBy("source", "size", "bucket", "want", "draw").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("draw")
    last = (in_bucket.withColumn("upto", F.sum("n").over(upto)).where("upto <= want")
            .groupBy("source", "size").agg(F.max("draw").alias("last")))
    # nothing of the edge bucket: the cut is just below it
    below = edge.selectExpr("_source AS source", "_size AS size", "_bucket AS bucket")
    found = (below.withColumnRenamed("source", "_source").withColumnRenamed("size", "_size")
             .join(last, same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")), "left")
             .select("_source", "_size", "bucket", "last"))
    return (picks.join(found, same(F.col("source"), F.col("_source")) & (F.col("size") == F.col("_size")), "left")
            .select("source", "size", "passes", (F.col("pick") == F.col("n")).alias("every"), "bucket", "last"))


def _again() -> Column:
    """Whether the partial pass takes a document, from the columns of ``cuts``."""
    bucket = F.shiftrightunsigned("draw", 64 - BUCKETS.bit_length() + 1)
    inside = (bucket < F.col("bucket")) | ((bucket == F.col("bucket")) & (F.col("draw") <= F.col("last")))
    return (F.coalesce(F.col("every"), F.lit(False)) | F.coalesce(inside, F.lit(False))).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
             seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, draw), draws of several rows, targets with passes, and cuts."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              word_count(F.col("text")).alias("size"), draw(seed).alias("draw")), "mix-rows")
    repeated = stored(rows.groupBy(F.col("draw").alias("_draw")).agg(F.count("*").alias("n")).where("n > 1").select("_draw"), "mix-alike")
    rows = drawn_apart(rows, repeated)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal, "mix-goal")
    return rows, repeated, goal, stored(cuts(rows, goal), "mix-cuts")


def _decided(rows: DataFrame, goal: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and how often the mix takes each."""
    goal = goal.select(F.col("source").alias("_source"), "source_size", "target", F.col("passes").alias("_passes"))
    cut = cut.select(F.col("source").alias("_cut_source"), F.col("size").alias("_cut_size"), "every", "bucket", "last")
    return (rows.join(small_first(goal), same(F.col("source"), F.col("_source")))
            .join(small_first(cut), same(F.col("source"), F.col("_cut_source")) & (F.col("size") == F.col("_cut_size")), "left")
            .withColumn("times", F.col("_passes") + _again()))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    rows, _, goal, cut = mix_plan(docs, weights, share, most, seed)
    return _decided(rows, goal, cut).select("doc_id", "size", "source_size", "target",
                                            (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
          seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (documents without a word as often as their source is passed)."""
    _, repeated, goal, cut = mix_plan(docs, weights, share, most, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       draw(seed).alias("draw"))
    rows = drawn_apart(rows, repeated)
    return (_decided(rows, goal, cut).withColumn("_", F.explode(F.expr("IF(times > 0, sequence(1L, times), array())")))
            .select("row.*"))
