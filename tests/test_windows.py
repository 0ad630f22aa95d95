import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquill.operators import metrics, windows as win
from skyquill.operators.windows import Windows


def test_bad_window():
    with pytest.raises(ValueError):
        Windows(100, 200)


@pytest.mark.parametrize("length, slide", [(7, 3), (5, 5), (1, 1), (10, 4), (6, 1)])
def test_membership(spark, length, slide):
    w = Windows(length, slide)
    panes = spark.range(40).withColumnRenamed("id", "pane_id")
    got = {(r["pane_id"], r["window_id"]) for r in win.to_windows(panes, w).collect()}
    want = {(p, i) for i in range(60) for p in range(40)
            if i * w.per_slide <= p <= i * w.per_slide + w.per_window - 1}
    assert got == want
    counted = {r["pane_id"]: r["n_windows"] for r in win.windows_per_pane(panes, w).collect()}
    assert counted == {p: sum(1 for q, _ in want if q == p) for p in range(40)}


def test_literal_membership(spark):
    w = Windows(7, 3)
    got = sorted(r["window_id"] for r in win.to_windows(spark.range(9, 10).withColumnRenamed("id", "pane_id"), w).collect())
    assert got == [1, 2, 3]


@pytest.mark.parametrize("progress", [None, 0, 25, 60, 95, 200])
def test_complete_windows_with_lulls(spark, progress):
    w = Windows(20, 10)
    times = [3, 5, 41, 58, 77, 92, 95]
    rows = spark.createDataFrame([(t,) for t in times], "t long")
    got = sorted(r["window_id"] for r in win.complete_windows(rows, "t", w, progress).collect())
    top = max(times) if progress is None else progress
    filled = {t // 10 for t in times}
    want = [i for i in range(40) if all(p in filled or p < top // 10 for p in (i, i + 1))]
    assert got == want


def test_sizes_do_not_depend_on_splitting(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(t), float(a), float(b)) for i, (t, a, b) in enumerate(zip(
        np.sort(rng.integers(0, 3000, 900)), rng.integers(0, 30, 900), rng.integers(0, 30, 900)))]
    df = spark.createDataFrame(rows, "id long, t long, a double, b double")
    w = Windows(500, 200)
    want = None
    for parts, block in ((1, 16_384), (4, 16_384), (16, 5)):
        result = win.window_skyline(df.repartition(parts), ["a", "b"], "t", w, block_rows=block)
        got = sorted((r["window_id"], r["id"]) for r in result.collect())
        want = want or got
        assert got == want
    brute = []
    for i in sorted({g[0] for g in want}):
        inside = [r for r in rows if i * 200 <= r[1] < i * 200 + 500]
        brute += [(i, p[0]) for p in inside if not any(
            q[2] <= p[2] and q[3] <= p[3] and (q[2] < p[2] or q[3] < p[3]) for q in inside)]
    assert want == sorted(brute)


@pytest.mark.parametrize("progress", [None, 0, 1500, 2500, 9000])
def test_windows_in_and_beyond_the_progress(spark, progress, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, int(t), float(a), float(b)) for i, (t, a, b) in enumerate(zip(
        rng.integers(0, 3000, 300), rng.integers(0, 30, 300), rng.integers(0, 30, 300))) if not 900 <= t < 1100]
    df = spark.createDataFrame(rows, "id long, t long, a double, b double")
    w = Windows(500, 200)
    complete = {r["window_id"] for r in win.complete_windows(df, "t", w, progress).collect()}
    want = sorted((i, p[0]) for i in complete for p in rows if i * 200 <= p[1] < i * 200 + 500 and not any(
        q[2] <= p[2] and q[3] <= p[3] and (q[2] < p[2] or q[3] < p[3]) for q in rows if i * 200 <= q[1] < i * 200 + 500))
    for most in (20_000, 0):
        monkeypatch.setattr(win, "BROADCAST_ROWS", most)
        result = win.window_skyline(df, ["a", "b"], "t", w, progress=progress)
        assert sorted((r["window_id"], r["id"]) for r in result.collect()) == want


@pytest.mark.parametrize("most", [20_000, 0])
def test_windows_stay_whole_when_a_join_changes_while_running(spark, most, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, int(t), float(a), float(b)) for i, (t, a, b) in enumerate(zip(
        rng.integers(0, 3000, 900), rng.integers(0, 30, 900), rng.integers(0, 30, 900)))]
    df = spark.createDataFrame(rows, "id long, t long, a double, b double").repartition(8)
    w = Windows(500, 200)
    want = sorted((i, p[0]) for i in range(13) for p in rows if i * 200 <= p[1] < i * 200 + 500 and not any(
        q[2] <= p[2] and q[3] <= p[3] and (q[2] < p[2] or q[3] < p[3]) for q in rows if i * 200 <= q[1] < i * 200 + 500))
    monkeypatch.setattr(win, "BROADCAST_ROWS", most, raising=False)
    # planned as a sort-merge join, run as a broadcast join that reads its shuffle locally
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        result = win.window_skyline(df, ["a", "b"], "t", w).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sorted((r["window_id"], r["id"]) for r in result) == want


@pytest.mark.parametrize("how", ["none", "round_robin", "adaptive"])
def test_pane_splits_lose_nothing(spark, how):
    df = spark.range(1000).withColumn("t", F.when(F.col("id") < 400, 5).otherwise(F.col("id")))
    w = Windows(10, 10)
    split = win.pane_split(df, "t", w, how, 4)
    assert split.count() == 1000
    largest = split.filter("pane_id = 0").agg(F.count_distinct("part_id")).first()[0]
    assert largest == {"none": 1, "round_robin": 4}.get(how, largest) and (how != "adaptive" or largest > 4)
    small = split.filter("pane_id = 90").agg(F.count_distinct("part_id")).first()[0]
    assert how == "round_robin" or small == 1
    assert win.parts_per_pane(split).first()[0] >= 1


def test_per_second_series_fills_gaps(spark):
    df = spark.createDataFrame([(0,), (10,), (3_000_001,)], "at long")
    got = [(r["second"], r["n"]) for r in metrics.per_second(df, "at", {"n": F.count("*")}).orderBy("second").collect()]
    assert got == [(0, 2), (1, 0), (2, 0), (3, 1)]
    cv = metrics.throughput_variation(metrics.per_second(df, "at", {"n": F.count("*")}), "n").first()
    assert cv["mean"] == 0.75 and abs(cv["cv_percent"] - np.std([2, 0, 0, 1]) / 0.75 * 100) < 1e-9
