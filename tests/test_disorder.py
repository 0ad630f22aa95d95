"""Slack rules against sequential folds over arrival order, with the input cut into many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquill.operators import disorder, metrics
from skyquill.operators.disorder import _first_at_least


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def fold(ts):
    """One row at a time: late flags and progress."""
    top = slack = progress = 0
    open_, late, seen = [], [], []
    for t in ts:
        open_.append(t)
        if t > top:
            top = t
            slack = max(slack, top - min(open_))
            progress = max(progress, top - slack)
            open_ = []
        late.append(t < progress)
        seen.append(progress)
    return late, seen


def emit(ts):
    """Reorder buffer one row at a time: (row, release row, late) in emission order."""
    top = slack = emitted = 0
    open_, held, out = [], [], []
    for i, t in enumerate(ts):
        open_.append(t)
        held.append((t, i))
        if t > top:
            top = t
            slack = max(slack, top - min(open_))
            open_ = []
            for row in sorted(h for h in held if h[0] <= top - slack):
                held.remove(row)
                out.append((row[1], i, row[0] < emitted))
                emitted = max(emitted, row[0])
    for row in sorted(held):
        out.append((row[1], len(ts) - 1, row[0] < emitted))
        emitted = max(emitted, row[0])
    return out


def sequences():
    rng = np.random.default_rng(7)
    yield [10, 20, 5, 30]
    for n, jitter in ((1, 1), (40, 5), (300, 60), (300, 2000), (600, 30)):
        yield (1000 + np.arange(n) * 10 - rng.integers(0, jitter, n)).tolist()
    growing = 5000 + np.arange(400) * 10
    yield (growing - rng.integers(0, 1 + np.arange(400) * 8)).tolist()
    yield list(range(2000, 1000, -7))


def frame(spark, ts):
    return spark.createDataFrame([(i, int(t), i * 1000) for i, t in enumerate(ts)], "id long, app long, gen long")


@pytest.mark.parametrize("ts", sequences(), ids=lambda ts: f"n{len(ts)}")
def test_kslack_and_reorder(spark, ts):
    df = frame(spark, ts)
    got = sorted((r["id"], r["is_late"], r["progress"]) for r in disorder.kslack(df, "app", ["gen", "id"]).collect())
    late, progress = fold(ts)
    assert [g[1] for g in got] == late and [g[2] for g in got] == progress
    for pending in (500_000, 3):
        out = disorder.reorder(df, "app", "gen", ["gen", "id"], pending_rows=pending)
        rows = sorted((r["emit_pos"], r["id"], r["release_gen"], r["is_late"]) for r in out.collect())
        assert [(i, g // 1000, flag) for _, i, g, flag in rows] == emit(ts)


def test_state_carries_over_calls(spark):
    ts = list(sequences())[4]
    df = frame(spark, ts)
    first, state = disorder.kslack_with_state(df.filter("id < 130"), "app", ["gen", "id"])
    second, _ = disorder.kslack_with_state(df.filter("id >= 130"), "app", ["gen", "id"], state)
    got = sorted((r["id"], r["is_late"]) for r in first.unionByName(second).collect())
    assert [g[1] for g in got] == fold(ts)[0]


def control_fold(ts, gen, target, period, gains=disorder.GAINS):
    """Adaptive slack one row at a time, from the rules."""
    kp, ki, kd = gains
    top = slack = progress = 0
    alpha = integral = 0.0
    last = sampled = None
    received = dropped = 0
    open_, out = [], []
    for t, g in zip(ts, gen):
        received += 1
        sampled = g if sampled is None else sampled
        if g - sampled >= period:
            sampled = g
            coverage = 1 - dropped / received
            last = coverage if last is None else last
            error = coverage - (1 - target)
            integral = min(1, max(-1, integral + ki * error))
            step = min(1, max(-1, kp * error + integral + kd * (coverage - last)))
            last = coverage
            alpha = min(1, max(0, alpha + step))
            received = dropped = 0
        open_.append(t)
        if t > top:
            top = t
            slack = max(slack, top - min(open_))
            progress = max(progress, top - (1 - alpha) * slack)
            open_ = []
        out.append(t < progress)
        dropped += t < progress
    return out


@pytest.mark.parametrize("period", [1000, 7000])
def test_adaptive_kslack(spark, period):
    for ts in list(sequences())[3:6]:
        df = frame(spark, ts).withColumn("source", F.col("id") % 2)
        got = disorder.adaptive_kslack(df, "app", "gen", "source", ["gen", "id"], 0.1, period=period).collect()
        late = {r["id"]: r["is_late"] for r in got}
        for source in (0, 1):
            mine = [i for i in range(len(ts)) if i % 2 == source]
            want = control_fold([ts[i] for i in mine], [i * 1000 for i in mine], 0.1, period)
            assert [late[i] for i in mine] == want


def test_per_source_emission(spark):
    ts = list(sequences())[4]
    df = frame(spark, ts).withColumn("source", F.lit("only"))
    out = disorder.adaptive_reorder(df, "app", "gen", "source", ["gen", "id"], None).orderBy("emit_seq").collect()
    assert [(r["id"], r["is_late"]) for r in out] == [(i, flag) for i, _, flag in emit(ts)]
    adaptive = disorder.adaptive_reorder(df, "app", "gen", "source", ["gen", "id"], 0.1, period=5000).collect()
    assert sorted(r["id"] for r in adaptive) == list(range(len(ts)))


def emit_with_control(ts, gen, target, period, gains=disorder.GAINS):
    """Reorder buffer with adaptive slack, one row at a time: (row, late) in emission order."""
    kp, ki, kd = gains
    top = slack = emitted = received = dropped = 0
    alpha = integral = 0.0
    last = sampled = None
    open_, held, out = [], [], []

    def leave(bound):
        nonlocal emitted, dropped
        for row in sorted(h for h in held if h[0] <= bound):
            held.remove(row)
            late = row[0] < emitted
            dropped += late
            emitted = max(emitted, row[0])
            out.append((row[1], late))

    for i, (t, g) in enumerate(zip(ts, gen)):
        held.append((t, i))
        received += 1
        sampled = g if sampled is None else sampled
        if g - sampled >= period:
            sampled = g
            coverage = 1 - dropped / received
            last = coverage if last is None else last
            error = coverage - (1 - target)
            integral = min(1, max(-1, integral + ki * error))
            step = min(1, max(-1, kp * error + integral + kd * (coverage - last)))
            last = coverage
            alpha = min(1, max(0, alpha + step))
            received = dropped = 0
        open_.append(t)
        if t > top:
            top = t
            slack = max(slack, top - min(open_))
            open_ = []
            leave(top - (1 - alpha) * slack)
    leave(float("inf"))
    return out


@pytest.mark.parametrize("period", [3000, 20_000])
def test_adaptive_reorder(spark, period):
    ts = list(sequences())[5]
    df = frame(spark, ts).withColumn("source", F.lit("only"))
    rows = disorder.adaptive_reorder(df, "app", "gen", "source", ["gen", "id"], 0.1, period=period).orderBy("emit_seq").collect()
    want = emit_with_control(ts, [i * 1000 for i in range(len(ts))], 0.1, period)
    assert [(r["id"], r["is_late"]) for r in rows] == want and any(late for _, late in want)


def test_first_at_least():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 64, 100):
        values = rng.integers(0, 50, n)
        start, wanted = rng.integers(0, n + 1, 200), rng.integers(0, 60, 200)
        got = _first_at_least(values, start, wanted)
        want = [next((j for j in range(s, n) if values[j] >= w), n) for s, w in zip(start, wanted)]
        assert list(got) == want


def test_profile_and_ratio(spark):
    ts = list(sequences())[3]
    df = frame(spark, ts)
    flagged = disorder.kslack(df, "app", ["gen", "id"])
    r = disorder.late_ratio(flagged).first()
    assert r["received"] == len(ts) and r["dropped"] == sum(fold(ts)[0])
    p = metrics.disorder_profile(disorder.arrival_delay(df, "app", ["gen", "id"]), "gen").first()
    top = np.maximum.accumulate(ts)
    assert p["n_late"] == int((np.array(ts) < top).sum()) and p["max_delay"] == int((top - ts).max())


def test_rows_without_times_are_set_aside(spark):
    rows = [(0, 10, 0), (1, None, 1), (2, 5, 2), (3, 20, 3), (4, 7, None)]
    df = spark.createDataFrame(rows, "seq long, ts long, gen long")
    flagged = disorder.kslack(df, "ts", ["seq"]).collect()
    assert {r["seq"]: r["slack"] for r in flagged}[3] == 15 and {r["seq"] for r in flagged} == {0, 2, 3, 4}
    assert disorder.without_times(df, "ts", "gen").count() == 2
    assert {r["seq"] for r in disorder.reorder(df, "ts", "gen", ["seq"]).collect()} == {0, 2, 3}
    keyed = df.withColumn("k", F.lit(1))
    assert {r["seq"] for r in disorder.adaptive_kslack(keyed, "ts", "gen", "k", ["seq"], 0.1).collect()} == {0, 2, 3}
    assert disorder.arrival_delay(df, "ts", ["seq"]).agg(F.max("delay")).first()[0] <= 13


def test_sources_wait_only_for_their_own_partitions(spark):
    """Every partition ends within a source; still one source is not waited for by the next."""
    from pathlib import Path
    from urllib.parse import urlparse

    rng = np.random.default_rng(71)
    rows = [(s, i, 1000 + 10 * i - int(rng.integers(0, 90)), i * 1000) for s in [None, *range(60)] for i in range(25)]
    df = spark.createDataFrame(rows, "source int, id int, app long, gen long")
    folder = Path(urlparse(df.limit(1).checkpoint().sparkSession.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("relay-*"))
    out = disorder.adaptive_reorder(df, "app", "gen", "source", ["gen", "id"], None).collect()
    runs = set(folder.glob("relay-*")) - before
    assert len(runs) == 1 and len(list((runs.pop() / "out").glob("round=*"))) == 2
    for s in (None, 0, 17, 59):
        mine = sorted((r["emit_seq"], r["id"], r["is_late"]) for r in out if r["source"] == s)
        assert [(i, late) for _, i, late in mine] == [(i, late) for i, _, late in emit([r[2] for r in rows if r[0] == s])]
