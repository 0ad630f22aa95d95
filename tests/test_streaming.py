"""Streams give the results of the batch operators on the same rows."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from skyquill.operators import disorder
from skyquill.operators.preference import skyline
from skyquill.operators.windows import Windows, window_skyline, window_sizes, complete_windows
from skyquill.plans.tables import HOUR, ORIGIN, stream_rows
from skyquill.sources.tuples import ingest, replay_stream, stage_replay
from skyquill.streaming import drain
from skyquill.streaming.drain import drained, drained_by_batch
from skyquill.streaming.slack import kslack_stream, reorder_stream
from skyquill.streaming.windows import FeedbackSplit, SkylineView, WindowSkylineSink

ORDER = ["gen_us", "event_id"]
DIMS = ["d1", "d2", "d3"]
W = Windows(12 * HOUR, 4 * HOUR, ORIGIN)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("replay") / "rows")
    rows = stream_rows(spark, DATA).withColumn("source", F.col("user_id") % 3)
    n = stage_replay(rows, path, ORDER, 250)
    assert n == -(-rows.count() // 250)
    return rows, path


def run(stream, tmp_path, name):
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("target", [None, 0.05])
def test_kslack_stream_equals_batch(spark, staged, tmp_path, target):
    rows, path = staged
    stream = replay_stream(spark, path, rows.schema)
    got = run(kslack_stream(stream, "source", "app_us", "gen_us", ORDER, target, period=HOUR), tmp_path, f"ks{target is None}")
    want = disorder.adaptive_kslack(rows, "app_us", "gen_us", "source", ORDER, target or 1e-9, period=HOUR if target else 1 << 60)
    assert as_set(got, "event_id", "is_late") == as_set(want, "event_id", "is_late")


def test_reorder_stream_equals_batch(spark, staged, tmp_path):
    rows, path = staged
    ends = rows.groupBy("source").agg(F.max("gen_us").alias("gen_us")).withColumn("gen_us", F.col("gen_us") + 1)
    marked = rows.withColumn("ended", F.lit(False)).unionByName(
        ends.withColumn("ended", F.lit(True)).withColumn("event_id", F.lit(-1).cast("long")), allowMissingColumns=True)
    marked_path = str(tmp_path / "marked")
    stage_replay(marked, marked_path, ORDER, 250)
    stream = replay_stream(spark, marked_path, marked.schema)
    got = run(reorder_stream(stream, "source", "app_us", "gen_us", ORDER, end="ended"), tmp_path, "reordered")
    want = disorder.adaptive_reorder(rows, "app_us", "gen_us", "source", ORDER, None)
    assert as_set(got, "source", "emit_seq", "event_id", "is_late") == as_set(want, "source", "emit_seq", "event_id", "is_late")


def test_window_skyline_stream_equals_batch(spark, staged, tmp_path):
    rows, path = staged
    sink = WindowSkylineSink(str(tmp_path / "out"), DIMS, "app_us", ORDER, W)
    stream = replay_stream(spark, path, rows.schema).select("event_id", "app_us", "gen_us", *DIMS)
    batches = []

    def each(batch, batch_id):
        batches.append(batch_id)
        sink.process(batch, batch_id)

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    sink.finish(spark, max(batches))
    assert len(batches) == 4
    flagged = disorder.kslack(rows, "app_us", ORDER)
    progress = flagged.agg(F.max("progress")).first()[0]
    kept = disorder.kept_rows(flagged).select("event_id", "app_us", *DIMS)
    want = window_skyline(kept, DIMS, "app_us", W, progress=progress)
    got = spark.read.parquet(str(tmp_path / "out" / "windows"))
    assert as_set(got, "window_id", "event_id") == as_set(want, "window_id", "event_id")
    sizes = window_sizes(want, complete_windows(kept, "app_us", W, progress))
    got_sizes = spark.read.parquet(str(tmp_path / "out" / "sizes"))
    assert as_set(got_sizes, "window_id", "n_points") == as_set(sizes, "window_id", "n_points")


def test_maintained_view_and_feedback(spark, staged, tmp_path):
    rows, path = staged
    view = SkylineView(str(tmp_path / "view"), DIMS)
    split = FeedbackSplit(0.9)
    alphas, last = [], []

    def each(batch, batch_id):
        view.process(batch.select("event_id", *DIMS), batch_id)
        planned = split.plan(batch, "gen_us", W)
        assert planned.agg(F.sum("n_rows")).first()[0] == batch.count()
        alphas.append(split.alpha)
        last.append(batch_id)

    q = (replay_stream(spark, path, rows.schema).writeStream.foreachBatch(each)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = view.read(spark, max(last))
    assert as_set(got, "event_id") == as_set(skyline(rows.select("event_id", *DIMS), DIMS), "event_id")
    assert len(set(alphas)) > 1


def test_watermark_baseline_and_ingest(spark, staged, tmp_path):
    rows, path = staged
    panes = ingest(replay_stream(spark, path, rows.schema), DIMS, "app_us", "gen_us", W)
    assert panes.isStreaming and "pane_id" in panes.columns
    timed = replay_stream(spark, path, rows.schema).withColumn("at", F.timestamp_micros("gen_us"))
    counted = (disorder.watermark_baseline(timed, "at", "1 hour").groupBy(F.window("at", "12 hours", "4 hours"))
               .agg(F.count("*").alias("n")))
    got = run(counted, tmp_path, "baseline")
    assert got.count() > 0


def test_drained_streams_go_on_after_a_restart(spark, tmp_path):
    """What was drained before a restart is neither read nor written again."""
    rows = stream_rows(spark, DATA).select("event_id", "app_us", "gen_us", *DIMS)
    cut = rows.agg(F.percentile_approx("gen_us", 0.5)).first()[0]
    path = str(tmp_path / "rows")
    places = [(str(tmp_path / f"out{i}"), str(tmp_path / f"ck{i}")) for i in (0, 1)]
    for part in (rows.filter(F.col("gen_us") <= cut), rows.filter(F.col("gen_us") > cut)):
        stage_replay(part, path, ORDER, 300)
        stream = replay_stream(spark, path, rows.schema)
        appended, numbered = drained(stream, *places[0]), drained_by_batch(stream, *places[1])
    assert as_set(appended, "event_id", "app_us") == as_set(rows, "event_id", "app_us")
    assert as_set(numbered, "event_id", "app_us") == as_set(rows, "event_id", "app_us")
    ends = sorted((r["batch"], r["lo"], r["hi"]) for r in numbered.groupBy("batch").agg(F.min("gen_us").alias("lo"), F.max("gen_us").alias("hi")).collect())
    assert len(ends) >= 4 and all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))
    assert drained(replay_stream(spark, path, rows.schema), *places[0]).count() == rows.count()


def test_slices_are_staged_by_few_jobs_and_keep_little_state(spark, tmp_path):
    rows = stream_rows(spark, DATA).select("event_id", "gen_us")
    path, sink, checkpoint = (str(tmp_path / n) for n in ("rows", "out", "ck"))
    sc = spark.sparkContext
    sc.setJobGroup("staging", "staging")
    n = stage_replay(rows, path, ORDER, 20)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert n == -(-rows.count() // 20) and len(sc.statusTracker().getJobIdsForGroup("staging")) < 15 < n
    files = sorted((tmp_path / "rows").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).agg(F.min("gen_us"), F.max("gen_us"), F.count("*")).first() for f in files[:5] + files[-2:]]
    assert all(a[1] <= b[0] and a[2] == 20 for a, b in zip(spans, spans[1:]))
    stream = replay_stream(spark, path, rows.schema, 30).withColumn("at", F.timestamp_micros("gen_us"))
    days = disorder.watermark_baseline(stream, "at", "1 day").groupBy(F.window("at", "1 day")).agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert drained(days, sink, checkpoint, state_partitions=1).count() > 0
    assert [p.name for p in (tmp_path / "ck/state/0").iterdir() if p.name.isdigit()] == ["0"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_local_logs_start_no_processes(spark, staged, tmp_path):
    """While a stream drains into a local folder its logs are written by the file system; a way of one's own is kept."""
    rows, path = staged
    name, before = drain._MANAGER, spark.conf.get(drain._MANAGER, None)
    used = []

    def look(batch, number):
        used.append(batch.sparkSession.conf.get(name, None))

    for own in (None, "org.apache.spark.sql.execution.streaming.checkpointing.FileContextBasedCheckpointFileManager"):
        if own:
            spark.conf.set(name, own)
        try:
            stream = replay_stream(spark, path, rows.schema, files_per_trigger=1000)
            drain._run(spark, stream.writeStream.foreachBatch(look), str(tmp_path / f"ck{own}"))
            assert used.pop() == (own or drain._BY_FILE_SYSTEM) and not used
            assert spark.conf.get(name, None) == (own or before)
        finally:
            if own:
                spark.conf.unset(name)
