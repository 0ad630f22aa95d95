import numpy as np
from pyspark.sql import functions as F

from skyquill.functions import geometry as g
from skyquill.functions import moving as mv
from skyquill.operators import spatial, versions
from skyquill.operators.ordering import arrival_rank
from skyquill.sources import oplogs, sinks, tuples


def test_text_and_binary_tuples(spark, tmp_path):
    values = np.random.default_rng(17).random((500, 5)) * 1000
    values[:, 3:] = np.floor(values[:, 3:] * 1e6)
    text, binary = str(tmp_path / "t.txt"), str(tmp_path / "t.bin")
    with open(text, "w") as f:
        f.write("\n".join("  ".join(repr(float(v)) for v in row) for row in values) + "\n\n")
    values.astype("<f8").tofile(binary)
    a, b = tuples.read_tuples_text(spark, text, 3), tuples.read_tuples_binary(spark, binary, 3, chunk=64)
    assert a.schema == b.schema
    rows = sorted(tuple(r) for r in a.collect())
    assert rows == sorted(tuple(r) for r in b.collect()) == sorted((*r[:3], int(r[3]), int(r[4])) for r in values.tolist())
    tuples.write_tuples_text(a, str(tmp_path / "again"), 3)
    assert sorted(tuple(r) for r in tuples.read_tuples_text(spark, str(tmp_path / "again"), 3).collect()) == rows


def test_arrival_rank_is_dense(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") * 7919) % 100).repartition(9)
    got = [r["id"] for r in arrival_rank(df, ["g", "id"], "r").orderBy("r").collect()]
    assert got == [i for _, i in sorted(((i * 7919) % 100, i) for i in range(1000))]
    assert sorted(r["r"] for r in arrival_rank(df, ["g", "id"], "r").collect()) == list(range(1000))


def test_box_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("1 7 3 3 1 1\n1 8 5 5 6 6\n0 8 5 5 6 6\n2 99 0 0 2 2\n1 7 9 9 8 8\n")
    log = oplogs.read_box_log(spark, str(path))
    state = versions.current_state(oplogs.updates(log), "id", ["seq"], F.col("op") == oplogs.INSERT)
    assert [(r["id"], r["x_lo"], r["x_hi"]) for r in state.collect()] == [(7, 8.0, 9.0)]
    q = oplogs.queries(log).select(F.col("id").alias("qid"), *[F.col(c).alias("q" + c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")])
    hits = spatial.range_join(oplogs.inserts(log).drop("op"), q, g.box(["x_lo", "y_lo"], ["x_hi", "y_hi"]),
                              g.box(["qx_lo", "qy_lo"], ["qx_hi", "qy_hi"]))
    assert [r["x_lo"] for r in hits.collect()] == [1.0]


def test_versioned_and_moving_logs(spark, tmp_path):
    a = tmp_path / "v.txt"
    a.write_text("0 1 7 0 0 1 1\n4 0 7 0 0 1 1\n5 1 7 0 0 1 1\n6 2 1 0 0 3 3 1 3\n")
    log = oplogs.read_versioned_log(spark, str(a))
    history = versions.version_history(oplogs.updates(log), "id", "t", ["seq"], F.col("op") == oplogs.INSERT)
    assert sorted((r["valid_from"], r["valid_to"]) for r in history.collect()) == [(0.0, 4.0), (5.0, float("inf"))]
    assert [(r["q_start"], r["q_end"]) for r in oplogs.queries(log).collect()] == [(1.0, 3.0)]
    b = tmp_path / "m.txt"
    b.write_text("3 1 0 0 0 1.0 0.5 0 2.0 0.0\n4 1 0 0 0 50.0 0.0 0 2.0 0.0\n9 2 4 8 0 2.5 4.0 0 1.0 3.0\n")
    log = oplogs.read_moving_log(spark, str(b))
    objects = oplogs.inserts(log).select("id", "ax", "ay", "vx", "vy", F.col("ct").alias("start"))
    p = mv.moving_point(["ax", "ay"], ["vx", "vy"], "start", F.lit(float("inf")))
    q = mv.still_box(g.box(["x_lo", "y_lo"], ["x_hi", "y_hi"]), "t_start", "t_end")
    hit = versions.predictive_join(objects, oplogs.moving_queries(log), p, q).collect()
    assert [(r["id"], r["meet_from"], r["meet_to"]) for r in hit] == [(3, 4.0, 6.0)]


def test_sinks(spark, tmp_path):
    sizes = spark.createDataFrame([(1, 4), (0, 2)], "window_id long, n_points long")
    sinks.write_window_sizes(sizes, str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w")).orderBy("value").collect()] == [
        "Window 0 with 2 result points", "Window 1 with 4 result points"]
    latencies = spark.createDataFrame([(10, 2000), (2_000_010, 4000)], "emit_gen long, latency long")
    series = sinks.second_series(latencies)
    sinks.write_second_series(series, str(tmp_path / "s"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["0 1 2.0", "1 0 0.0", "2 1 4.0"]
    sinks.write_window_rows(sizes, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_long_prefixes_are_cut_by_rank(spark, monkeypatch):
    from skyquill.operators import ordering

    df = spark.range(300).withColumn("t", (F.col("id") * 37) % 300).repartition(7)
    short = [r["t"] for r in ordering.arrival_prefix(df, 40, ["t"]).collect()]
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 10)
    assert sorted(r["t"] for r in ordering.arrival_prefix(df, 40, ["t"]).collect()) == short == list(range(40))


def test_logs_of_several_files_follow_their_names(spark, tmp_path):
    """The later, longer file is read first by a task that packs files by size."""
    (tmp_path / "part-0.txt").write_text("1 7 0 0 1 1\n")
    (tmp_path / "part-1.txt").write_text("0 7 0 0 1 1\n" + "".join(f"1 {100 + i} 0 0 1 1\n" for i in range(2000)))
    log = oplogs.read_box_log(spark, str(tmp_path))
    assert [tuple(r) for r in log.orderBy("seq").select("seq", "op", "id").limit(3).collect()] == [(0, 1, 7), (1, 0, 7), (2, 1, 100)]
    state = versions.current_state(oplogs.updates(log), "id", ["seq"], F.col("op") == oplogs.INSERT)
    assert state.filter("id = 7").count() == 0 and state.count() == 2000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:  # blocks of one file
        assert [r["id"] for r in oplogs.read_box_log(spark, str(tmp_path)).orderBy("seq").collect()] == [7, 7, *range(100, 2100)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
