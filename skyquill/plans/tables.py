"""Inputs of the registered queries, each as a DataFrame and as the SQL the oracle reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.operators.windows import micros

ORIGIN = 1_704_067_200_000_000  # 2024-01-01 in microseconds
HOUR = 3_600_000_000
MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # wall-clock timestamps are read as UTC, whatever the cluster's zone is
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tuple stream: arrival is the event's time, event time lags by up to 30 minutes."""
    events = table(spark, sf_dir, "events")
    gen = micros(events, "ts")
    return events.select(
        "event_id", "user_id", "event_type", gen.alias("gen_us"),
        (gen - (F.col("event_id") * 777767777) % 1800000000).alias("app_us"),
        F.col("value").alias("d1"), F.get_json_object("props", "$.k").cast("double").alias("d2"),
        ((F.col("event_id") * 104729) % 1000).cast("double").alias("d3"))


STREAM = """ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS gen_us,
         epoch_us(ts) - (event_id * 777767777) % 1800000000 AS app_us, value AS d1,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS d2,
         CAST((event_id * 104729) % 1000 AS DOUBLE) AS d3
  FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", e(0).alias("x_lo"), e(1).alias("y_lo"),
        (e(0) + 0.01 * (1 + F.col("label"))).alias("x_hi"), (e(1) + 0.02).alias("y_hi"))


BOXES = """bx AS (
  SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x_lo, CAST(embedding[2] AS DOUBLE) AS y_lo,
         CAST(embedding[1] AS DOUBLE) + CAST(0.01 AS DOUBLE) * (1 + label) AS x_hi,
         CAST(embedding[2] AS DOUBLE) + CAST(0.02 AS DOUBLE) AS y_hi
  FROM embeddings)"""


def query_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), e(2).alias("qx_lo"), e(3).alias("qy_lo"),
        (e(2) + 0.1).alias("qx_hi"), (e(3) + 0.1).alias("qy_hi"))


QUERY_BOXES = """qb AS (
  SELECT vec_id AS query_id, CAST(embedding[3] AS DOUBLE) AS qx_lo, CAST(embedding[4] AS DOUBLE) AS qy_lo,
         CAST(embedding[3] AS DOUBLE) + CAST(0.1 AS DOUBLE) AS qx_hi,
         CAST(embedding[4] AS DOUBLE) + CAST(0.1 AS DOUBLE) AS qy_hi
  FROM embeddings)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("segment_id"), e(0).alias("sx"), e(1).alias("sy"), e(2).alias("ex"), e(3).alias("ey"))


SEGMENTS = """sg AS (
  SELECT vec_id AS segment_id, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy,
         CAST(embedding[3] AS DOUBLE) AS ex, CAST(embedding[4] AS DOUBLE) AS ey
  FROM embeddings)"""


def moving_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving boxes: position, size by label, velocity; valid for 20 time units from the label on."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", e(0).alias("x"), e(1).alias("y"), (e(0) + 0.05).alias("xh"), (e(1) + 0.05).alias("yh"),
        (e(2) / 10).alias("vx"), (e(3) / 10).alias("vy"),
        (e(2) / 10 + F.abs(e(4)) / 100).alias("vxh"), (e(3) / 10 + F.abs(e(5)) / 100).alias("vyh"),
        F.col("label").cast("double").alias("t0"), (F.col("label") + 20).cast("double").alias("t1"))


MOVING = """mo AS (
  SELECT vec_id, x, y, x + CAST(0.05 AS DOUBLE) AS xh, y + CAST(0.05 AS DOUBLE) AS yh, vx, vy,
         vx + abs(e4) / 100 AS vxh, vy + abs(e5) / 100 AS vyh, CAST(label AS DOUBLE) AS t0,
         CAST(label + 20 AS DOUBLE) AS t1
  FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) / 10 AS vx, CAST(embedding[4] AS DOUBLE) / 10 AS vy,
               CAST(embedding[5] AS DOUBLE) AS e4, CAST(embedding[6] AS DOUBLE) AS e5
        FROM embeddings))"""


def moving_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving query boxes of side 0.2 valid for 3 time units."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), e(6).alias("qx"), e(7).alias("qy"),
        (e(6) + 0.2).alias("qxh"), (e(7) + 0.2).alias("qyh"), (e(8) / 10).alias("qvx"), (e(9) / 10).alias("qvy"),
        (e(8) / 10).alias("qvxh"), (e(9) / 10).alias("qvyh"),
        (F.col("label") + 2).cast("double").alias("qt0"), (F.col("label") + 5).cast("double").alias("qt1"))


MOVING_QUERIES = """mq AS (
  SELECT query_id, qx, qy, qx + CAST(0.2 AS DOUBLE) AS qxh, qy + CAST(0.2 AS DOUBLE) AS qyh, qvx, qvy,
         qvx AS qvxh, qvy AS qvyh, CAST(label + 2 AS DOUBLE) AS qt0, CAST(label + 5 AS DOUBLE) AS qt1
  FROM (SELECT vec_id AS query_id, label, CAST(embedding[7] AS DOUBLE) AS qx, CAST(embedding[8] AS DOUBLE) AS qy,
               CAST(embedding[9] AS DOUBLE) / 10 AS qvx, CAST(embedding[10] AS DOUBLE) / 10 AS qvy
        FROM embeddings))"""


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: a user's box changes with every event and ends with an error."""
    rows = stream_rows(spark, sf_dir)
    return rows.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("gen_us") - ORIGIN).alias("t"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"),
        F.col("d1").alias("x_lo"), F.col("d2").alias("y_lo"), (F.col("d1") + 5.0).alias("x_hi"), (F.col("d2") + 3.0).alias("y_hi"))


OP_LOG = STREAM + f""", lg AS (
  SELECT event_id AS seq, user_id AS id, gen_us - {ORIGIN} AS t, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
         d1 AS x_lo, d2 AS y_lo, d1 + 5.0::DOUBLE AS x_hi, d2 + 3.0::DOUBLE AS y_hi
  FROM ev)"""
