"""Registered queries on boxes, points and segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyquill.functions import geometry as g
from skyquill.operators import packing, spatial
from skyquill.operators.knn import array_of, knn
from skyquill.plans.tables import BOXES, QUERY_BOXES, SEGMENTS, boxes, micros, query_boxes, segments, table
from skyquill.sources.oplogs import bulk_entries

LOW, HIGH = ["x_lo", "y_lo"], ["x_hi", "y_hi"]
OBJECT = lambda: g.box(LOW, HIGH)
QUERY = lambda: g.box(["qx_lo", "qy_lo"], ["qx_hi", "qy_hi"])
LINE = lambda: g.segment(["sx", "sy"], ["ex", "ey"])
PAIR = ["query_id", "vec_id"]

_MEET = "x_lo <= qx_hi AND x_hi >= qx_lo AND y_lo <= qy_hi AND y_hi >= qy_lo"
_INSIDE = "qx_lo <= x_lo AND x_hi <= qx_hi AND qy_lo <= y_lo AND y_hi <= qy_hi"


def range_join(spark, sf_dir):
    return spatial.range_join(boxes(spark, sf_dir), query_boxes(spark, sf_dir), OBJECT(), QUERY()).select(*PAIR)


def range_join_hot_cells(spark, sf_dir):
    """The path of cells too full for one task, by a small bound."""
    return spatial.range_join(boxes(spark, sf_dir), query_boxes(spark, sf_dir), OBJECT(), QUERY(), hot_rows=10).select(*PAIR)


def range_counts(spark, sf_dir):
    return spatial.result_counts(range_join(spark, sf_dir), "query_id")


def range_ids(spark, sf_dir):
    return spatial.result_ids(range_join(spark, sf_dir), "vec_id").distinct()


def containment_join(spark, sf_dir):
    return spatial.containment_join(boxes(spark, sf_dir), query_boxes(spark, sf_dir), OBJECT(), QUERY()).select(*PAIR)


def point_location(spark, sf_dir):
    points = query_boxes(spark, sf_dir)
    return spatial.point_location(boxes(spark, sf_dir), points, OBJECT(), g.point("qx_lo", "qy_lo")).select(*PAIR)


def order_ranges(spark, sf_dir):
    """Orders as boxes of price and day against a price and day range per customer."""
    orders = table(spark, sf_dir, "orders")
    day = ((micros(orders, "o_orderdate") - 788_918_400_000_000) / 86_400_000_000).cast("double")
    objects = orders.select("o_orderkey", F.col("o_totalprice").alias("x_lo"), day.alias("y_lo"),
                            (F.col("o_totalprice") + 100.0).alias("x_hi"), (day + 2.0).alias("y_hi"))
    asked = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") * 45.0).alias("qx_lo"), (F.col("c_nationkey") * 90.0).alias("qy_lo"),
        (F.col("c_acctbal") * 45.0 + 5000.0).alias("qx_hi"), (F.col("c_nationkey") * 90.0 + 120.0).alias("qy_hi"))
    return spatial.range_join(objects, asked, OBJECT(), QUERY()).groupBy("c_custkey").agg(
        F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_order"))


_ORDER_RANGES = f"""WITH o AS (SELECT o_orderkey, o_totalprice AS x_lo, o_totalprice + 100 AS x_hi,
  ((epoch_us(o_orderdate) - 788918400000000) / 86400000000)::DOUBLE AS y_lo,
  ((epoch_us(o_orderdate) - 788918400000000) / 86400000000)::DOUBLE + 2 AS y_hi FROM orders),
c AS (SELECT c_custkey, c_acctbal * 45.0::DOUBLE AS qx_lo, c_nationkey * 90.0::DOUBLE AS qy_lo,
  c_acctbal * 45.0::DOUBLE + 5000 AS qx_hi, c_nationkey * 90.0::DOUBLE + 120 AS qy_hi FROM customer)
SELECT c_custkey, count(*) AS n_orders, min(o_orderkey) AS first_order FROM o JOIN c ON {_MEET} GROUP BY 1"""


def box_filter(spark, sf_dir):
    return spatial.in_box(boxes(spark, sf_dir), OBJECT(), g.box([-0.1, -0.1], [0.1, 0.1]))


def segment_join(spark, sf_dir):
    return spatial.segment_join(boxes(spark, sf_dir), segments(spark, sf_dir), OBJECT(), LINE()).select("segment_id", "vec_id")


def _orient(a, b, c):
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({c}x - {a}x) * ({b}y - {a}y))"


_SIDES = """WITH {boxes}, {segments}, corners AS (
  SELECT vec_id, x_lo, y_lo, x_hi, y_hi, unnest([
    {{'cx': x_lo, 'cy': y_lo, 'dx': x_lo, 'dy': y_hi}}, {{'cx': x_lo, 'cy': y_hi, 'dx': x_hi, 'dy': y_hi}},
    {{'cx': x_hi, 'cy': y_hi, 'dx': x_hi, 'dy': y_lo}}, {{'cx': x_hi, 'cy': y_lo, 'dx': x_lo, 'dy': y_lo}}]) AS s FROM bx),
sides AS (SELECT vec_id, x_lo, y_lo, x_hi, y_hi, s.cx AS cx, s.cy AS cy, s.dx AS dx, s.dy AS dy FROM corners)
SELECT DISTINCT segment_id, vec_id FROM sg, sides WHERE
  (sx BETWEEN x_lo AND x_hi AND sy BETWEEN y_lo AND y_hi) OR (ex BETWEEN x_lo AND x_hi AND ey BETWEEN y_lo AND y_hi)
  OR (sign({o1}) * sign({o2}) <= 0 AND sign({o3}) * sign({o4}) <= 0
      AND least(sx, ex) <= greatest(cx, dx) AND least(cx, dx) <= greatest(sx, ex)
      AND least(sy, ey) <= greatest(cy, dy) AND least(cy, dy) <= greatest(sy, ey))"""
_SEGMENTS = _SIDES.format(boxes=BOXES, segments=SEGMENTS, o1=_orient("s", "e", "c"), o2=_orient("s", "e", "d"),
                          o3=_orient("c", "d", "s"), o4=_orient("c", "d", "e"))


def self_join(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("vec_id", *LOW, *HIGH)
    return spatial.self_join(rows, "vec_id", LOW, HIGH, g.box([-0.2, -0.2], [0.2, 0.2])).select("vec_id_a", "vec_id_b")


_SELF = f"""WITH {BOXES}, w AS (SELECT * FROM bx WHERE x_lo <= 0.2 AND x_hi >= -0.2 AND y_lo <= 0.2 AND y_hi >= -0.2)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM w a JOIN w b ON a.vec_id <> b.vec_id
  AND a.x_lo <= b.x_hi AND a.x_hi >= b.x_lo AND a.y_lo <= b.y_hi AND a.y_hi >= b.y_lo"""


def bounds(spark, sf_dir):
    return packing.bounds(boxes(spark, sf_dir), LOW, HIGH)


def bounds_by_label(spark, sf_dir):
    return packing.bounds(boxes(spark, sf_dir), LOW, HIGH, ["label"])


_BOUNDS = "min(x_lo) AS x_lo, min(y_lo) AS y_lo, max(x_hi) AS x_hi, max(y_hi) AS y_hi FROM bx"


def _tiles(spark, sf_dir):
    return packing.pack_tiles(boxes(spark, sf_dir), LOW, HIGH, 16, ["vec_id"])


def pack_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir).select("vec_id", "tile_id")


def tile_report(spark, sf_dir):
    return packing.tile_report(_tiles(spark, sf_dir), "vec_id", LOW, HIGH).withColumn(
        "ids", F.concat_ws(",", F.col("ids").cast("array<string>")))


_TILES = f"""WITH {BOXES}, n AS (SELECT CAST(ceil(sqrt(ceil(count(*) / 16))) AS BIGINT) AS s FROM bx),
a AS (SELECT *, (row_number() OVER (ORDER BY x_lo + x_hi, vec_id) - 1) // ((SELECT s FROM n) * 16) AS slice FROM bx),
t AS (SELECT *, (row_number() OVER (ORDER BY slice, y_lo + y_hi, vec_id) - 1) // 16 AS tile_id FROM a)"""
_REPORT = _TILES + """ SELECT tile_id, count(*) AS n_rows, min(x_lo) AS x_lo, min(y_lo) AS y_lo, max(x_hi) AS x_hi,
  max(y_hi) AS y_hi, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids FROM t GROUP BY tile_id"""


def knn_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = knn(e.select("vec_id", "embedding"), asked, 5, "query_id", F.col("embedding"), F.col("q"))
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


_KNN_VECTORS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, x.vec_id, list_distance(q.v, x.v) AS distance FROM e q, e x),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY distance) AS place FROM d)
SELECT query_id, vec_id, round(distance, 6) AS distance FROM r WHERE place <= 5"""


def _part_grid(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("y"))


def _asked_grid(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("qx"), F.floor(F.abs("s_acctbal") / 100).cast("double").alias("qy"))


def knn_ties(spark, sf_dir):
    """Integer coordinates, so many rows tie at the k-th distance."""
    found = knn(_part_grid(spark, sf_dir), _asked_grid(spark, sf_dir), 4, "s_suppkey", array_of("x", "y"), array_of("qx", "qy"))
    return found.select("s_suppkey", "p_partkey", F.round("distance", 6).alias("distance"))


def knn_ties_in_groups(spark, sf_dir):
    """The path of cells too full for one task, by a small bound."""
    found = knn(_part_grid(spark, sf_dir), _asked_grid(spark, sf_dir), 4, "s_suppkey", array_of("x", "y"), array_of("qx", "qy"), hot_rows=10)
    return found.select("s_suppkey", "p_partkey", F.round("distance", 6).alias("distance"))


_GRID = """p AS (SELECT p_partkey, p_size::DOUBLE AS x, floor(p_retailprice / 10) AS y FROM part),
q AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS qx, floor(abs(s_acctbal) / 100) AS qy FROM supplier)"""
_KNN = """, d AS (SELECT {qid}, {oid}, {dist} AS distance FROM {src}),
r AS (SELECT *, rank() OVER (PARTITION BY {qid} ORDER BY distance) AS place FROM d)
SELECT {qid}, {oid}, round(distance, 6) AS distance FROM r WHERE place <= {k}"""


def _manhattan(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.abs(data[None, :, :, 0] - queries[:, None, :, 0]).sum(axis=2)


def knn_custom_distance(spark, sf_dir):
    """A metric of one's own, with blocks small enough that most are left out."""
    found = knn(_part_grid(spark, sf_dir), _asked_grid(spark, sf_dir), 3, "s_suppkey", array_of("x", "y"), array_of("qx", "qy"),
                distance=_manhattan, metric=True, block_rows=100)
    return found.select("s_suppkey", "p_partkey", F.round("distance", 6).alias("distance"))


def knn_any_distance(spark, sf_dir):
    """A distance that need not be a metric: everything is compared."""
    found = knn(_part_grid(spark, sf_dir), _asked_grid(spark, sf_dir), 3, "s_suppkey", array_of("x", "y"), array_of("qx", "qy"),
                distance=lambda data, queries: _manhattan(data, queries) ** 2)
    return found.select("s_suppkey", "p_partkey", F.round("distance", 6).alias("distance"))


def knn_boxes(spark, sf_dir):
    found = knn(boxes(spark, sf_dir).select("vec_id", *LOW, *HIGH), query_boxes(spark, sf_dir), 3, "query_id",
                array_of(*LOW), array_of("qx_lo", "qy_lo"), array_of(*HIGH), array_of("qx_hi", "qy_hi"))
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


_GAP = """sqrt(pow(greatest(x_lo - qx_hi, qx_lo - x_hi, 0), 2) + pow(greatest(y_lo - qy_hi, qy_lo - y_hi, 0), 2))"""


def _paired(spark, sf_dir):
    """Every box next to the query box of the same vector."""
    b = boxes(spark, sf_dir)
    q = query_boxes(spark, sf_dir)
    return b.join(q, b.vec_id == q.query_id)


def box_measures(spark, sf_dir):
    a, b = OBJECT(), QUERY()
    cx, cy = g.center(a)
    widened = g.box(["x_lo", "y_lo"], [F.col("x_hi") + F.col("vec_id") % 2, F.col("y_hi")])
    r = lambda c: F.round(c, 9)
    return _paired(spark, sf_dir).select(
        "vec_id", r(g.area(a)).alias("area"), r(g.margin(a)).alias("margin"), r(cx).alias("cx"), r(cy).alias("cy"),
        r(g.min_distance(a, b)).alias("distance"), r(g.min_distance(a, g.point("qx_lo", "qy_lo"))).alias("point_distance"),
        r(g.min_distance(g.point("x_lo", "y_lo"), g.point("qx_lo", "qy_lo"))).alias("points_distance"),
        r(g.intersection_area(a, b)).alias("common_area"),
        g.intersects(a, b).alias("meets"), g.same_segment(
            g.segment(LOW, HIGH), g.segment(LOW, [F.col("x_hi"), F.col("y_hi") + F.col("vec_id") % 3])).alias("same_ends"), g.contains(b, a).alias("inside"), g.same_shape(a, widened).alias("same"),
        r(g.area(g.union_box(a, b))).alias("union_area"), g.flat_area().alias("point_area"))


_MEASURES = f"""WITH {BOXES}, {QUERY_BOXES}
SELECT vec_id, round((x_hi - x_lo) * (y_hi - y_lo), 9) AS area, round(2.0::DOUBLE * ((x_hi - x_lo) + (y_hi - y_lo)), 9) AS margin,
  round((x_lo + x_hi) / 2, 9) AS cx, round((y_lo + y_hi) / 2, 9) AS cy, round({_GAP}, 9) AS distance,
  round(sqrt(pow(greatest(x_lo - qx_lo, qx_lo - x_hi, 0), 2) + pow(greatest(y_lo - qy_lo, qy_lo - y_hi, 0), 2)), 9) AS point_distance,
  round(sqrt(pow(x_lo - qx_lo, 2) + pow(y_lo - qy_lo, 2)), 9) AS points_distance,
  round(CASE WHEN {_MEET} THEN (least(x_hi, qx_hi) - greatest(x_lo, qx_lo)) * (least(y_hi, qy_hi) - greatest(y_lo, qy_lo)) ELSE 0 END, 9) AS common_area,
  ({_MEET}) AS meets, ({_INSIDE}) AS inside, vec_id % 2 = 0 AS same,
  round((greatest(x_hi, qx_hi) - least(x_lo, qx_lo)) * (greatest(y_hi, qy_hi) - least(y_lo, qy_lo)), 9) AS union_area,
  0.0::DOUBLE AS point_area, vec_id % 3 = 0 AS same_ends
FROM bx JOIN qb ON vec_id = query_id"""


def _touching(spark, sf_dir):
    """Parts as unit squares on an integer grid, next to the square of the following size."""
    p = _part_grid(spark, sf_dir)
    return p.withColumns({"qx": F.col("p_partkey") % 50, "qy": F.floor(F.col("p_partkey") / 20) % 10 + 90})


def touch_predicates(spark, sf_dir):
    x, y, qx, qy = (F.col(c).cast("double") for c in ("x", "y", "qx", "qy"))
    a = g.box([x, y], [x + 1, y + 1])
    b = g.box([qx, qy], [qx + 1, qy + 1])
    return _touching(spark, sf_dir).select(
        "p_partkey", g.touches(a, b).alias("boxes"), g.touches_point(a, g.point(qx, qy)).alias("box_point"),
        g.same_shape(g.point(x, y), g.point(qx, qy)).alias("points"))


_TOUCH = """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, floor(p_retailprice / 10) AS y,
  (p_partkey % 50)::DOUBLE AS qx, (p_partkey // 20 % 10 + 90)::DOUBLE AS qy FROM part)
SELECT p_partkey, x <= qx + 1 AND qx <= x + 1 AND y <= qy + 1 AND qy <= y + 1 AND (abs(x - qx) = 1 OR abs(y - qy) = 1) AS boxes,
  (qx = x OR qx = x + 1 OR qy = y OR qy = y + 1) AS box_point, (x = qx AND y = qy) AS points FROM p"""


def line_measures(spark, sf_dir):
    s, q = LINE(), QUERY()
    at = g.point("qx_hi", "qy_lo").low
    mid = g.segment_center(s)
    b = g.segment_box(s)
    r = lambda c: F.round(c, 9)
    sg = segments(spark, sf_dir)
    rows = sg.withColumn("kind", F.lit("slanted")).unionAll(
        sg.withColumns({"ex": F.col("sx"), "kind": F.lit("vertical")})).unionAll(
        sg.withColumns({"ey": F.col("sy"), "kind": F.lit("horizontal")}))
    asked = query_boxes(spark, sf_dir)
    beyond = g.point(F.col("sx") - (F.col("ex") - F.col("sx")), F.col("sy") - (F.col("ey") - F.col("sy"))).low
    return rows.join(asked, rows.segment_id == asked.query_id).select(
        "segment_id", "kind", r(g.line_distance(s, at)).alias("distance"), r(g.signed_line_distance(s, at)).alias("signed"),
        r(g.max_line_distance(s, q)).alias("corner_max"), r(g.perpendicular_angle(s)).alias("angle"),
        r(g.double_area(s.start, s.end, at)).alias("double_area"), g.left_of(s.start, s.end, at).alias("is_left"),
        g.collinear(s.start, s.end, at).alias("on_line"), g.between(s.start, s.end, mid).alias("mid_between"), g.between(s.start, s.end, beyond).alias("beyond_between"),
        r(mid[0]).alias("mx"), r(mid[1]).alias("my"), b.low[0].alias("bx_lo"), b.high[1].alias("by_hi"),
        g.segments_intersect(s, g.segment(["qx_lo", "qy_hi"], ["qx_hi", "qy_lo"])).alias("crosses"))


def _signed(px, py):
    return f"(((sx - {px}) * (ey - sy) - (ex - sx) * (sy - {py})) / sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)))"


_AT = "((ex - sx) * (qy_lo - sy) - (qx_hi - sx) * (ey - sy))"
_OTHER = "((ex - sx) * (qy_hi - sy) - (qx_lo - sx) * (ey - sy))"
_FALLING = [f"((qx_hi - qx_lo) * ({p}y - qy_hi) - ({p}x - qx_lo) * (qy_lo - qy_hi))" for p in "se"]
_LINES = f"""WITH {SEGMENTS}, {QUERY_BOXES}, ln AS (
  SELECT segment_id, 'slanted' AS kind, sx, sy, ex, ey FROM sg
  UNION ALL SELECT segment_id, 'vertical', sx, sy, sx, ey FROM sg
  UNION ALL SELECT segment_id, 'horizontal', sx, sy, ex, sy FROM sg)
SELECT segment_id, kind, round(abs({_signed('qx_hi', 'qy_lo')}), 9) AS distance, round({_signed('qx_hi', 'qy_lo')}, 9) AS signed,
  round(greatest({_signed('qx_lo', 'qy_lo')}, {_signed('qx_lo', 'qy_hi')}, {_signed('qx_hi', 'qy_hi')}, {_signed('qx_hi', 'qy_lo')}), 9) AS corner_max,
  round(CASE WHEN ex = sx THEN 0.0 WHEN ey = sy THEN pi() / 2 ELSE atan(-(sx - ex) / (sy - ey)) END, 9) AS angle, round({_AT}, 9) AS double_area,
  {_AT} > 0 AS is_left, {_AT} = 0 AS on_line, (ex - sx) * ((sy + ey) / 2 - sy) - ((sx + ex) / 2 - sx) * (ey - sy) = 0 AS mid_between, FALSE AS beyond_between,
  round((sx + ex) / 2, 9) AS mx, round((sy + ey) / 2, 9) AS my, least(sx, ex) AS bx_lo, greatest(sy, ey) AS by_hi,
  ({_AT} > 0) <> ({_OTHER} > 0) AND ({_FALLING[0]} > 0) <> ({_FALLING[1]} > 0) AS crosses
FROM ln JOIN qb ON segment_id = query_id"""


def bulk_feed(spark, sf_dir):
    entries = bulk_entries(boxes(spark, sf_dir).withColumn("note", F.col("label").cast("string")), "vec_id", LOW, HIGH, "note")
    return entries.select("id", F.col("low")[0].alias("x_lo"), F.col("high")[1].alias("y_hi"), F.hex("payload").alias("payload"))


QUERIES = {
    "range_join": (range_join, f"WITH {BOXES}, {QUERY_BOXES} SELECT query_id, vec_id FROM bx JOIN qb ON {_MEET}"),
    "range_join_hot_cells": (range_join_hot_cells, f"WITH {BOXES}, {QUERY_BOXES} SELECT query_id, vec_id FROM bx JOIN qb ON {_MEET}"),
    "range_counts": (range_counts, f"WITH {BOXES}, {QUERY_BOXES} SELECT query_id, count(*) AS n_matches FROM bx JOIN qb ON {_MEET} GROUP BY 1"),
    "range_ids": (range_ids, f"WITH {BOXES}, {QUERY_BOXES} SELECT DISTINCT vec_id FROM bx JOIN qb ON {_MEET}"),
    "containment_join": (containment_join, f"WITH {BOXES}, {QUERY_BOXES} SELECT query_id, vec_id FROM bx JOIN qb ON {_INSIDE}"),
    "point_location": (point_location, f"""WITH {BOXES}, {QUERY_BOXES} SELECT query_id, vec_id FROM bx JOIN qb
  ON qx_lo BETWEEN x_lo AND x_hi AND qy_lo BETWEEN y_lo AND y_hi"""),
    "order_ranges": (order_ranges, _ORDER_RANGES),
    "box_filter": (box_filter, f"WITH {BOXES} SELECT * FROM bx WHERE x_lo <= 0.1 AND x_hi >= -0.1 AND y_lo <= 0.1 AND y_hi >= -0.1"),
    "segment_join": (segment_join, _SEGMENTS),
    "self_join": (self_join, _SELF),
    "bounds": (bounds, f"WITH {BOXES} SELECT {_BOUNDS}"),
    "bounds_by_label": (bounds_by_label, f"WITH {BOXES} SELECT label, {_BOUNDS} GROUP BY label"),
    "pack_tiles": (pack_tiles, _TILES + " SELECT vec_id, tile_id FROM t"),
    "tile_report": (tile_report, _REPORT),
    "knn_vectors": (knn_vectors, _KNN_VECTORS),
    "knn_ties": (knn_ties, f"WITH {_GRID}" + _KNN.format(
        qid="s_suppkey", oid="p_partkey", dist="sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))", src="p, q", k=4)),
    "knn_ties_in_groups": (knn_ties_in_groups, f"WITH {_GRID}" + _KNN.format(
        qid="s_suppkey", oid="p_partkey", dist="sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))", src="p, q", k=4)),
    "knn_custom_distance": (knn_custom_distance, f"WITH {_GRID}" + _KNN.format(
        qid="s_suppkey", oid="p_partkey", dist="abs(x - qx) + abs(y - qy)", src="p, q", k=3)),
    "knn_any_distance": (knn_any_distance, f"WITH {_GRID}" + _KNN.format(
        qid="s_suppkey", oid="p_partkey", dist="pow(abs(x - qx) + abs(y - qy), 2)", src="p, q", k=3)),
    "knn_boxes": (knn_boxes, f"WITH {BOXES}, {QUERY_BOXES}" + _KNN.format(
        qid="query_id", oid="vec_id", dist=_GAP, src="bx, qb", k=3)),
    "box_measures": (box_measures, _MEASURES),
    "touch_predicates": (touch_predicates, _TOUCH),
    "line_measures": (line_measures, _LINES),
    "bulk_feed": (bulk_feed, f"WITH {BOXES} SELECT vec_id AS id, x_lo, y_hi, hex(CAST(label AS VARCHAR)) AS payload FROM bx"),
}
