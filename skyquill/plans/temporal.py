"""Registered queries on versioned and moving boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquill.functions import geometry as g
from skyquill.functions import moving as mv
from skyquill.operators import packing, versions
from skyquill.plans.spatial import HIGH, LOW
from skyquill.plans.tables import HOUR, MOVING, MOVING_QUERIES, OP_LOG, moving_objects, moving_queries, op_log, table
from skyquill.sources import oplogs

INSERT = lambda: F.col("op") == 1
OBJECT = lambda: mv.moving_box(["x", "y"], ["xh", "yh"], ["vx", "vy"], ["vxh", "vyh"], "t0", "t1")
QUERY = lambda: mv.moving_box(["qx", "qy"], ["qxh", "qyh"], ["qvx", "qvy"], ["qvxh", "qvyh"], "qt0", "qt1")
PAIR = ["query_id", "vec_id"]


def current_state(spark, sf_dir):
    return versions.current_state(op_log(spark, sf_dir), "id", ["seq"], INSERT())


_STATE = f"""WITH {OP_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM lg)
SELECT seq, id, t, op, x_lo, y_lo, x_hi, y_hi FROM r WHERE n = 1 AND op = 1"""


def _history(spark, sf_dir):
    return versions.version_history(op_log(spark, sf_dir), "id", "t", ["seq"], INSERT())


def version_history(spark, sf_dir):
    rows = _history(spark, sf_dir)
    return rows.select("id", "seq", "valid_from", F.when(F.col("valid_to") < float("inf"), F.col("valid_to")).alias("valid_to"))


_HISTORY = f"""{OP_LOG}, vh AS (
  SELECT *, t::DOUBLE AS valid_from, lead(t) OVER (PARTITION BY id ORDER BY t, seq)::DOUBLE AS valid_to FROM lg QUALIFY op = 1)"""


def _asked(spark, sf_dir):
    """A value range and a day for every customer."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.abs("c_acctbal") / 40).alias("qx_lo"), (F.col("c_nationkey") * 4.0).alias("qy_lo"),
        (F.abs("c_acctbal") / 40 + 10.0).alias("qx_hi"), (F.col("c_nationkey") * 4.0 + 6.0).alias("qy_hi"),
        ((F.col("c_custkey") % 29) * 24.0 * HOUR).alias("q_start"), ((F.col("c_custkey") % 29) * 24.0 * HOUR + 6.0 * HOUR).alias("q_end"))


_ASKED = f"""qa AS (SELECT c_custkey, abs(c_acctbal) / 40 AS qx_lo, c_nationkey * 4.0::DOUBLE AS qy_lo,
  abs(c_acctbal) / 40 + 10 AS qx_hi, c_nationkey * 4.0::DOUBLE + 6 AS qy_hi,
  (c_custkey % 29) * {24 * HOUR}::DOUBLE AS q_start, (c_custkey % 29) * {24 * HOUR}::DOUBLE + {6 * HOUR} AS q_end FROM customer)"""
_IN_TIME = "valid_from < q_end AND q_start < coalesce(valid_to, 'infinity'::DOUBLE)"
_MEET = "x_lo <= qx_hi AND x_hi >= qx_lo AND y_lo <= qy_hi AND y_hi >= qy_lo"


def _versioned(spark, sf_dir, query=None, **options):
    return versions.versioned_join(
        _history(spark, sf_dir), _asked(spark, sf_dir), g.box(LOW, HIGH), mv.interval("valid_from", "valid_to"),
        query or g.box(["qx_lo", "qy_lo"], ["qx_hi", "qy_hi"]), mv.interval("q_start", "q_end"), "id", "c_custkey", **options)


def versioned_range(spark, sf_dir):
    return _versioned(spark, sf_dir).select("c_custkey", "id")


def versioned_range_all(spark, sf_dir):
    return _versioned(spark, sf_dir, all_versions=True).select("c_custkey", "id", "seq")


def versioned_contained(spark, sf_dir):
    return _versioned(spark, sf_dir, inside=True).select("c_custkey", "id")


def versioned_points(spark, sf_dir):
    return _versioned(spark, sf_dir, g.point("qx_lo", "qy_lo")).select("c_custkey", "id")


def _versioned_sql(condition, columns="DISTINCT c_custkey, id"):
    return f"WITH {_HISTORY}, {_ASKED} SELECT {columns} FROM vh JOIN qa ON {_IN_TIME} AND {condition}"


def versioned_bounds(spark, sf_dir):
    return packing.versioned_bounds(_history(spark, sf_dir), LOW, HIGH, "valid_from", "valid_to", ["id"])


_VERSIONED_BOUNDS = f"""WITH {_HISTORY} SELECT id, min(x_lo) AS x_lo, min(y_lo) AS y_lo, min(valid_from) AS valid_from,
  max(x_hi) AS x_hi, max(y_hi) AS y_hi, max(coalesce(valid_to, 'infinity'::DOUBLE)) AS valid_to FROM vh GROUP BY id"""


def interval_predicates(spark, sf_dir):
    """Each version against the first ten days."""
    valid, period = mv.interval("valid_from", "valid_to"), mv.interval(0.0, 240.0 * HOUR)
    a, b = g.box(LOW, HIGH), g.box([0.0, 0.0], [30.0, 30.0])
    return _history(spark, sf_dir).select(
        "seq", mv.overlaps(valid, period).alias("overlaps"), mv.covers(period, valid).alias("covered"),
        mv.intersects_in_time(a, valid, b, period).alias("meets"), mv.contains_in_time(b, period, a, valid).alias("inside"),
        mv.touches_in_time(a, valid, b, period).alias("touching"), mv.touches_point_in_time(a, valid, g.point(5.0, 7.0), period).alias("touching_point"),
        mv.same_version(a, valid, a, mv.interval("valid_from", F.col("valid_to") + F.col("seq") % 2)).alias("same"))


_T = 240 * HOUR
_PREDICATES = f"""WITH {_HISTORY}, o AS (SELECT *, valid_from < {_T} AND 0 < coalesce(valid_to, 'infinity'::DOUBLE) AS ov FROM vh)
SELECT seq, ov AS overlaps, coalesce(valid_to, 'infinity'::DOUBLE) <= {_T} AS covered, ov AND x_lo <= 30 AND y_lo <= 30 AND x_hi >= 0 AND y_hi >= 0 AS meets,
  ov AND x_lo >= 0 AND y_lo >= 0 AND x_hi <= 30 AND y_hi <= 30 AS inside,
  ov AND x_lo <= 30 AND y_lo <= 30 AND x_hi >= 0 AND y_hi >= 0 AND (x_lo = 30 OR y_lo = 30 OR x_hi = 0 OR y_hi = 0) AS touching,
  ov AND (x_lo = 5 OR x_hi = 5 OR y_lo = 7 OR y_hi = 7) AS touching_point, seq % 2 = 0 OR valid_to IS NULL AS same FROM o"""


# operation logs as lines -----------------------------------------------------

def _log_lines(spark, sf_dir, *fields):
    """Every tenth operation asks instead of changing."""
    rows = op_log(spark, sf_dir).withColumn("op", F.when(F.col("seq") % 10 == 0, 2).otherwise(F.col("op")))
    return rows.select("seq", F.concat_ws(" ", *[F.col(f) if isinstance(f, str) else f for f in fields]).alias("value"))


def box_log(spark, sf_dir):
    return oplogs.box_log(_log_lines(spark, sf_dir, "op", "id", "x_hi", "y_lo", "x_lo", "y_hi"))


def versioned_log(spark, sf_dir):
    asked = [F.when(F.col("op") == 2, F.col("t") + d) for d in (0, 5)]
    return oplogs.versioned_log(_log_lines(spark, sf_dir, "t", "op", "id", "x_lo", "y_lo", "x_hi", "y_hi", *asked))


def moving_log(spark, sf_dir):
    zero = F.lit("0")
    return oplogs.moving_log(_log_lines(spark, sf_dir, "id", "op", "t", F.col("t") + 7, zero, "x_lo", "x_hi", zero, "y_lo", "y_hi"))


_LOGGED = f"WITH {OP_LOG}, lq AS (SELECT * REPLACE (CASE WHEN seq % 10 = 0 THEN 2 ELSE op END AS op) FROM lg)"


# moving boxes ---------------------------------------------------------------

def moving_state(spark, sf_dir):
    """Last reported motion per user: an insert replaces position, velocity and reference time."""
    log = op_log(spark, sf_dir).select("seq", "id", "t", "op", F.col("x_lo").alias("ax"), F.col("y_lo").alias("ay"),
                                       (F.col("x_lo") / 100).alias("vx"), (F.col("y_lo") / 100).alias("vy"))
    return versions.current_state(log, "id", ["seq"], INSERT())


_MOVING_STATE = f"""WITH {OP_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM lg)
SELECT seq, id, t, op, x_lo AS ax, y_lo AS ay, x_lo / 100 AS vx, y_lo / 100 AS vy FROM r WHERE n = 1 AND op = 1"""


def moving_positions(spark, sf_dir):
    free, held = mv.box_at(OBJECT(), F.lit(12.5)), mv.box_at(OBJECT(), F.lit(5.0), clamp=True)
    r = lambda c: F.round(c, 9)
    return moving_objects(spark, sf_dir).select(
        "vec_id", r(free.low[0]).alias("x"), r(free.high[1]).alias("yh"), r(held.low[0]).alias("held_x"), r(held.high[1]).alias("held_yh"))


_POSITIONS = f"""WITH {MOVING}, c AS (SELECT *, greatest(t0, least(5, t1)) - t0 AS dt FROM mo)
SELECT vec_id, round(x + vx * (12.5 - t0), 9) AS x, round(yh + vyh * (12.5 - t0), 9) AS yh,
  round(x + vx * dt, 9) AS held_x, round(yh + vyh * dt, 9) AS held_yh FROM c"""

# bounds on t of: object low <= query high and query low <= object high, per axis
_ROOMS = [("vx - qvxh", "(qxh - qvxh * qt0) - (x - vx * t0)"), ("vy - qvyh", "(qyh - qvyh * qt0) - (y - vy * t0)"),
          ("qvx - vxh", "(xh - vxh * t0) - (qx - qvx * qt0)"), ("qvy - vyh", "(yh - vyh * t0) - (qy - qvy * qt0)")]
_UPPER = ", ".join(f"CASE WHEN {s} > 0 THEN ({r}) / ({s}) END" for s, r in _ROOMS)
_LOWER = ", ".join(f"CASE WHEN {s} < 0 THEN ({r}) / ({s}) END" for s, r in _ROOMS)
_NEVER = " AND ".join(f"NOT ({s} = 0 AND {r} < 0)" for s, r in _ROOMS)
_MEETING = f"""pr AS (SELECT *, greatest(t0, qt0) AS a, least(t1, qt1) AS b FROM mo, mq),
mt AS (SELECT *, greatest(a, {_LOWER}) AS f, least(b, {_UPPER}) AS l FROM pr WHERE a < b AND {_NEVER}),
hits AS (SELECT * FROM mt WHERE f <= l AND f < b)"""
_MOVING_SQL = f"WITH {MOVING}, {MOVING_QUERIES}, {_MEETING}"


def moving_range(spark, sf_dir):
    found = versions.predictive_join(moving_objects(spark, sf_dir), moving_queries(spark, sf_dir), OBJECT(), QUERY())
    return found.select(*PAIR, F.round("meet_from", 6).alias("meet_from"), F.round("meet_to", 6).alias("meet_to"))


def _held(at):
    low = f"x + vx * ({at} - t0) >= qx + qvx * ({at} - qt0) AND y + vy * ({at} - t0) >= qy + qvy * ({at} - qt0)"
    return low + f" AND xh + vxh * ({at} - t0) <= qxh + qvxh * ({at} - qt0) AND yh + vyh * ({at} - t0) <= qyh + qvyh * ({at} - qt0)"


def moving_contained(spark, sf_dir):
    """Objects inside the query box for the whole common time."""
    return versions.predictive_join(moving_objects(spark, sf_dir), moving_queries(spark, sf_dir), OBJECT(), QUERY(),
                                    inside=True, over="query").select(*PAIR)


def moving_contained_always(spark, sf_dir):
    """Short-lived objects inside the query box for their whole valid time."""
    rows = moving_objects(spark, sf_dir).withColumns({"t0": F.col("t0") + 2.5, "t1": F.col("t0") + 3.5})
    return versions.predictive_join(rows, moving_queries(spark, sf_dir), OBJECT(), QUERY(), inside=True).select(*PAIR)


_ALWAYS = f"""WITH {MOVING.replace('mo AS', 'mo0 AS')}, mo AS (SELECT * REPLACE (t0 + 2.5::DOUBLE AS t0, t0 + 3.5::DOUBLE AS t1) FROM mo0),
{MOVING_QUERIES} SELECT query_id, vec_id FROM mo, mq WHERE t0 >= qt0 AND t1 <= qt1 AND {_held('t0')} AND {_held('t1')}"""


def _joined(spark, sf_dir):
    a, b = moving_objects(spark, sf_dir), moving_queries(spark, sf_dir)
    return a.join(b, a.vec_id == b.query_id)


def moving_predicates(spark, sf_dir):
    at = F.col("qt0") + 1.0
    during = mv.interval(F.col("qt0") + 0.5, F.col("qt0") + 1.5)
    p = mv.moving_point(["x", "y"], ["vx", "vy"], "t0", "t1")
    other = mv.moving_point(["x", "y"], [F.col("vx") + F.col("vec_id") % 3, F.col("vy")], "t0", "t1")
    still = mv.still_box(g.box([-0.3, -0.3], [0.3, 0.3]), 0.0, 100.0)
    return _joined(spark, sf_dir).select(
        "vec_id", mv.meets_at(OBJECT(), QUERY(), at).alias("meets_at"), mv.holds_at(still, OBJECT(), at).alias("holds_at"),
        mv.meets_in_time(OBJECT(), still, during).alias("meets_during"), mv.holds_in_time(still, p).alias("holds_point"),
        mv.meets_in_time(p, still).alias("meets_point"), mv.holds_after(still, OBJECT(), at).alias("holds_after"),
        mv.same_motion(p, other).alias("same"), mv.velocity_box(OBJECT()).high[0].alias("v_high"))


def _moving_predicates_sql():
    at = "(qt0 + 1)"
    box_at = {c: f"({c} + v{c} * ({{t}} - t0))" for c in ("x", "y")}
    high_at = {c: f"({c}h + v{c}h * ({{t}} - t0))" for c in ("x", "y")}

    def inside(t, high=True):
        hi = high_at if high else box_at
        return " AND ".join(f"{box_at[c].format(t=t)} >= -0.3 AND {hi[c].format(t=t)} <= 0.3" for c in "xy")

    def meets(t0, t1, high=True):
        # still box: low(t) <= 0.3 and high(t) >= -0.3 on both axes
        hs, vh = ("h", "h") if high else ("", "")
        rooms = []
        for c in "xy":
            rooms.append((f"v{c}", f"0.3 - ({c} - v{c} * t0)"))
            rooms.append((f"-v{c}{vh}", f"({c}{hs} - v{c}{vh} * t0) + 0.3"))
        lo = ", ".join(f"CASE WHEN {s} < 0 THEN ({r}) / ({s}) END" for s, r in rooms)
        hi = ", ".join(f"CASE WHEN {s} > 0 THEN ({r}) / ({s}) END" for s, r in rooms)
        never = " AND ".join(f"NOT ({s} = 0 AND {r} < 0)" for s, r in rooms)
        return f"({t0} < {t1} AND {never} AND greatest({t0}, {lo}) <= least({t1}, {hi}) AND greatest({t0}, {lo}) < {t1})"

    alive = f"t0 <= {at} AND {at} < t1"
    meets_query = " AND ".join(
        f"{box_at[c].format(t=at)} <= q{c}h + qv{c}h * ({at} - qt0) AND {high_at[c].format(t=at)} >= q{c} + qv{c} * ({at} - qt0)"
        for c in "xy")
    after = f"greatest(t0, {at})"
    return f"""WITH {MOVING}, {MOVING_QUERIES} SELECT vec_id,
  ({alive} AND qt0 <= {at} AND {at} < qt1 AND {meets_query}) AS meets_at, ({alive} AND {inside(at)}) AS holds_at,
  {meets('greatest(t0, qt0 + 0.5)', 'least(t1, qt0 + 1.5)')} AS meets_during,
  (t0 < t1 AND {inside('t0', False)} AND {inside('t1', False)}) AS holds_point, {meets('t0', 't1', False)} AS meets_point,
  ({after} < t1 AND {inside(after)} AND {inside('t1')}) AS holds_after, vec_id % 3 = 0 AS same, vxh AS v_high
FROM mo JOIN mq ON vec_id = query_id"""


def moving_rejects(spark, sf_dir):
    """Boxes that shrink or queries outside the horizon are set aside."""
    rows = moving_objects(spark, sf_dir).withColumn("vxh", F.col("vxh") - 0.0005)
    good, bad = versions.check_moving(rows, OBJECT())
    inside, outside = versions.check_horizon(moving_queries(spark, sf_dir), QUERY(), 3.0, 8.0)
    tag = lambda df, key, name: df.select(F.col(key).alias("id"), F.lit(name).alias("kind"))
    return (tag(good, "vec_id", "grows").unionByName(tag(bad, "vec_id", "shrinks"))
            .unionByName(tag(inside, "query_id", "in horizon")).unionByName(tag(outside, "query_id", "out of horizon")))


_REJECTS = f"""WITH {MOVING}, {MOVING_QUERIES}
SELECT vec_id AS id, CASE WHEN vx <= vxh - 0.0005::DOUBLE AND vy <= vyh THEN 'grows' ELSE 'shrinks' END AS kind FROM mo
UNION ALL SELECT query_id, CASE WHEN qt0 >= 3 AND qt1 < 11 THEN 'in horizon' ELSE 'out of horizon' END FROM mq"""


def moving_bounds(spark, sf_dir):
    b = packing.moving_bounds(moving_objects(spark, sf_dir), OBJECT(), 10.0)
    return b.select(*[F.round(c, 9).alias(c) for c in b.columns])


_MOVING_BOUNDS = f"""WITH {MOVING} SELECT round(min(x + vx * (10 - t0)), 9) AS lo0, round(max(xh + vxh * (10 - t0)), 9) AS hi0,
  round(min(vx), 9) AS v_lo0, round(max(vxh), 9) AS v_hi0, round(min(y + vy * (10 - t0)), 9) AS lo1,
  round(max(yh + vyh * (10 - t0)), 9) AS hi1, round(min(vy), 9) AS v_lo1, round(max(vyh), 9) AS v_hi1 FROM mo"""


def swept_measures(spark, sf_dir):
    during = mv.interval(F.col("t0") + 1.0, F.col("t0") + 4.0)
    line = mv.moving_box(["x"], ["xh"], ["vx"], ["vxh"], "t0", "t1")
    r = lambda c: F.round(c, 8)
    return moving_objects(spark, sf_dir).select(
        "vec_id", r(mv.swept_volume(OBJECT())).alias("volume"), r(mv.swept_volume(OBJECT(), during)).alias("volume_during"),
        r(mv.swept_volume(line)).alias("length"), r(mv.projected_surface(OBJECT())).alias("surface"))


def _area_sql(h, w0="(xh - x)", w1="(yh - y)"):
    a, b = "(vxh - vx)", "(vyh - vy)"
    return f"({h} * {w0} * {w1} + pow({h}, 2) * ({w0} * {b} + {a} * {w1}) / 2 + pow({h}, 3) * {a} * {b} / 3)"


_SWEPT = f"""WITH {MOVING}, h AS (SELECT *, t1 - t0 AS h, xh - x + (vxh - vx) AS w0, yh - y + (vyh - vy) AS w1 FROM mo)
SELECT vec_id, round({_area_sql('h')}, 8) AS volume, round({_area_sql('3', 'w0', 'w1')}, 8) AS volume_during,
  round(h * (xh - x) + h * h * (vxh - vx) / 2, 8) AS length,
  round(h * ((xh - x) + (yh - y)) + h * h * ((vxh - vx) + (vyh - vy)) / 2, 8) AS surface FROM h"""


def center_distances(spark, sf_dir):
    rows = mv.with_center_distance(_joined(spark, sf_dir), OBJECT(), QUERY(), "distance")
    return rows.select("vec_id", F.round("distance", 7).alias("distance"))


# integral of sqrt(A t^2 + B t + C) over [0, H] in its logarithmic form
_CENTERS = f"""WITH {MOVING}, {MOVING_QUERIES}, p AS (SELECT *, greatest(t0, qt0) AS s, least(t1, qt1) - greatest(t0, qt0) AS h
  FROM mo JOIN mq ON vec_id = query_id),
g AS (SELECT vec_id, h,
  (qx + qvx * (s - qt0) + qxh + qvxh * (s - qt0)) / 2 - (x + vx * (s - t0) + xh + vxh * (s - t0)) / 2 AS dx,
  (qy + qvy * (s - qt0) + qyh + qvyh * (s - qt0)) / 2 - (y + vy * (s - t0) + yh + vyh * (s - t0)) / 2 AS dy,
  (qvx + qvxh) / 2 - (vx + vxh) / 2 AS ux, (qvy + qvyh) / 2 - (vy + vyh) / 2 AS uy FROM p),
k AS (SELECT vec_id, h, ux * ux + uy * uy AS a, 2 * (dx * ux + dy * uy) AS b, dx * dx + dy * dy AS c FROM g),
f AS (SELECT *, sqrt(a * h * h + b * h + c) AS e, (4 * a * c - b * b) AS m FROM k)
SELECT vec_id, round(CASE WHEN h <= 0 THEN 0 ELSE ((2 * a * h + b) * e - b * sqrt(c)) / (4 * a)
  + m / (8 * a * sqrt(a)) * ln((2 * sqrt(a) * e + 2 * a * h + b) / (2 * sqrt(a) * sqrt(c) + b)) END, 7) AS distance FROM f"""


def common_areas(spark, sf_dir):
    """Common area over time of every pair that meets."""
    found = versions.predictive_join(moving_objects(spark, sf_dir), moving_queries(spark, sf_dir), OBJECT(), QUERY())
    return mv.with_common_area(found, OBJECT(), QUERY(), "area", when=mv.interval("meet_from", "meet_to")).select(*PAIR, F.round("area", 7).alias("area"))


def _width(c, t):
    return (f"greatest(least({c}h + v{c}h * ({t} - t0), q{c}h + qv{c}h * ({t} - qt0))"
            f" - greatest({c} + v{c} * ({t} - t0), q{c} + qv{c} * ({t} - qt0)), 0)")


def _common_sql():
    cross = []
    for c in "xy":
        for s in ("", "h"):
            slope = f"(v{c}{s} - qv{c}{s})"
            t = f"((q{c}{s} - qv{c}{s} * qt0) - ({c}{s} - v{c}{s} * t0)) / {slope}"
            cross.append(f"CASE WHEN {slope} = 0 THEN f ELSE least(greatest({t}, f), l) END")
    both = lambda t: f"{_width('x', t)} * {_width('y', t)}"
    return f"""{_MOVING_SQL}, ct AS (SELECT *, unnest([f, l, {', '.join(cross)}]) AS t FROM hits),
pc AS (SELECT *, lead(t) OVER (PARTITION BY query_id, vec_id ORDER BY t) AS u FROM ct)
SELECT query_id, vec_id, round(coalesce(sum((u - t) / 6 * ({both('t')} + 4 * {both('((t + u) / 2)')} + {both('u')})), 0), 7) AS area
FROM pc GROUP BY 1, 2"""


QUERIES = {
    "box_log": (box_log, _LOGGED + " SELECT seq, op, id, x_lo, y_lo, x_hi, y_hi FROM lq"),
    "versioned_log": (versioned_log, _LOGGED + """ SELECT seq, t::DOUBLE AS t, op, id, x_lo, y_lo, x_hi, y_hi,
  CASE WHEN op = 2 THEN t::DOUBLE END AS q_start, CASE WHEN op = 2 THEN (t + 5)::DOUBLE END AS q_end FROM lq"""),
    "moving_log": (moving_log, _LOGGED + """ SELECT seq, id, op, t::DOUBLE AS ct, (t + 7)::DOUBLE AS rt,
  x_lo AS ax, x_hi AS vx, y_lo AS ay, y_hi AS vy FROM lq"""),
    "current_state": (current_state, _STATE),
    "version_history": (version_history, f"WITH {_HISTORY} SELECT id, seq, valid_from, valid_to FROM vh"),
    "versioned_range": (versioned_range, _versioned_sql(_MEET)),
    "versioned_range_all": (versioned_range_all, _versioned_sql(_MEET, "c_custkey, id, seq")),
    "versioned_contained": (versioned_contained, _versioned_sql(
        "qx_lo <= x_lo AND x_hi <= qx_hi AND qy_lo <= y_lo AND y_hi <= qy_hi")),
    "versioned_points": (versioned_points, _versioned_sql("qx_lo BETWEEN x_lo AND x_hi AND qy_lo BETWEEN y_lo AND y_hi")),
    "versioned_bounds": (versioned_bounds, _VERSIONED_BOUNDS),
    "interval_predicates": (interval_predicates, _PREDICATES),
    "moving_state": (moving_state, _MOVING_STATE),
    "moving_positions": (moving_positions, _POSITIONS),
    "moving_range": (moving_range, _MOVING_SQL + " SELECT query_id, vec_id, round(f, 6) AS meet_from, round(l, 6) AS meet_to FROM hits"),
    "moving_contained": (moving_contained, _MOVING_SQL + f" SELECT query_id, vec_id FROM pr WHERE a < b AND {_held('a')} AND {_held('b')}"),
    "moving_contained_always": (moving_contained_always, _ALWAYS),
    "moving_predicates": (moving_predicates, _moving_predicates_sql()),
    "moving_rejects": (moving_rejects, _REJECTS),
    "moving_bounds": (moving_bounds, _MOVING_BOUNDS),
    "swept_measures": (swept_measures, _SWEPT),
    "center_distances": (center_distances, _CENTERS),
    "common_areas": (common_areas, _common_sql()),
}
