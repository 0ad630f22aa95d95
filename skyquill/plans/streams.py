"""Registered window, disorder and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquill.operators import disorder, metrics, windows as win
from skyquill.operators.windows import Windows
from skyquill.plans.preference import _COUNT3, _LT3, _beats, DIMS
from skyquill.plans.tables import HOUR, MINUTE, ORIGIN, STREAM, stream_rows
from skyquill.sources import tuples
from skyquill.sources.sinks import second_series, window_lines

DAY = Windows(24 * HOUR, 6 * HOUR, ORIGIN)
UNEVEN = Windows(5 * HOUR, 2 * HOUR, ORIGIN)
TUMBLING = Windows(12 * HOUR, 12 * HOUR, ORIGIN)
SHORT = Windows(20 * MINUTE, 5 * MINUTE, ORIGIN)
ARRIVAL = ["gen_us", "event_id"]
ROW = ["event_id", "gen_us", *DIMS]


def _rows(spark, sf_dir):
    return stream_rows(spark, sf_dir).select(*ROW)


def _disordered(spark, sf_dir):
    return stream_rows(spark, sf_dir).select("event_id", "user_id", "app_us", "gen_us", *DIMS)


def _windows_sql(w: Windows, ts="gen_us", source="ev", progress=None) -> str:
    """``rw``: rows with the complete windows they are in; ``cw``: the complete windows."""
    top = progress or f"(SELECT max({ts}) FROM {source})"
    return f"""pn AS (SELECT *, ({ts} - {w.origin}) // {w.pane} AS pane_id FROM {source} WHERE {ts} >= {w.origin}),
closed AS (SELECT ({top} - {w.origin}) // {w.pane} AS c),
ids AS (SELECT unnest(range(0, (SELECT max(pane_id) // {w.per_slide} + 1 FROM pn))) AS window_id),
members AS (SELECT window_id, unnest(range(window_id * {w.per_slide}, window_id * {w.per_slide} + {w.per_window})) AS pane_id FROM ids),
cw AS (SELECT window_id FROM members, closed GROUP BY window_id
       HAVING bool_and(pane_id < c OR pane_id IN (SELECT pane_id FROM pn))),
rw AS (SELECT pn.*, window_id FROM pn JOIN members USING (pane_id) JOIN cw USING (window_id))"""


def _sky_sql(w: Windows, columns="event_id, gen_us, d1, d2, d3", **kw) -> str:
    return f"""WITH {STREAM}, {_windows_sql(w, **kw)}, sky AS (
  SELECT {columns}, window_id FROM rw p WHERE NOT EXISTS (SELECT 1 FROM rw q WHERE {_beats('q', 'p', key='window_id')}))"""


def window_skyline_events(spark, sf_dir):
    return win.window_skyline(_rows(spark, sf_dir), DIMS, "gen_us", DAY)


def window_skyline_uneven(spark, sf_dir):
    return win.window_skyline(_rows(spark, sf_dir), DIMS, "gen_us", UNEVEN)


def window_skyline_tumbling(spark, sf_dir):
    return win.window_skyline(_rows(spark, sf_dir), DIMS, "gen_us", TUMBLING)


def pane_skyline_events(spark, sf_dir):
    return win.pane_query(_rows(spark, sf_dir), DIMS, "gen_us", UNEVEN)


_PANES = f"""WITH {STREAM}, pn AS (SELECT event_id, gen_us, d1, d2, d3, (gen_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id FROM ev)
SELECT * FROM pn p WHERE NOT EXISTS (SELECT 1 FROM pn q WHERE {_beats('q', 'p', key='pane_id')})"""


def window_skyline_by_user(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).select("user_id", *ROW)
    return win.window_skyline(rows, DIMS, "gen_us", DAY, ["user_id"])


_BY_USER = f"""WITH {STREAM}, {_windows_sql(DAY)}
SELECT user_id, event_id, gen_us, d1, d2, d3, window_id FROM rw p WHERE NOT EXISTS (
  SELECT 1 FROM rw q WHERE q.user_id = p.user_id AND {_beats('q', 'p', key='window_id')})"""


def _short(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    complete = win.complete_windows(rows, "gen_us", SHORT)
    return win.window_sizes(win.window_skyline(rows, DIMS, "gen_us", SHORT), complete)


def window_sizes_zero_filled(spark, sf_dir):
    return _short(spark, sf_dir)


_ZERO_FILLED = _sky_sql(SHORT) + """, sz AS (
  SELECT window_id, count(sky.event_id) AS n_points FROM cw LEFT JOIN sky USING (window_id) GROUP BY window_id)"""


def window_size_lines(spark, sf_dir):
    return window_lines(_short(spark, sf_dir))


def window_size_stats(spark, sf_dir):
    s = metrics.size_stats(_short(spark, sf_dir))
    return s.select("n_results", F.round("avg_size", 6).alias("avg_size"), F.round("std_size", 6).alias("std_size"))


def complete_windows(spark, sf_dir):
    return win.complete_windows(_rows(spark, sf_dir), "gen_us", SHORT)


def window_candidates(spark, sf_dir):
    """Candidate set size of every window, before the cut at delta."""
    rows = _rows(spark, sf_dir)
    return win.window_sizes(
        win.window_factors(rows, DIMS, "gen_us", DAY), win.complete_windows(rows, "gen_us", DAY), "n_candidates")


def window_top_delta(spark, sf_dir):
    return win.window_top_delta(_rows(spark, sf_dir), DIMS, "gen_us", DAY, 10, ties=["gen_us", "event_id"])


_TOP = f"""WITH {STREAM}, {_windows_sql(DAY)}, f AS (
  SELECT p.event_id, p.gen_us, p.d1, p.d2, p.d3, p.window_id,
         coalesce((SELECT max({_COUNT3}) FROM rw q WHERE q.window_id = p.window_id AND ({_LT3})), 0) AS factor FROM rw p),
r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY factor, d1, d2, d3, gen_us, event_id) AS place
      FROM f WHERE factor < 3)
SELECT event_id, gen_us, d1, d2, d3, window_id, factor FROM r WHERE place <= 10"""


def _kept_rows(spark, sf_dir):
    """Rows that are not late, and the progress after all rows, from one pass of the slack rule."""
    flagged, fold = disorder.kslack_with_state(_disordered(spark, sf_dir), "app_us", ARRIVAL)
    return disorder.kept_rows(flagged).select("event_id", "app_us", *DIMS), int(fold.progress)


def window_top_delta_kept(spark, sf_dir):
    rows, progress = _kept_rows(spark, sf_dir)
    return win.window_top_delta(rows, DIMS, "app_us", UNEVEN, 10, ties=["app_us", "event_id"], progress=progress)


def pane_skyline_kept(spark, sf_dir):
    return win.pane_query(_kept_rows(spark, sf_dir)[0], DIMS, "app_us", UNEVEN)


def window_sizes_kept(spark, sf_dir):
    rows, progress = _kept_rows(spark, sf_dir)
    return win.window_sizes(win.window_skyline(rows, DIMS, "app_us", UNEVEN, progress=progress),
                            win.complete_windows(rows, "app_us", UNEVEN, progress))


def window_order(spark, sf_dir):
    """Results in the order windows are emitted, as (window, position)."""
    result = win.window_skyline(_rows(spark, sf_dir), DIMS, "gen_us", UNEVEN)
    return win.window_positions(result, ["gen_us", "event_id"]).select("window_id", "position", "event_id")


def rows_before_origin(spark, sf_dir):
    late_start = Windows(24 * HOUR, 6 * HOUR, ORIGIN + 48 * HOUR)
    return win.before_origin(_rows(spark, sf_dir), "gen_us", late_start)


def tuples_from_lines(spark, sf_dir):
    lines = _disordered(spark, sf_dir).select(F.concat_ws("  ", *DIMS, "app_us", "gen_us").alias("value"))
    return tuples.parse_tuples(lines, 3)


def tuples_from_blocks(spark, sf_dir):
    rows = _disordered(spark, sf_dir).select(*DIMS, F.col("app_us").alias("app_ts"), F.col("gen_us").alias("gen_ts"))
    return tuples.unpack_tuples(tuples.pack_tuples(rows, 3), 3)


_TUPLES = f"WITH {STREAM} SELECT d1, d2, d3, app_us AS app_ts, gen_us AS gen_ts FROM ev"


def windows_per_pane(spark, sf_dir):
    panes = win.with_pane(_rows(spark, sf_dir), "gen_us", UNEVEN).groupBy("pane_id").agg(F.count("*").alias("n_rows"))
    return win.windows_per_pane(panes, UNEVEN)


_PER_PANE = f"""WITH {STREAM}, pn AS (SELECT (gen_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id, count(*) AS n_rows FROM ev GROUP BY 1)
SELECT pane_id, n_rows, (SELECT count(*) FROM range(0, 2000) w(i)
  WHERE pane_id BETWEEN i * {UNEVEN.per_slide} AND i * {UNEVEN.per_slide} + {UNEVEN.per_window} - 1) AS n_windows FROM pn"""


def pane_split_plan(spark, sf_dir):
    return win.split_plan(win.with_pane(_rows(spark, sf_dir), "gen_us", UNEVEN))


_SPLIT = f"""WITH {STREAM}, pn AS (SELECT (gen_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id, count(*) AS n_rows FROM ev GROUP BY 1)
SELECT pane_id, n_rows, CAST(ceil(n_rows / (SELECT avg(n_rows) + stddev_pop(n_rows) FROM pn)) AS INTEGER) AS n_parts FROM pn"""


def pane_split_rows(spark, sf_dir):
    """Rows of split panes are dealt, none lost: sizes per pane after the split."""
    rows = win.pane_split(_rows(spark, sf_dir), "gen_us", UNEVEN)
    return rows.groupBy("pane_id").agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_event"))


_SPLIT_ROWS = f"""WITH {STREAM} SELECT (gen_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id, count(*) AS n_rows,
  min(event_id) AS first_event FROM ev GROUP BY 1"""


def parts_per_pane(spark, sf_dir):
    return win.split_plan(win.with_pane(_rows(spark, sf_dir), "gen_us", UNEVEN)).agg(
        F.round(F.avg("n_parts"), 6).alias("avg_parts"))


# disorder -------------------------------------------------------------------

KSLACK = """a AS (SELECT *, row_number() OVER (ORDER BY gen_us, event_id) AS i FROM ev),
b AS (SELECT *, max(app_us) OVER (ORDER BY i) AS m,
  coalesce(max(app_us) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pm FROM a),
c AS (SELECT *, app_us > pm AS adv, sum(CAST(app_us > pm AS INTEGER)) OVER (ORDER BY i) - CAST(app_us > pm AS INTEGER) AS seg FROM b),
d AS (SELECT *, min(app_us) OVER (PARTITION BY seg ORDER BY i) AS smin FROM c),
e AS (SELECT *, coalesce(max(CASE WHEN adv THEN greatest(app_us - smin, 0) END) OVER (ORDER BY i), 0) AS slack FROM d),
f AS (SELECT *, app_us - slack AS punct, greatest(coalesce(max(CASE WHEN adv THEN app_us - slack END) OVER (ORDER BY i), 0), 0) AS progress FROM e),
ks AS (SELECT *, coalesce(lag(progress) OVER (ORDER BY i), 0) AS prior_progress, app_us < progress AS is_late FROM f)"""


def _flagged(spark, sf_dir):
    return disorder.kslack(_disordered(spark, sf_dir), "app_us", ARRIVAL)


def kslack_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("event_id", "slack", "prior_progress", "progress", "is_late")


def kslack_kept(spark, sf_dir):
    return disorder.kept_rows(_flagged(spark, sf_dir)).select("event_id", "app_us", "gen_us")


def kslack_drop_ratio(spark, sf_dir):
    r = disorder.late_ratio(_flagged(spark, sf_dir))
    return r.select("received", "dropped", F.round("drop_ratio", 9).alias("drop_ratio"))


def window_skyline_kept(spark, sf_dir):
    """The full query on disordered input: late rows dropped, windows closed by progress."""
    kept, progress = _kept_rows(spark, sf_dir)
    return win.window_skyline(kept, DIMS, "app_us", UNEVEN, progress=progress)


_KEPT_WINDOWS = f"""WITH {STREAM}, {KSLACK}, kept AS (SELECT event_id, app_us, d1, d2, d3 FROM ks WHERE NOT is_late),
{_windows_sql(UNEVEN, 'app_us', 'kept', '(SELECT max(progress) FROM ks)')}
SELECT event_id, app_us, d1, d2, d3, window_id FROM rw p WHERE NOT EXISTS (
  SELECT 1 FROM rw q WHERE {_beats('q', 'p', key='window_id')})"""


_KEPT_RW = f"""WITH {STREAM}, {KSLACK}, kept AS (SELECT event_id, app_us, d1, d2, d3 FROM ks WHERE NOT is_late),
{_windows_sql(UNEVEN, 'app_us', 'kept', '(SELECT max(progress) FROM ks)')}"""
_TOP_KEPT = _KEPT_RW + f""", fk AS (
  SELECT p.event_id, p.app_us, p.d1, p.d2, p.d3, p.window_id,
         coalesce((SELECT max({_COUNT3}) FROM rw q WHERE q.window_id = p.window_id AND ({_LT3})), 0) AS factor FROM rw p),
r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY factor, d1, d2, d3, app_us, event_id) AS place
      FROM fk WHERE factor < 3)
SELECT event_id, app_us, d1, d2, d3, window_id, factor FROM r WHERE place <= 10"""
_PANES_KEPT = f"""WITH {STREAM}, {KSLACK}, pn AS (
  SELECT event_id, app_us, d1, d2, d3, (app_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id FROM ks WHERE NOT is_late AND app_us >= {ORIGIN})
SELECT * FROM pn p WHERE NOT EXISTS (SELECT 1 FROM pn q WHERE {_beats('q', 'p', key='pane_id')})"""
_SIZES_KEPT = _KEPT_RW + f""", sky AS (
  SELECT event_id, window_id FROM rw p WHERE NOT EXISTS (SELECT 1 FROM rw q WHERE {_beats('q', 'p', key='window_id')}))
SELECT window_id, count(sky.event_id) AS n_points FROM cw LEFT JOIN sky USING (window_id) GROUP BY window_id"""


def disorder_profile(spark, sf_dir):
    delayed = disorder.arrival_delay(_disordered(spark, sf_dir), "app_us", ARRIVAL)
    p = metrics.disorder_profile(delayed, "gen_us")
    return p.select("n_rows", "n_late", "max_delay", *[F.round(c, 6).alias(c) for c in (
        "mean_delay", "mean_inter_arrival", "rows_per_second", "dispersion")])


_PROFILE = f"""WITH {STREAM}, d AS (SELECT gen_us, max(app_us) OVER (ORDER BY gen_us, event_id) - app_us AS delay FROM ev),
s AS (SELECT gen_us // 1000000 AS sec, count(*) AS n FROM d GROUP BY 1),
z AS (SELECT (max(sec) - min(sec) + 1)::DOUBLE AS k, sum(n)::DOUBLE AS s1, sum(n * n)::DOUBLE AS s2 FROM s)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE delay > 0) AS n_late, max(delay) AS max_delay,
  round(sum(delay)::DOUBLE / count(*), 6) AS mean_delay,
  round((max(gen_us) - min(gen_us)) / (count(*) - 1), 6) AS mean_inter_arrival,
  round(count(*) * 1000000.0::DOUBLE / (max(gen_us) - min(gen_us)), 6) AS rows_per_second,
  round(any_value((s2 / k - (s1 / k) * (s1 / k)) / (s1 / k)), 6) AS dispersion
FROM d, z"""


def _emitted(spark, sf_dir):
    return disorder.reorder(_disordered(spark, sf_dir), "app_us", "gen_us", ARRIVAL)


def _in_order(spark, sf_dir):
    rows = _disordered(spark, sf_dir).select("event_id", "app_us", "gen_us", *DIMS)
    kept, last = disorder.in_order_rows(rows, "app_us", "gen_us", ARRIVAL)
    return kept.drop("gen_us"), last


def window_skyline_inorder(spark, sf_dir):
    """The full query behind the reorder buffer: windows are complete up to the last emission."""
    kept, last = _in_order(spark, sf_dir)
    return win.window_skyline(kept, DIMS, "app_us", UNEVEN, progress=last)


def window_sizes_inorder(spark, sf_dir):
    kept, last = _in_order(spark, sf_dir)
    found = win.window_skyline(kept, DIMS, "app_us", UNEVEN, progress=last)
    return win.window_sizes(found, win.complete_windows(kept, "app_us", UNEVEN, last))


def inorder_emission(spark, sf_dir):
    return _emitted(spark, sf_dir).select("event_id", "app_us", "release_gen", "is_late")


def inorder_emission_kept(spark, sf_dir):
    """Rows as they leave in order."""
    return _emitted(spark, sf_dir).filter("NOT is_late").orderBy("emit_pos").select("event_id", "app_us")


_RELEASE = f"""WITH {STREAM}, {KSLACK},
ad AS (SELECT i, punct, gen_us FROM ks WHERE adv),
rel AS (SELECT r.*, (SELECT min(ad.i) FROM ad WHERE ad.i >= r.i AND ad.punct >= r.app_us) AS j FROM ks r),
em AS (SELECT event_id, app_us, gen_us, coalesce((SELECT a.gen_us FROM a WHERE a.i = j), (SELECT max(gen_us) FROM ev)) AS release_gen,
  coalesce(app_us < max(app_us) OVER (ORDER BY coalesce(j, 9999999999), app_us, i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_late FROM rel)"""


_INORDER_RW = _RELEASE + f""", kept AS (SELECT event_id, app_us, d1, d2, d3 FROM em JOIN ev USING (event_id, app_us) WHERE NOT is_late),
{_windows_sql(UNEVEN, 'app_us', 'kept')}, sky AS (
  SELECT event_id, app_us, d1, d2, d3, window_id FROM rw p WHERE NOT EXISTS (SELECT 1 FROM rw q WHERE {_beats('q', 'p', key='window_id')}))"""


EIGHT_DIMS = [*DIMS, *[f"d{i}" for i in range(4, 9)]]
_PRIMES = (15485863, 32452843, 49979687, 67867967, 86028121)


def window_skyline_eight_dims(spark, sf_dir):
    """The published setting: eight dimensions over sliding windows of the event stream."""
    rows = stream_rows(spark, sf_dir).withColumns({
        f"d{4 + i}": (F.col("event_id") * p % 10007).cast("double") for i, p in enumerate(_PRIMES)})
    found = win.window_skyline(rows.select("event_id", "gen_us", *EIGHT_DIMS), EIGHT_DIMS, "gen_us", DAY)
    return found.select("event_id", "window_id")


_EIGHT_WINDOWS = f"""WITH {STREAM}, e8 AS (SELECT *, {', '.join(f"(event_id * {p} % 10007)::DOUBLE AS d{4 + i}" for i, p in enumerate(_PRIMES))} FROM ev),
{_windows_sql(DAY, source='e8')}
SELECT event_id, window_id FROM rw p WHERE NOT EXISTS (SELECT 1 FROM rw q WHERE {_beats('q', 'p', EIGHT_DIMS, 'window_id')})"""


def reorder_buffer_time(spark, sf_dir):
    return metrics.buffer_time(_emitted(spark, sf_dir), "gen_us").select(
        F.round("avg_buffer_time", 6).alias("avg_buffer_time"))


def adaptive_kslack(spark, sf_dir):
    """Sequential control loop per user."""
    out = disorder.adaptive_kslack(_disordered(spark, sf_dir), "app_us", "gen_us", "user_id", ARRIVAL, 0.05,
                                   period=HOUR)
    return out.select("event_id", "user_id", F.round("alpha", 9).alias("alpha"), "is_late")


def adaptive_reorder(spark, sf_dir):
    out = disorder.adaptive_reorder(_disordered(spark, sf_dir), "app_us", "gen_us", "user_id", ARRIVAL, 0.05,
                                    period=HOUR)
    return out.select("event_id", "user_id", "emit_seq", "is_late")


# one arrival of every user a step: the clock, the controller at a sample, then the slack
_ARRIVALS = "ar AS (SELECT event_id, user_id, app_us, gen_us, row_number() OVER (PARTITION BY user_id ORDER BY gen_us, event_id) AS n FROM ev)"
_STATE = """0.0::DOUBLE AS high, NULL::DOUBLE AS low, 0.0::DOUBLE AS slack, 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS integral, NULL::DOUBLE AS last,
  0::BIGINT AS received, 0::BIGINT AS dropped, NULL::BIGINT AS sampled"""


def _control(more: str = "") -> str:
    clamp = "least(1.0::DOUBLE, greatest({}, {}))".format
    kp, ki, kd = (f"{g}::DOUBLE" for g in disorder.GAINS)
    return f"""t1 AS (SELECT st.*, ar.event_id AS e, ar.app_us AS ts, ar.gen_us AS gen, gen_us - coalesce(sampled, gen_us) >= {HOUR} AS due
       FROM st JOIN ar ON ar.user_id = st.user_id AND ar.n = st.n + 1),
t2 AS (SELECT *, 1 - dropped / (received + 1)::DOUBLE AS coverage FROM t1),
t3 AS (SELECT *, coverage - 0.95::DOUBLE AS error, {clamp('-1.0::DOUBLE', f'integral + {ki} * (coverage - 0.95::DOUBLE)')} AS sum FROM t2),
t4 AS (SELECT *, CASE WHEN due THEN {clamp('0.0::DOUBLE', 'alpha + ' + clamp('-1.0::DOUBLE', f'{kp} * error + sum + {kd} * (coverage - coalesce(last, coverage))'))}
              ELSE alpha END AS alpha1, least(coalesce(low, ts), ts) AS low1 FROM t3),
t5 AS (SELECT *, CASE WHEN ts > high THEN greatest(slack, ts - low1) ELSE slack END AS slack1 FROM t4){more}"""


_NEXT = """greatest(high, ts), CASE WHEN ts > high THEN NULL ELSE low1 END, slack1, alpha1, CASE WHEN due THEN sum ELSE integral END,
  CASE WHEN due THEN coverage ELSE last END, CASE WHEN due THEN 0 ELSE received + 1 END, CASE WHEN due THEN 0 ELSE dropped END"""
_ADAPTIVE = f"""WITH RECURSIVE {STREAM}, {_ARRIVALS}, st AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, FALSE AS is_late, 0.0::DOUBLE AS progress, {_STATE} FROM ev
  UNION ALL (WITH {_control(""",
t6 AS (SELECT *, CASE WHEN ts > high THEN greatest(progress, ts - (1 - alpha1) * slack1) ELSE progress END AS progress1 FROM t5)""")}
  SELECT user_id, n + 1, e, ts < progress1, progress1, {_NEXT} + (ts < progress1)::BIGINT,
    CASE WHEN due THEN gen ELSE coalesce(sampled, gen) END FROM t6))
SELECT event_id, user_id, round(alpha, 9) AS alpha, is_late FROM st WHERE n > 0"""
# rows wait in a list; those up to the bound leave in order of event time and arrival, late if something later left before
_ADAPTIVE_BUFFER = f"""WITH RECURSIVE {STREAM}, {_ARRIVALS}, st AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS passed, 0.0::DOUBLE AS passed_before, 0::BIGINT AS seq,
    []::STRUCT(ts BIGINT, n BIGINT, e BIGINT)[] AS waiting, []::STRUCT(ts BIGINT, n BIGINT, e BIGINT)[] AS leaving, {_STATE} FROM ev
  UNION ALL (WITH {_control(""",
t6 AS (SELECT *, list_append(waiting, {'ts': ts, 'n': n + 1, 'e': e}) AS held,
         CASE WHEN ts > high THEN ts - (1 - alpha1) * slack1 ELSE -1.0::DOUBLE END AS bound FROM t5),
t7 AS (SELECT *, list_sort([x FOR x IN held IF x.ts <= bound]) AS out, [x FOR x IN held IF x.ts > bound] AS rest FROM t6)""")}
  SELECT user_id, n + 1, greatest(passed, coalesce(out[-1].ts, 0)), passed, seq + len(leaving), rest, out,
    {_NEXT} + len([x FOR x IN out IF x.ts < passed]), CASE WHEN due THEN gen ELSE coalesce(sampled, gen) END FROM t7)),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1),
lv AS (SELECT user_id, seq, passed_before AS passed, leaving FROM st UNION ALL SELECT user_id, seq + len(leaving), passed, list_sort(waiting) FROM fin),
ex AS (SELECT user_id, seq, passed, unnest(leaving) AS x, generate_subscripts(leaving, 1) - 1 AS place FROM lv)
SELECT x.e AS event_id, user_id, seq + place AS emit_seq, x.ts < passed AS is_late FROM ex"""


def reorder_by_user(spark, sf_dir):
    """In-order emission per source with the plain slack."""
    out = disorder.adaptive_reorder(_disordered(spark, sf_dir), "app_us", "gen_us", "user_id", ARRIVAL, None)
    return out.select("event_id", "user_id", "emit_seq", "is_late")


def _keyed(sql: str) -> str:
    """The progress rules evaluated per user."""
    return sql.replace("OVER (ORDER BY", "OVER (PARTITION BY user_id ORDER BY").replace(
        "PARTITION BY seg", "PARTITION BY user_id, seg")


_BY_USER_EMISSION = f"""WITH {STREAM}, {_keyed(KSLACK)},
ad AS (SELECT user_id, i, punct FROM ks WHERE adv),
rel AS (SELECT r.*, (SELECT min(ad.i) FROM ad WHERE ad.user_id = r.user_id AND ad.i >= r.i AND ad.punct >= r.app_us) AS j FROM ks r),
q AS (SELECT event_id, user_id, app_us, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(j, 9999999999), app_us, i) - 1 AS emit_seq FROM rel)
SELECT event_id, user_id, emit_seq, coalesce(app_us < max(app_us) OVER (PARTITION BY user_id ORDER BY emit_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_late FROM q"""


# metrics --------------------------------------------------------------------

def pane_latency(spark, sf_dir):
    return metrics.pane_latency(_flagged(spark, sf_dir), "app_us", "gen_us", UNEVEN)


def window_latency(spark, sf_dir):
    return metrics.window_latency(_flagged(spark, sf_dir), "app_us", "gen_us", UNEVEN)


_CLOSE = f"""WITH {STREAM}, {KSLACK}, fin AS (SELECT max(gen_us) AS fin FROM ev),
kp AS (SELECT (app_us - {ORIGIN}) // {UNEVEN.pane} AS pane_id, gen_us FROM ks WHERE NOT is_late AND app_us >= {ORIGIN}),
panes AS (SELECT pane_id, count(*) AS n_rows, min(gen_us) AS first_gen, max(gen_us) AS last_gen FROM kp GROUP BY 1),
pr AS (SELECT (progress - {ORIGIN}) // {UNEVEN.pane} AS at_pane, min(gen_us) AS gen FROM ks GROUP BY 1)"""
_PANE_LATENCY = _CLOSE + """, cl AS (
  SELECT p.*, coalesce((SELECT min(gen) FROM pr WHERE at_pane > p.pane_id), (SELECT fin FROM fin)) AS closed_gen FROM panes p)
SELECT pane_id, n_rows, closed_gen, first_gen, closed_gen - first_gen AS latency, closed_gen - last_gen AS closing_delay FROM cl"""
_WINDOW_LATENCY = _CLOSE + f""", w AS (
  SELECT window_id, min(first_gen) AS first_gen FROM (SELECT unnest(range(0, (SELECT max(pane_id) FROM panes) + 1)) AS window_id) ids
  JOIN panes ON pane_id BETWEEN window_id * {UNEVEN.per_slide} AND window_id * {UNEVEN.per_slide} + {UNEVEN.per_window} - 1 GROUP BY 1),
wl AS (SELECT window_id, first_gen, coalesce((SELECT min(gen) FROM pr
  WHERE at_pane > window_id * {UNEVEN.per_slide} + {UNEVEN.per_window} - 1), (SELECT fin FROM fin)) AS emit_gen FROM w)
SELECT window_id, first_gen, emit_gen, emit_gen - first_gen AS latency FROM wl"""


def window_rate(spark, sf_dir):
    r = metrics.result_rate(window_latency(spark, sf_dir), "emit_gen")
    return r.select("n_results", F.round("per_second", 12).alias("per_second"))


_RATE = f"""SELECT count(*) AS n_results, round(count(*) / ((max(emit_gen) - min(emit_gen)) / 1000000), 12) AS per_second
FROM ({_WINDOW_LATENCY})"""


def hourly_series(spark, sf_dir):
    """Zero-filled series of emitted windows and their mean latency, by hour at this time scale."""
    lat = window_latency(spark, sf_dir)
    return metrics.per_second(lat, "emit_gen", {
        "results": F.count("*"), "avg_latency_ms": F.round(F.avg(F.col("latency") / 1000.0), 6)}, ORIGIN, HOUR)


_SERIES = f"""WITH l AS ({_WINDOW_LATENCY}),
g AS (SELECT (emit_gen - {ORIGIN}) // {HOUR} AS second, count(*) AS results, round(avg(latency / 1000.0::DOUBLE), 6) AS avg_latency_ms FROM l GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(second) FROM g), (SELECT max(second) + 1 FROM g))) AS second)
SELECT second, coalesce(results, 0) AS results, coalesce(avg_latency_ms, 0) AS avg_latency_ms FROM s LEFT JOIN g USING (second)"""


def latency_seconds(spark, sf_dir):
    """Per-second series from the first emission on; seconds without a result are in it as zeros."""
    series = second_series(window_latency(spark, sf_dir))
    return series.agg(F.count("*").alias("n_seconds"), F.sum("results").alias("n_results"),
                      F.count_if(F.col("results") == 0).alias("n_zero"))


_SECONDS = f"""SELECT (max(emit_gen) - min(emit_gen)) // 1000000 + 1 AS n_seconds, count(*) AS n_results,
  (max(emit_gen) - min(emit_gen)) // 1000000 + 1 - count(DISTINCT (emit_gen - m) // 1000000) AS n_zero
FROM ({_WINDOW_LATENCY}), (SELECT min(emit_gen) AS m FROM ({_WINDOW_LATENCY}))"""


def arrivals_per_second(spark, sf_dir):
    return metrics.arrivals_per_second(_rows(spark, sf_dir), "gen_us")


def throughput_variation(spark, sf_dir):
    series = metrics.per_second(_rows(spark, sf_dir), "gen_us", {"n": F.count("*")}, ORIGIN, HOUR)
    v = metrics.throughput_variation(series, "n")
    return v.select(F.round("cv_percent", 6).alias("cv_percent"), F.round("mean", 6).alias("mean"))


_VARIATION = f"""WITH {STREAM}, g AS (SELECT (gen_us - {ORIGIN}) // {HOUR} AS h, count(*) AS n FROM ev GROUP BY 1),
s AS (SELECT coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(h) FROM g), (SELECT max(h) + 1 FROM g))) AS h) LEFT JOIN g USING (h))
SELECT round(stddev_pop(n) / avg(n) * 100, 6) AS cv_percent, round(avg(n), 6) AS mean FROM s"""


def arrival_prefix(spark, sf_dir):
    from skyquill.operators.ordering import arrival_prefix as prefix

    return prefix(_rows(spark, sf_dir), 100, ARRIVAL)


def arrival_prefix_by_rank(spark, sf_dir):
    """The way of a prefix too long to gather, by a small bound."""
    from skyquill.operators.ordering import arrival_prefix as prefix

    return prefix(_rows(spark, sf_dir), 100, ARRIVAL, gathered_rows=10)


QUERIES = {
    "window_skyline_events": (window_skyline_events, _sky_sql(DAY) + " SELECT * FROM sky"),
    "window_skyline_uneven": (window_skyline_uneven, _sky_sql(UNEVEN) + " SELECT * FROM sky"),
    "window_skyline_tumbling": (window_skyline_tumbling, _sky_sql(TUMBLING) + " SELECT * FROM sky"),
    "window_skyline_by_user": (window_skyline_by_user, _BY_USER),
    "pane_skyline_events": (pane_skyline_events, _PANES),
    "window_sizes_zero_filled": (window_sizes_zero_filled, _ZERO_FILLED + " SELECT * FROM sz"),
    "window_size_lines": (window_size_lines, _ZERO_FILLED +
                          " SELECT 'Window ' || window_id || ' with ' || n_points || ' result points' AS value FROM sz"),
    "window_size_stats": (window_size_stats, _ZERO_FILLED + """
SELECT count(*) AS n_results, round(avg(n_points), 6) AS avg_size, round(stddev_pop(n_points), 6) AS std_size FROM sz"""),
    "complete_windows": (complete_windows, f"WITH {STREAM}, {_windows_sql(SHORT)} SELECT window_id FROM cw"),
    "window_candidates": (window_candidates, _sky_sql(DAY) +
                          " SELECT window_id, count(sky.event_id) AS n_candidates FROM cw LEFT JOIN sky USING (window_id) GROUP BY 1"),
    "window_top_delta": (window_top_delta, _TOP),
    "windows_per_pane": (windows_per_pane, _PER_PANE),
    "pane_split_plan": (pane_split_plan, _SPLIT),
    "pane_split_rows": (pane_split_rows, _SPLIT_ROWS),
    "parts_per_pane": (parts_per_pane, f"SELECT round(avg(n_parts), 6) AS avg_parts FROM ({_SPLIT})"),
    "kslack_flags": (kslack_flags, f"WITH {STREAM}, {KSLACK} SELECT event_id, slack, prior_progress, progress, is_late FROM ks"),
    "kslack_kept": (kslack_kept, f"WITH {STREAM}, {KSLACK} SELECT event_id, app_us, gen_us FROM ks WHERE NOT is_late"),
    "kslack_drop_ratio": (kslack_drop_ratio, f"""WITH {STREAM}, {KSLACK} SELECT count(*) AS received,
  count(*) FILTER (WHERE is_late) AS dropped, round(count(*) FILTER (WHERE is_late) / count(*), 9) AS drop_ratio FROM ks"""),
    "window_skyline_kept": (window_skyline_kept, _KEPT_WINDOWS),
    "window_order": (window_order, _sky_sql(UNEVEN) + """ SELECT window_id, row_number() OVER (ORDER BY window_id, gen_us, event_id) - 1 AS position,
  event_id FROM sky"""),
    "rows_before_origin": (rows_before_origin, f"WITH {STREAM} SELECT event_id, gen_us, d1, d2, d3 FROM ev WHERE gen_us < {ORIGIN + 48 * HOUR}"),
    "tuples_from_lines": (tuples_from_lines, _TUPLES),
    "tuples_from_blocks": (tuples_from_blocks, _TUPLES),
    "window_top_delta_kept": (window_top_delta_kept, _TOP_KEPT),
    "pane_skyline_kept": (pane_skyline_kept, _PANES_KEPT),
    "window_sizes_kept": (window_sizes_kept, _SIZES_KEPT),
    "disorder_profile": (disorder_profile, _PROFILE),
    "inorder_emission": (inorder_emission, _RELEASE + " SELECT event_id, app_us, release_gen, is_late FROM em"),
    "inorder_emission_kept": (inorder_emission_kept, _RELEASE + " SELECT event_id, app_us FROM em WHERE NOT is_late"),
    "window_skyline_inorder": (window_skyline_inorder, _INORDER_RW + " SELECT * FROM sky"),
    "window_sizes_inorder": (window_sizes_inorder, _INORDER_RW +
                             " SELECT window_id, count(sky.event_id) AS n_points FROM cw LEFT JOIN sky USING (window_id) GROUP BY window_id"),
    "window_skyline_eight_dims": (window_skyline_eight_dims, _EIGHT_WINDOWS),
    "reorder_buffer_time": (reorder_buffer_time, _RELEASE +
                            " SELECT round(avg(release_gen - gen_us), 6) AS avg_buffer_time FROM em"),
    "reorder_by_user": (reorder_by_user, _BY_USER_EMISSION),
    "adaptive_kslack": (adaptive_kslack, _ADAPTIVE),
    "adaptive_reorder": (adaptive_reorder, _ADAPTIVE_BUFFER),
    "pane_latency": (pane_latency, _PANE_LATENCY),
    "window_latency": (window_latency, _WINDOW_LATENCY),
    "window_rate": (window_rate, _RATE),
    "hourly_series": (hourly_series, _SERIES),
    "latency_seconds": (latency_seconds, _SECONDS),
    "arrivals_per_second": (arrivals_per_second,
                            f"WITH {STREAM} SELECT gen_us // 1000000 AS second, count(*) AS n_rows FROM ev GROUP BY 1"),
    "throughput_variation": (throughput_variation, _VARIATION),
    "arrival_prefix_by_rank": (arrival_prefix_by_rank,
                               f"WITH {STREAM} SELECT event_id, gen_us, d1, d2, d3 FROM ev ORDER BY gen_us, event_id LIMIT 100"),
    "arrival_prefix": (arrival_prefix,
                       f"WITH {STREAM} SELECT event_id, gen_us, d1, d2, d3 FROM ev ORDER BY gen_us, event_id LIMIT 100"),
}
