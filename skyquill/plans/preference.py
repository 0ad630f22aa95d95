"""Registered preference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquill.functions.dominance import canonical_order, high, low, no_worse_count, same_point
from skyquill.operators import counting
from skyquill.operators import preference as pref
from skyquill.plans.tables import STREAM, stream_rows, table

OFFER = [low("l_extendedprice"), high("l_quantity"), high("l_discount")]
OFFER_COLUMNS = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount"]
DIMS = ["d1", "d2", "d3"]
VECTOR = ["v1", "v2", "v3", "v4"]


def offers(spark, sf_dir, *more):
    return table(spark, sf_dir, "lineitem").select(*OFFER_COLUMNS, *more)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(VECTOR)])


# lineitem has few distinct (quantity, discount) pairs: only the cheapest of each can dominate
_CHEAPEST = """cheapest AS (
  SELECT l_quantity AS q, l_discount AS d, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL)"""
_UNBEATEN = """NOT EXISTS (SELECT 1 FROM cheapest c
  WHERE c.p <= l.l_extendedprice AND c.q >= l.l_quantity AND c.d >= l.l_discount
    AND (c.p < l.l_extendedprice OR c.q > l.l_quantity OR c.d > l.l_discount))"""
_OFFER_SQL = f"WITH {_CHEAPEST} SELECT {', '.join(OFFER_COLUMNS)} FROM lineitem l WHERE {_UNBEATEN}"


def skyline_lineitem(spark, sf_dir):
    return pref.skyline(offers(spark, sf_dir), OFFER)


def skyline_by_brand(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = offers(spark, sf_dir, "l_partkey").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return pref.skyline(rows.select(*OFFER_COLUMNS, "p_brand"), OFFER, ["p_brand"])


_BY_BRAND = f"""WITH o AS (SELECT {', '.join(OFFER_COLUMNS)}, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
cheapest AS (SELECT p_brand AS b, l_quantity AS q, l_discount AS d, min(l_extendedprice) AS p FROM o GROUP BY ALL)
SELECT * FROM o l WHERE NOT EXISTS (SELECT 1 FROM cheapest c WHERE c.b = l.p_brand
  AND c.p <= l.l_extendedprice AND c.q >= l.l_quantity AND c.d >= l.l_discount
  AND (c.p < l.l_extendedprice OR c.q > l.l_quantity OR c.d > l.l_discount))"""


def skyline_prefiltered(spark, sf_dir):
    """The way of large scans, whatever the size."""
    return pref.skyline(offers(spark, sf_dir), OFFER, small_bytes=0, prefilter_rows=0)


def skyline_by_flag_prefiltered(spark, sf_dir):
    return pref.skyline(offers(spark, sf_dir, "l_returnflag"), OFFER, ["l_returnflag"], small_bytes=0, prefilter_rows=0)


_BY_FLAG = f"""WITH cheapest AS (SELECT l_returnflag AS b, l_quantity AS q, l_discount AS d, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT {', '.join(OFFER_COLUMNS)}, l_returnflag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM cheapest c WHERE c.b = l.l_returnflag
  AND c.p <= l.l_extendedprice AND c.q >= l.l_quantity AND c.d >= l.l_discount
  AND (c.p < l.l_extendedprice OR c.q > l.l_quantity OR c.d > l.l_discount))"""


def skyline_merge(spark, sf_dir):
    rows = offers(spark, sf_dir, "l_linestatus")
    parts = F.pmod(F.xxhash64("l_linestatus"), F.lit(2))  # whatever the values are, every row is in one part
    halves = [pref.skyline(rows.filter(parts == i).drop("l_linestatus"), OFFER) for i in range(2)]
    return pref.merge_skylines(*halves, OFFER)


def skyline_maintained(spark, sf_dir):
    rows = offers(spark, sf_dir, "l_shipdate")
    old = rows.filter(F.col("l_shipdate") < "1998-01-01").drop("l_shipdate")
    batch = rows.filter(F.col("l_shipdate") >= "1998-01-01").drop("l_shipdate")
    return pref.maintain_skyline(pref.skyline(old, OFFER), batch, OFFER)[0]


def skyline_maintained_removals(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).select("event_id", "user_id", "event_type", *DIMS)
    old = pref.skyline(rows.filter("event_type <> 'purchase'"), DIMS, ["user_id"])
    return pref.maintain_skyline(old, rows.filter("event_type = 'purchase'"), DIMS, ["user_id"])[1]


def _beats(a, b, dims=DIMS, key=None):
    le = " AND ".join(f"{a}.{d} <= {b}.{d}" for d in dims)
    lt = " OR ".join(f"{a}.{d} < {b}.{d}" for d in dims)
    return (f"{a}.{key} = {b}.{key} AND " if key else "") + f"{le} AND ({lt})"


_REMOVALS = f"""WITH {STREAM}, old AS (
  SELECT * FROM ev p WHERE event_type <> 'purchase' AND NOT EXISTS (
    SELECT 1 FROM ev q WHERE q.event_type <> 'purchase' AND {_beats('q', 'p', key='user_id')}))
SELECT user_id, count(*) FILTER (WHERE event_type <> 'purchase' AND event_id IN (SELECT event_id FROM old)
  AND EXISTS (SELECT 1 FROM ev q WHERE q.event_type = 'purchase' AND {_beats('q', 'p', key='user_id')})) AS removed
FROM ev p GROUP BY user_id"""


def skyline_by_user(spark, sf_dir):
    return pref.skyline(stream_rows(spark, sf_dir).select("event_id", "user_id", *DIMS), DIMS, ["user_id"])


_BY_USER = f"""WITH {STREAM} SELECT event_id, user_id, d1, d2, d3 FROM ev p
WHERE NOT EXISTS (SELECT 1 FROM ev q WHERE {_beats('q', 'p', key='user_id')})"""


EIGHT = [f"v{i + 1}" for i in range(8)]


def _eight(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(EIGHT)])


def skyline_eight_dims(spark, sf_dir):
    """The number of dimensions of the published experiments."""
    return pref.skyline(_eight(spark, sf_dir), EIGHT)


def skyline_eight_dims_by_label(spark, sf_dir):
    return pref.skyline(_eight(spark, sf_dir), EIGHT, ["label"])


_EIGHT = ("WITH v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {v}" for i, v in enumerate(EIGHT))
          + " FROM embeddings) SELECT * FROM v p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE {})")


def dimension_equality(spark, sf_dir):
    """Each event beside the next one of its user's number: equal on chosen dimensions, and where it is no worse."""
    rows = stream_rows(spark, sf_dir).select("event_id", "d1", "d2", (F.col("d3") % 3).alias("d3"))
    p, q = rows.alias("p"), rows.withColumn("event_id", F.col("event_id") - 1).alias("q")
    return p.join(q, F.col("p.event_id") == F.col("q.event_id")).select(
        F.col("p.event_id").alias("event_id"), same_point("p", "q", ["d2", high("d3")]).alias("same"),
        no_worse_count("p", "q", DIMS).alias("no_worse"))


_EQUALITY = f"""WITH {STREAM}, r AS (SELECT event_id, d1, d2, d3 % 3 AS d3 FROM ev)
SELECT p.event_id, p.d2 = q.d2 AND p.d3 = q.d3 AS same,
  (p.d1 <= q.d1)::INTEGER + (p.d2 <= q.d2)::INTEGER + (p.d3 <= q.d3)::INTEGER AS no_worse
FROM r p JOIN r q ON q.event_id = p.event_id + 1"""


def skyline_ordered(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).select("event_id", *DIMS, "app_us", "gen_us")
    return canonical_order(pref.skyline(rows, DIMS), DIMS, "app_us", "gen_us")


_ORDERED = f"""WITH {STREAM} SELECT event_id, d1, d2, d3, app_us, gen_us FROM ev p
WHERE NOT EXISTS (SELECT 1 FROM ev q WHERE {_beats('q', 'p')}) ORDER BY d1, d2, d3, app_us, gen_us"""


def result_sizes_by_user(spark, sf_dir):
    return pref.result_sizes(skyline_by_user(spark, sf_dir), ["user_id"])


_SIZES = f"""WITH sky AS ({_BY_USER}) SELECT user_id, count(*) AS n_points FROM sky GROUP BY user_id"""


def _blocks(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).select("event_id", "gen_us", *DIMS)
    return pref.block_skyline(rows, DIMS, 500, ["gen_us", "event_id"])


def skyline_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)[0]


def skyline_blocks_merged(spark, sf_dir):
    return _blocks(spark, sf_dir)[1]


_BLOCKS = f"""WITH {STREAM}, r AS (
  SELECT event_id, gen_us, d1, d2, d3, (row_number() OVER (ORDER BY gen_us, event_id) - 1) // 500 AS block_id FROM ev)
SELECT * FROM r p WHERE NOT EXISTS (SELECT 1 FROM r q WHERE {_beats('q', 'p', key='block_id')})"""
_MERGED = f"""WITH {STREAM}, r AS (
  SELECT event_id, gen_us, d1, d2, d3, (row_number() OVER (ORDER BY gen_us, event_id) - 1) // 500 AS block_id FROM ev)
SELECT * FROM r p WHERE NOT EXISTS (SELECT 1 FROM r q WHERE {_beats('q', 'p')})"""


def dominated_by_point(spark, sf_dir):
    return pref.dominated_by_point(offers(spark, sf_dir), OFFER, (50000.0, 30.0, 0.05))


_BY_POINT = f"""SELECT {', '.join(OFFER_COLUMNS)} FROM lineitem
WHERE l_extendedprice >= 50000 AND l_quantity <= 30 AND l_discount <= 0.05::DOUBLE
  AND (l_extendedprice > 50000 OR l_quantity < 30 OR l_discount < 0.05::DOUBLE)"""


def _benchmarks(spark, sf_dir):
    """A demanding offer per supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.max("l_extendedprice") / 4).alias("l_extendedprice"), (F.max("l_quantity") / 2).alias("l_quantity"),
        (F.max("l_discount") / 2).alias("l_discount"))


_BENCHMARKS = """pt AS (SELECT l_suppkey, max(l_extendedprice) / 4 AS p, max(l_quantity) / 2 AS q, max(l_discount) / 2 AS d
  FROM lineitem GROUP BY l_suppkey)"""
_BEATEN = """p <= l.l_extendedprice AND q >= l.l_quantity AND d >= l.l_discount
  AND (p < l.l_extendedprice OR q > l.l_quantity OR d > l.l_discount)"""


def dominated_by_benchmarks(spark, sf_dir):
    return pref.dominated_by(offers(spark, sf_dir), _benchmarks(spark, sf_dir), OFFER)


_BY_BENCHMARKS = f"""WITH {_BENCHMARKS} SELECT {', '.join(OFFER_COLUMNS)} FROM lineitem l
WHERE EXISTS (SELECT 1 FROM pt WHERE {_BEATEN})"""


def dominance_pair_counts(spark, sf_dir):
    """Counted without pairs; points that beat nothing are left out."""
    found = counting.dominance_counts(offers(spark, sf_dir), _benchmarks(spark, sf_dir), OFFER, "l_suppkey")
    return found.filter("n_beaten > 0").withColumnRenamed("l_suppkey", "point_l_suppkey")


def dominance_counts_of_parts(spark, sf_dir):
    """As many points as rows: how many parts each part beats, in slabs of few rows."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice"), F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") * 7919 % 101).cast("double").alias("wait"))
    return counting.dominance_counts(parts, parts, [low("p_retailprice"), high("p_size"), low("wait")], "p_partkey", slab_rows=100)


_PART_COUNTS = """WITH x AS (SELECT p_partkey, p_retailprice AS a, -p_size::DOUBLE AS b, (p_partkey * 7919 % 101)::DOUBLE AS c FROM part)
SELECT p.p_partkey, count(r.p_partkey) AS n_beaten FROM x p LEFT JOIN x r
ON p.a <= r.a AND p.b <= r.b AND p.c <= r.c AND (p.a < r.a OR p.b < r.b OR p.c < r.c) GROUP BY p.p_partkey"""


def dominated_by_benchmark_blocks(spark, sf_dir):
    """The way of more points than are broadcast, by a small bound."""
    return pref.dominated_by(offers(spark, sf_dir), _benchmarks(spark, sf_dir), OFFER, broadcast_rows=2)


def dominance_pair_count_blocks(spark, sf_dir):
    pairs = pref.dominance_pairs(offers(spark, sf_dir), _benchmarks(spark, sf_dir), OFFER, broadcast_rows=10)
    return pairs.groupBy("point_l_suppkey").agg(F.count("*").alias("n_beaten"))


_PAIR_COUNTS = f"""WITH {_BENCHMARKS} SELECT pt.l_suppkey AS point_l_suppkey, count(*) AS n_beaten
FROM lineitem l JOIN pt ON {_BEATEN} GROUP BY ALL"""


def dominance_factor(spark, sf_dir):
    return pref.dominance_factor(vectors(spark, sf_dir), VECTOR)


def dominance_factor_in_blocks(spark, sf_dir):
    """The path of groups too large for one task, by a small block size."""
    return pref.dominance_factor(vectors(spark, sf_dir), VECTOR, block_rows=24)


def k_dominant(spark, sf_dir):
    return pref.k_dominant(vectors(spark, sf_dir), VECTOR, 3, ["label"])


def top_delta_vectors(spark, sf_dir):
    return pref.top_delta(vectors(spark, sf_dir), VECTOR, 20, ties=["vec_id"])


def top_delta_by_user(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).select("event_id", "user_id", *DIMS)
    return pref.top_delta(rows, DIMS, 5, ["user_id"], ["event_id"])


def _vec_factors(key=None):
    count = " + ".join(f"CAST(q.{v} <= p.{v} AS INTEGER)" for v in VECTOR)
    lt = " OR ".join(f"q.{v} < p.{v}" for v in VECTOR)
    match = f"q.{key} = p.{key} AND " if key else ""
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {v}" for i, v in enumerate(VECTOR))
    return f"""v AS (SELECT vec_id, label, {cols} FROM embeddings),
f AS (SELECT p.*, coalesce((SELECT max({count}) FROM v q WHERE {match}({lt})), 0) AS factor FROM v p)"""


_FACTOR = f"WITH {_vec_factors()} SELECT * FROM f WHERE factor < 4"
_K_DOMINANT = f"WITH {_vec_factors('label')} SELECT * FROM f WHERE factor < 3"
_TOP_VECTORS = f"WITH {_vec_factors()} SELECT * FROM f WHERE factor < 4 ORDER BY factor, v1, v2, v3, v4, vec_id LIMIT 20"
_COUNT3 = " + ".join(f"CAST(q.{d} <= p.{d} AS INTEGER)" for d in DIMS)
_LT3 = " OR ".join(f"q.{d} < p.{d}" for d in DIMS)
_TOP_USER = f"""WITH {STREAM}, f AS (SELECT p.event_id, p.user_id, p.d1, p.d2, p.d3,
  coalesce((SELECT max({_COUNT3}) FROM ev q WHERE q.user_id = p.user_id AND ({_LT3})), 0) AS factor FROM ev p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY factor, d1, d2, d3, event_id) AS place FROM f WHERE factor < 3)
SELECT event_id, user_id, d1, d2, d3, factor FROM r WHERE place <= 5"""

QUERIES = {
    "skyline_lineitem": (skyline_lineitem, _OFFER_SQL),
    "skyline_by_brand": (skyline_by_brand, _BY_BRAND),
    "skyline_merge": (skyline_merge, _OFFER_SQL),
    "skyline_maintained": (skyline_maintained, _OFFER_SQL),
    "skyline_maintained_removals": (skyline_maintained_removals, _REMOVALS),
    "skyline_by_user": (skyline_by_user, _BY_USER),
    "skyline_ordered": (skyline_ordered, _ORDERED),
    "result_sizes_by_user": (result_sizes_by_user, _SIZES),
    "skyline_blocks": (skyline_blocks, _BLOCKS),
    "skyline_blocks_merged": (skyline_blocks_merged, _MERGED),
    "dominated_by_point": (dominated_by_point, _BY_POINT),
    "dominated_by_benchmarks": (dominated_by_benchmarks, _BY_BENCHMARKS),
    "skyline_prefiltered": (skyline_prefiltered, _OFFER_SQL),
    "skyline_by_flag_prefiltered": (skyline_by_flag_prefiltered, _BY_FLAG),
    "skyline_eight_dims": (skyline_eight_dims, _EIGHT.format(_beats("q", "p", EIGHT))),
    "skyline_eight_dims_by_label": (skyline_eight_dims_by_label, _EIGHT.format(_beats("q", "p", EIGHT, "label"))),
    "dimension_equality": (dimension_equality, _EQUALITY),
    "dominance_pair_counts": (dominance_pair_counts, _PAIR_COUNTS),
    "dominance_counts_of_parts": (dominance_counts_of_parts, _PART_COUNTS),
    "dominated_by_benchmark_blocks": (dominated_by_benchmark_blocks, _BY_BENCHMARKS),
    "dominance_pair_count_blocks": (dominance_pair_count_blocks, _PAIR_COUNTS),
    "dominance_factor": (dominance_factor, _FACTOR),
    "dominance_factor_in_blocks": (dominance_factor_in_blocks, _FACTOR),
    "k_dominant": (k_dominant, _K_DOMINANT),
    "top_delta_vectors": (top_delta_vectors, _TOP_VECTORS),
    "top_delta_by_user": (top_delta_by_user, _TOP_USER),
}
