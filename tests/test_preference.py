"""Skylines and factors against their definitions, on literal and random inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyquill.functions.dominance import dominates, high, low, no_worse_count, same_point
from skyquill.functions.kernels import dominance_factors, dominated_by, dominated_by_tiles, skyline_rows
from skyquill.operators import blocks, counting
from skyquill.operators import preference as pref
from skyquill.runtime import is_plain_scan


def brute(rows, dims):
    x = rows[dims].to_numpy(float)
    return rows[[not any((q <= p).all() and (q < p).any() for q in x) for p in x]]


def brute_factor(x):
    out = []
    for p in x:
        f = [int((q <= p).sum()) for q in x if (q < p).any()]
        out.append(max(f, default=0))
    return np.array(out)


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("rows, want", [
    ([(1, 1), (1, 1), (2, 2)], [(1, 1), (1, 1)]),
    ([(1, 5), (1, 6)], [(1, 5)]),
    ([(3, 1), (2, 2), (1, 3)], [(1, 3), (2, 2), (3, 1)]),
])
def test_literal_cases(spark, rows, want):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    assert ids(pref.skyline(df, ["a", "b"]), "a", "b") == [(float(a), float(b)) for a, b in want]


def test_factors_literal_and_order_free(spark):
    for rows in ([(1, 5, 5), (2, 6, 5)], [(2, 6, 5), (1, 5, 5)]):
        df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double")
        assert ids(pref.dominance_factor(df, ["a", "b", "c"]), "a") == [(1.0,)]
    df = spark.createDataFrame([(1.0, 1.0, 9.0), (2.0, 2.0, 3.0)], "a double, b double, c double")
    assert ids(pref.dominance_factor(df, ["a", "b", "c"]), "a", "factor") == [(1.0, 1), (2.0, 2)]


def test_one_dimension_nulls_nans_and_infinities(spark):
    df = spark.createDataFrame(
        [(1, 2.0), (2, None), (3, float("nan")), (4, 1.0), (5, 1.0)], "id int, a double")
    assert ids(pref.skyline(df, ["a"]), "id") == [(4,), (5,)]
    inf = float("inf")
    df = spark.createDataFrame([(1, -inf, inf), (2, inf, -inf), (3, inf, inf), (4, 0.0, 0.0)], "id int, a double, b double")
    assert ids(pref.skyline(df, ["a", "b"]), "id") == [(1,), (2,), (4,)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.lists(st.tuples(st.integers(0, 2), *[st.integers(0, 5)] * d), max_size=150)))
def test_kernel_matches_definition(rows):
    if not rows:
        return
    data = np.array(rows, dtype=float)
    codes, x = data[:, 0].astype(int), data[:, 1:]
    want = [i for i in range(len(x)) if not any(
        codes[j] == codes[i] and (x[j] <= x[i]).all() and (x[j] < x[i]).any() for j in range(len(x)))]
    assert list(skyline_rows(codes, x)) == want
    assert list(dominance_factors(x, x)) == list(brute_factor(x))


def frame(rng, n, d, groups):
    data = pd.DataFrame(rng.integers(0, 40, (n, d)).astype(float), columns=[f"d{i}" for i in range(d)])
    # one key holds a third of all rows
    data["k"] = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    data["id"] = range(n)
    return data


@pytest.mark.parametrize("block_rows", [4, 50, 16_384])
def test_groups_of_every_size(spark, block_rows):
    data = frame(np.random.default_rng(1), 1500, 3, 12)
    dims = ["d0", "d1", "d2"]
    df = spark.createDataFrame(data).repartition(5)
    want = sorted(i for _, part in data.groupby("k") for i in brute(part, dims)["id"])
    got = pref.skyline(df, dims, ["k"], block_rows=block_rows)
    assert [i for i, in ids(got, "id")] == want
    factors = {}
    for _, part in data.groupby("k"):
        f = brute_factor(part[dims].to_numpy())
        factors.update({int(i): int(v) for i, v in zip(part["id"], f) if v < 3})
    got = pref.dominance_factor(df, dims, ["k"], block_rows=block_rows)
    assert dict(ids(got, "id", "factor")) == factors


def test_nothing_can_be_pruned(spark):
    """Rows on a falling line: all survive, in more than one block."""
    n = 3000
    df = spark.range(n).selectExpr("id", "cast(id as double) a", f"cast({n} - id as double) b")
    got = pref.skyline(df, ["a", "b"], block_rows=700)
    assert got.count() == n
    assert pref.skyline(df, ["a", high("b")], block_rows=700).collect()[0]["id"] == 0


@pytest.mark.parametrize("least", [0, 100])
def test_prefilter_keeps_the_answer(spark, tmp_path, least):
    data = frame(np.random.default_rng(2), 4000, 3, 3)
    path = str(tmp_path / "rows")
    spark.createDataFrame(data).write.parquet(path)
    df = spark.read.parquet(path)
    assert is_plain_scan(df)
    size = {"small_bytes": 0, "prefilter_rows": least}
    dims = ["d0", high("d1"), "d2"]
    signed = data.assign(d1=-data["d1"])
    assert [i for i, in ids(pref.skyline(df, dims, **size), "id")] == sorted(brute(signed, ["d0", "d1", "d2"])["id"])
    want = sorted(i for _, part in signed.groupby("k") for i in brute(part, ["d0", "d1", "d2"])["id"])
    assert [i for i, in ids(pref.skyline(df, dims, ["k"], **size), "id")] == want


def test_merge_is_associative_and_idempotent(spark):
    data = frame(np.random.default_rng(3), 600, 3, 2)
    dims = ["d0", "d1", "d2"]
    df = spark.createDataFrame(data)
    a, b = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    whole = ids(pref.skyline(df, dims), "id")
    assert ids(pref.merge_skylines(pref.skyline(a, dims), pref.skyline(b, dims), dims), "id") == whole
    assert ids(pref.skyline(pref.skyline(df, dims), dims), "id") == whole


def test_merged_factors(spark):
    x = np.random.default_rng(4).integers(0, 9, (60, 3)).astype(float)
    halves = [dominance_factors(x, x[:30]), dominance_factors(x, x[30:])]
    parts = [spark.createDataFrame([(i, int(v)) for i, v in enumerate(h)], "id int, factor int") for h in halves]
    got = dict(ids(pref.merge_factors(*parts, ids=["id"]), "id", "factor"))
    assert got == {i: int(v) for i, v in enumerate(dominance_factors(x, x))}


def test_top_delta_and_k_dominant(spark):
    data = frame(np.random.default_rng(5), 500, 3, 3)
    dims = ["d0", "d1", "d2"]
    df = spark.createDataFrame(data)
    data["f"] = brute_factor(data[dims].to_numpy())
    best = data[data["f"] < 3].sort_values(["f", *dims, "id"])["id"].head(7)
    assert [r["id"] for r in pref.top_delta(df, dims, 7, ties=["id"]).collect()] == list(best)
    assert [i for i, in ids(pref.k_dominant(df, dims, 2), "id")] == sorted(data[data["f"] < 2]["id"])


def test_dominated_by_beyond_the_broadcast_bound(spark, monkeypatch):
    data = frame(np.random.default_rng(6), 400, 2, 3)
    df = spark.createDataFrame(data)
    points = df.filter("id < 60").select("d0", "d1")
    want = ids(pref.dominated_by(df, points, ["d0", "d1"]), "id")
    x, q = data[["d0", "d1"]].to_numpy(), data.loc[data["id"] < 60, ["d0", "d1"]].to_numpy()
    assert [i for i, in want] == [i for i, p in enumerate(x) if any((r <= p).all() and (r < p).any() for r in q)]
    monkeypatch.setattr(pref, "BROADCAST_ROWS", 2)
    assert ids(pref.dominated_by(df, points, ["d0", "d1"]), "id") == want
    pairs = pref.dominance_pairs(df, points, ["d0", "d1"]).count()
    assert pairs == sum(((r <= p).all() and (r < p).any()) for p in x for r in q)


def test_rows_are_copied_by_blocks_of_many_points(spark):
    """How few points are broadcast says nothing about how often a row is copied."""
    rows = spark.range(3000).selectExpr("id", "CAST(id % 70 AS double) AS a", "CAST(id % 90 AS double) AS b")
    points = rows.filter("id % 20 = 0")
    left, right = pref._theta_blocks(rows, points, 2)
    assert left.count() + right.count() < 3 * 3000
    pairs = pref.dominance_pairs(rows, points, ["a", "b"], broadcast_rows=2)
    x = rows.toPandas()
    q = x[x["id"] % 20 == 0]
    assert pairs.count() == sum(int(((x.a >= p.a) & (x.b >= p.b) & ((x.a > p.a) | (x.b > p.b))).sum()) for p in q.itertuples())


def test_maintenance_counts_removed_rows(spark):
    old = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 9.0)], "id int, a double, b double")
    batch = spark.createDataFrame([(3, 4.0, 4.0)], "id int, a double, b double")
    new, removed = pref.maintain_skyline(old, batch, ["a", "b"])
    assert ids(new, "id") == [(2,), (3,)] and removed.collect()[0]["removed"] == 1


def test_column_predicates(spark):
    a = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "x double, y double").alias("p")
    b = spark.createDataFrame([(1.0, 3.0)], "x double, y double").alias("q")
    got = a.join(b, no_worse_count("p", "q", ["x", "y"]) >= 0).select(
        dominates("p", "q", [low("x"), low("y")]).alias("d"), same_point("p", "q", ["x", "y"]).alias("s")).collect()
    assert sorted((r["d"], r["s"]) for r in got) == [(False, False), (True, False)]


def anticorrelated(rng, n, d):
    """Points near a plane of equal sums, of which hardly one dominates another."""
    x = rng.dirichlet(np.ones(d), n) * 100 + rng.normal(size=(n, d)) * 0.05
    x[: n // 50] = x[0]
    return np.round(x, 3)


def test_corners_rule_out_most_pairs_of_blocks(spark):
    """Eight dimensions, one group of many blocks: results as by definition, few pairs of blocks compared."""
    n, d = 6000, 8
    x = anticorrelated(np.random.default_rng(31), n, d)
    dims = [f"d{i}" for i in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=dims).assign(id=range(n), k=1)).repartition(4)
    alive = ~dominated_by(x, x, strict=True)
    got = pref.skyline(df, dims, ["k"], block_rows=300)
    assert [i for i, in ids(got, "id")] == np.flatnonzero(alive).tolist()
    factors = dominance_factors(x[alive], x[alive])
    got = pref.dominance_factor(df, dims, ["k"], block_rows=300)
    assert dict(ids(got, "id", "factor")) == dict(zip(np.flatnonzero(alive).tolist(), factors.tolist()))
    shares = []
    for block_rows in (300, 30):
        rows = blocks.in_blocks(df.withColumn("__rid", F.col("id").cast("long")), ["k"], dims, block_rows, n)
        sizes = [r["count"] for r in rows.groupBy("k", "__block").count().collect()]
        assert max(sizes) <= block_rows and sum(sizes) == n
        table = blocks.corners(rows, ["k"], dims)
        shares.append(blocks.block_pairs(table, table, ["k"], blocks.reachable_dims(d) == d).count() / len(sizes) ** 2)
    assert shares[0] < 0.6 and shares[1] < 0.4


def test_tiles_match_the_plain_kernel():
    rng = np.random.default_rng(32)
    for n, m, d in ((0, 5, 2), (700, 900, 3), (1000, 600, 2)):
        a, b = rng.integers(0, 30, (n, d)).astype(float), rng.integers(0, 30, (m, d)).astype(float)
        a, b = a[np.lexsort(a.T)], b[np.lexsort(b.T)]
        assert (dominated_by_tiles(a, b, 64) == dominated_by(a, b, strict=True)).all()


def test_wide_heads_match_the_plain_kernel():
    rng = np.random.default_rng(29)
    for n, d, most in ((3000, 8, 40), (2500, 6, 12), (1400, 2, 1 << 40), (1100, 1, 1 << 40)):
        x = rng.integers(0, most, (n, d)).astype(float)
        if d == 2:
            x[:, 1] = -x[:, 0]  # nothing is dominated
        x[rng.random((n, d)) < 0.02] = 0.0
        x[rng.random((n, d)) < 0.02] = -0.0
        x[rng.random((n, d)) < 0.01] = np.inf
        x[rng.random((n, d)) < 0.01] = -np.inf
        x[: n // 10] = x[n // 2:n // 2 + n // 10]  # equal rows
        want = np.flatnonzero(~dominated_by(x, x, strict=True))
        assert list(skyline_rows(np.zeros(n, dtype=int), x)) == list(want)


def test_groups_meet_before_many_dimensions_are_pruned(spark, tmp_path):
    class Whole(pref.Skyline):
        def prune(self, codes, points):
            raise AssertionError("rows of a group are pruned before they meet")

    dims = [f"d{i}" for i in range(8)]
    path = str(tmp_path / "rows")
    spark.range(200_000).select("id", (F.col("id") % 400).alias("k"), *[
        F.pmod(F.xxhash64("id", F.lit(d)), F.lit(500)).cast("double").alias(d) for d in dims]).write.parquet(path)
    df = spark.read.parquet(path)
    got = pref.evaluate(df, dims, ["k"], Whole(), small_bytes=0).select("id").toPandas()["id"]
    data = df.toPandas()
    assert sorted(got) == sorted(data["id"][skyline_rows(data["k"].to_numpy(), data[dims].to_numpy())])


@pytest.mark.parametrize("block_rows", [4, 40, 16_384])
def test_met_groups_of_every_size(spark, tmp_path, block_rows):
    data = frame(np.random.default_rng(30), 1500, 6, 12)
    data = pd.concat([data, data[:50].assign(id=range(2000, 2050))])  # equal rows
    data.loc[data["id"] % 11 == 0, "d3"] = None
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame(data).withColumn("k", F.when(F.col("k") != 1, F.col("k")))  # a null key is a group
    rows.withColumn("d3", F.when(~F.isnan("d3"), F.col("d3"))).write.parquet(path)
    df = spark.read.parquet(path)
    dims = [f"d{i}" for i in range(6)]
    how = {"small_bytes": 0, "meet_rows": 0, "block_rows": block_rows}
    usable = data[data["d3"].notna()]
    want = [brute(part, dims) for _, part in usable.groupby("k")]
    got = ids(pref.skyline(df, dims, ["k"], **how), "id")
    assert [i for i, in got] == sorted(i for part in want for i in part["id"])
    factors = ids(pref.dominance_factor(df, dims, ["k"], **how), "id", "factor")
    assert factors == sorted((i, f) for (_, part), kept in zip(usable.groupby("k"), want) for i, f in zip(
        part["id"], brute_factor(part[dims].to_numpy(float))) if f < len(dims) and i in set(kept["id"]))


@pytest.mark.parametrize("slab_rows, d", [(40, 3), (25, 2), (300, 4), (7, 1), (20_000, 3)])
def test_dominance_counts_match_the_definition(spark, slab_rows, d):
    rng = np.random.default_rng(33 + d)
    x, p = rng.integers(0, 60, (900, d)).astype(float), rng.integers(0, 60, (500, d)).astype(float)
    x[:300] = x[0]  # a third of the rows in one place
    p[:100] = x[0]
    dims = [f"d{i}" for i in range(d)]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=dims)).repartition(3)
    points = spark.createDataFrame(pd.DataFrame(p, columns=dims).assign(pid=range(500)))
    got = counting.dominance_counts(rows, points, dims, "pid", slab_rows=slab_rows)
    want = [int(((x >= q).all(axis=1) & (x > q).any(axis=1)).sum()) for q in p]
    assert [n for _, n in ids(got, "pid", "n_beaten")] == want


def test_dominance_counts_of_other_directions_and_nothing(spark):
    rows = spark.createDataFrame([(1.0, 9.0), (2.0, 8.0), (None, 1.0), (3.0, float("nan"))], "a double, b double")
    points = spark.createDataFrame([(1, 0.5, 9.0), (2, 2.0, 8.0), (3, None, 0.0), (4, 0.0, 0.0)], "pid int, a double, b double")
    assert ids(counting.dominance_counts(rows, points, ["a", high("b")], "pid"), "pid", "n_beaten") == [(1, 2), (2, 0), (4, 0)]
    assert ids(counting.dominance_counts(rows.limit(0), points, ["a", high("b")], "pid"), "pid", "n_beaten") == [(1, 0), (2, 0), (4, 0)]
    assert counting.dominance_counts(rows, points.limit(0), ["a", high("b")], "pid").count() == 0


def test_crowded_slabs_copy_few_rows_and_broadcast_none(spark, monkeypatch):
    """Values of one dimension are all equal, so its slab holds every row however few are asked for."""
    rng = np.random.default_rng(37)
    x = np.column_stack([rng.integers(0, 900, 3000), np.full(3000, 7), rng.integers(0, 900, 3000)]).astype(float)
    x[:500, 1] = 8.0
    stored, checkpointed = [], counting.checkpointed
    monkeypatch.setattr(counting, "checkpointed", lambda df: stored.append(checkpointed(df)) or stored[-1])
    dims = ["a", "b", "c"]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=dims).assign(pid=range(3000)))
    got = counting.dominance_counts(rows, rows, dims, "pid", slab_rows=10)
    want = [int(((x >= q).all(axis=1) & (x > q).any(axis=1)).sum()) for q in x]
    assert [n for _, n in ids(got, "pid", "n_beaten")] == want
    shares = [df for df in stored if "__x" in df.columns]
    assert len(shares) == 1 and shares[0].agg(F.max("__x"), F.max("__y")).first()[:2] == (1, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("__pid" in line or "__k0" in line)]


@pytest.mark.parametrize("sides, compared", [((5, 7, 900), {2}), ((5, 7, 6), set()), ((6,), set()), ((900, 3), {0})])
def test_slabs_of_one_value_compare_nothing(spark, monkeypatch, sides, compared):
    """Rows that share a value with a point are counted by the number of their slab; only slabs of many values are compared."""
    rng = np.random.default_rng(38)
    x = np.column_stack([rng.integers(0, n, 2000) for n in sides]).astype(float)
    p = np.column_stack([rng.integers(-2, n + 2, 300) / 2 for n in sides])  # between, below and above the rows' values too
    p[:100] = x[:100]
    p[0], x[x == 0] = np.inf, -0.0
    stored, checkpointed = [], counting.checkpointed
    monkeypatch.setattr(counting, "checkpointed", lambda df: stored.append(checkpointed(df)) or stored[-1])
    dims = [f"d{i}" for i in range(len(sides))]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=dims)).repartition(3)
    points = spark.createDataFrame(pd.DataFrame(p, columns=dims).assign(pid=range(300)))
    got = counting.dominance_counts(rows, points, dims, "pid", slab_rows=40)
    want = [int(((x >= q).all(axis=1) & (x > q).any(axis=1)).sum()) for q in p]
    assert [n for _, n in ids(got, "pid", "n_beaten")] == want
    assert {r["__dim"] for df in stored if "__x" in df.columns for r in df.collect()} == compared
