"""Shared operators against brute force, with one hot key holding a third of all rows."""

import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import Config
from strom.functions.geo import with_utm32
from strom.operators import checks, quality, upsert
from strom.operators.nearest import interval_join, nearest
from strom.operators.quantiles import exact_percentiles
from strom.operators.sizes import salted_join, skew_join
from strom.operators.sliced import with_history
from strom.operators.spatial import distance_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((key, start + timedelta(seconds=rng.randrange(20 * 86_400)), i, rng.randrange(1000) / 10.0))
    rows += [(None, start, 10_000, 1.0), ("null-time", None, 10_001, 2.0)]
    return spark.createDataFrame(rows, "key string, at timestamp, id int, value double").cache()


def test_sliced_window_equals_plain_window(skewed):
    got = with_history(skewed, ["key"], "at", ["id"], 3600.0, lag=["value", "id"], sums={"total": F.col("value")},
                       running_max={"top": F.col("value")}, number="n")
    w = W.partitionBy("key").orderBy("at", "id")
    want = skewed.withColumns({
        "prev_value": F.lag("value").over(w), "prev_id": F.lag("id").over(w),
        "total": F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "top": F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1)), "n": F.row_number().over(w)})
    columns = ["key", "id", "prev_value", "prev_id", "top", "n"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0
    sums = {r.id: r.total for r in want.collect()}
    assert all(r.total == pytest.approx(sums[r.id]) for r in got.collect())


def test_sliced_window_spreads_a_hot_key(skewed):
    parted = with_history(skewed, ["key"], "at", ["id"], 86_400.0, number="n")
    plan = parted._jdf.queryExecution().toString()
    assert "hashpartitioning(key" in plan and "_slice" in plan


@pytest.mark.parametrize("few_groups", [True, False])
def test_percentiles_are_exact(skewed, few_groups):
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.key: r for r in exact_percentiles(skewed, ["key"], F.col("value"), wanted, few_groups=few_groups, one_task_rows=0).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.key, []).append(r.value)
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, p in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p)), (key, name)


def test_percentiles_without_groups_and_with_one_value(spark):
    df = spark.createDataFrame([(5.0,)] * 50 + [(None,)], "v double")
    row = exact_percentiles(df, [], F.col("v"), {"m": 0.5}, one_task_rows=0).first()
    assert row.m == 5.0


def test_salted_join_equals_join(skewed):
    small = skewed.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = salted_join(skewed, small, ["key"], F.col("id"), 8, how).select("key", "id", "n")
        assert got.exceptAll(skewed.join(small, ["key"], how).select("key", "id", "n")).count() == 0
        assert got.count() == skewed.join(small, ["key"], how).count()


def test_skew_join_equals_join_and_splits_only_hot_keys(skewed):
    small = skewed.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        for limits in ({"hot_rows": 100}, {"hot_rows": 10_000}, {"hot_rows": 1, "max_hot_keys": 1}):
            got = skew_join(skewed, small, ["key"], F.col("id"), 8, how, **limits).select("key", "id", "n")
            want = skewed.join(small, ["key"], how).select("key", "id", "n")
            assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def _edge_distance(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy), t


def test_distance_join_against_brute_force(spark):
    rng = random.Random(3)
    # a third of all points sits in one spot of the grid
    points = [(i, 50.0 + (0.001 * rng.random() if i % 3 == 0 else rng.random()), 9.0 + (0.001 * rng.random() if i % 3 == 0 else rng.random())) for i in range(300)]
    lines = [(f"L{j}", [(k, 50.0 + rng.random(), 9.0 + rng.random()) for k in range(5)]) for j in range(6)]
    p = spark.createDataFrame(points, "pid int, latitude double, longitude double")
    lines_df = spark.createDataFrame(lines, "lid string, geometry array<struct<ordinal:int,latitude:double,longitude:double>>")
    got = {(r.pid, r.lid): r for r in distance_join(p, lines_df, ["pid"], ["lid"], 5000.0).collect()}
    from strom.config import Config

    salted = {(r.pid, r.lid) for r in distance_join(p, lines_df, ["pid"], ["lid"], 5000.0, Config(broadcast_rows=0, hot_rows=40)).collect()}
    xy = {r.pid: (r.x, r.y) for r in with_utm32(p, "latitude", "longitude", "x", "y").collect()}
    flat = spark.createDataFrame([(lid, k, la, lo) for lid, vs in lines for k, la, lo in vs], "lid string, k int, la double, lo double")
    vertices = {}
    for r in with_utm32(flat, "la", "lo", "x", "y").orderBy("lid", "k").collect():
        vertices.setdefault(r.lid, []).append((r.x, r.y))
    want = {}
    for pid, (px, py) in xy.items():
        for lid, vs in vertices.items():
            best, run = None, 0.0
            for a, b in zip(vs, vs[1:]):
                d, t = _edge_distance(px, py, a, b)
                length = math.hypot(b[0] - a[0], b[1] - a[1])
                if best is None or d < best[0]:
                    best = (d, run + t * length)
                run += length
            if best[0] <= 5000.0:
                want[(pid, lid)] = best
    assert set(got) == set(want) == salted and want
    for key, (d, offset) in want.items():
        assert got[key].distance_m == pytest.approx(d, abs=1e-6) and got[key].offset_m == pytest.approx(offset, abs=1e-4)


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(i, 47.5 + 7 * rng.random(), 6 + 9 * rng.random()) for i in range(120)], "pid int, latitude double, longitude double")
    sites = spark.createDataFrame([(f"s{i}", 47.5 + 7 * rng.random(), 6 + 9 * rng.random()) for i in range(15)], "sid string, latitude double, longitude double")
    ps = with_utm32(points, "latitude", "longitude", "x", "y").collect()
    ss = with_utm32(sites, "latitude", "longitude", "x", "y").collect()
    for radius in (None, 60_000.0):
        got = {r.pid: r for r in nearest(points, sites, ["pid"], "sid", radius).collect()}
        assert len(got) == 120
        for p in ps:
            d, sid = min((math.hypot(p.x - s.x, p.y - s.y), s.sid) for s in ss)
            if radius is not None and d > radius:
                assert got[p.pid].sid is None
            else:
                assert got[p.pid].sid == sid and got[p.pid].distance_m == pytest.approx(d)


def test_interval_join_pairs_once(spark):
    rng = random.Random(9)
    left = [("r", i, s := rng.random() * 100, s + rng.random() * 30) for i in range(60)]
    right = [("r", i, s := rng.random() * 100, s + rng.random() * 5) for i in range(60)]
    a = spark.createDataFrame(left, "k string, i int, ls double, le double")
    b = spark.createDataFrame(right, "k string, j int, rs double, re double")
    got = {(r.i, r.j): r.overlap for r in interval_join(a, b, "k", ("ls", "le"), ("rs", "re"), 7.0).collect()}
    want = {(x[1], y[1]): min(x[3], y[3]) - max(x[2], y[2]) for x in left for y in right if max(x[2], y[2]) < min(x[3], y[3])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_duplicates_and_rejects(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, -1.0), ("b", 3, -1.0), ("b", 4, 5.0), (None, 5, 5.0), (None, 6, 5.0)], "key string, seq int, kw double")
    rows = {r.seq: r for r in quality.validate(df, [quality.positive_power("kw")], ["key"], "seq").collect()}
    assert [rows[i].quality_status for i in range(1, 7)] == ["accepted", "rejected", "rejected", "duplicate", "accepted", "accepted"]
    assert rows[2].quality_rules == "positive_power[kw]; no_duplicate_key"
    report = quality.quality_report(quality.validate(df, [quality.positive_power("kw")], ["key"], "seq"))
    assert quality.check_acceptance(report) == 0.5
    with pytest.raises(ValueError):
        quality.check_acceptance(report, strict=True, minimum=0.9, min_rows=1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intervals_are_not_broadcast_by_their_estimate(spark):
    a = spark.createDataFrame([("r", 1, 0.0, 10.0), ("r", 2, 10.0, 20.0)], "k string, i int, ls double, le double")
    b = spark.createDataFrame([("r", 1, 5.0, 15.0)], "k string, j int, rs double, re double")
    pairs = interval_join(a, b, "k", ("ls", "le"), ("rs", "re"), 7.0)
    assert "Broadcast" not in _plan(pairs) and {(r.i, r.j, r.overlap) for r in pairs.collect()} == {(1, 1, 5.0), (2, 1, 5.0)}


def test_few_repeated_keys_move_no_row(spark):
    rows = [("a", 1.0, "x2"), ("a", 1.0, "x1"), ("a", 2.0, "x3"), ("b", 0.0, "x4"), ("b", -0.0, "x5"), ("c", 1.0, None), ("d", 1.0, None), ("d", 1.0, "x6"),
            ("e", 1.0, "x7"), ("e", 1.0, "x7"), ("e", 1.0, "x8"), (None, 1.0, "x9"), ("f", None, "x1"), ("f", None, "x2")]
    df = spark.createDataFrame(rows, "key string, part double, seq string")
    few = quality.mark_duplicates(df, ["key", "part"], "seq")
    many = quality.mark_duplicates(df, ["key", "part"], "seq", cfg=Config(broadcast_rows=0))
    assert "hashpartitioning" not in _plan(few) and "hashpartitioning" in _plan(many)
    show = lambda found: sorted(((r.key or "", r.part or 0.0, r.seq or "", r.is_duplicate) for r in found.collect()))
    assert show(few) == show(many) and sum(r[3] for r in show(few)) == 5


def test_first_broken_rule_tells_its_message(spark):
    df = spark.createDataFrame([(1, -1.0, None), (2, 5.0, None), (3, 5.0, "x")], "seq int, kw double, city string")
    silent = quality.Rule("silent", F.col("kw") < 0, F.lit(None).cast("string"))
    found = {r.seq: r for r in quality.validate(df, [silent, quality.required_field("city")]).collect()}
    assert [found[i].quality_rules for i in (1, 2, 3)] == ["silent; required_field[city]", "required_field[city]", ""]
    assert [found[i].quality_rule for i in (1, 2, 3)] == ["silent", "required_field[city]", None]
    assert [found[i].quality_message for i in (1, 2, 3)] == [None, "city is missing or blank", None]


def test_monotonic_violations(spark):
    df = spark.createDataFrame([("v", i, datetime(2024, 1, 1, 0, m)) for i, m in enumerate([0, 5, 3, 4, 6])], "k string, seq int, at timestamp")
    assert {r.seq for r in quality.monotonic_violations(df, "k", "at", "seq").collect()} == {2, 3}


def test_expression_unknown_counts_as_failure(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (None, 2)], "a int, b int")
    assert checks.expression_is_true(df, "a <= b").count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "k string, v int, note string")
    new = spark.createDataFrame([("a", 1, "changed note"), ("b", 3, "y"), ("c", 4, "z")], "k string, v int, note string")
    snapshot, touched = upsert.upsert_changed(old, new, "k", ["v"])
    assert {(r.k, r.v, r.note) for r in snapshot.collect()} == {("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")}
    assert {(r.k, r.action) for r in touched.collect()} == {("b", "updated"), ("c", "inserted")}
    again, touched = upsert.upsert_changed(snapshot, new, "k", ["v"])
    assert touched.count() == 0 and again.exceptAll(snapshot).count() == 0
    with pytest.raises(ValueError):
        upsert.upsert_all(old, new.drop("note"), "k")
