"""Rules that once lost rows or departed from the definition."""

import math

import pytest
from pyspark.sql import functions as F

from strom.functions.energy import consumption_kwh_per_100km
from strom.operators.nearest import nearest
from strom.operators.sizes import is_small
from strom.operators.spatial import distance_join
from strom.operators.upsert import incremental_delete_insert, upsert_days
from strom.plans.fleet import live_vehicles
from strom.session import cut_lineage, drop_intermediates
from strom.streaming import messages, telemetry
from tests.test_streaming import at, deliver, message


def test_nearest_finds_sites_at_any_distance(spark):
    points = spark.createDataFrame([("p", 48.0, 9.0), ("q", 54.0, 9.0), ("none", None, None)], "point string, latitude double, longitude double")
    sites = spark.createDataFrame([("far", 38.0, 9.0), ("farther", 37.0, 9.0)], "site string, latitude double, longitude double")
    got = {r.point: (r.site, r.distance_m) for r in nearest(points, sites, ["point"], "site").collect()}
    assert got["p"][0] == "far" and 1_100_000 < got["p"][1] < 1_120_000
    assert got["q"][0] == "far" and got["q"][1] > 1_700_000 and got["none"] == (None, None)
    assert all(r.site is None for r in nearest(points, sites.limit(0), ["point"], "site").collect())


def test_empty_target_loads_everything(spark):
    source = spark.sql("select id, timestamp_seconds(id) as at from range(5)")
    assert incremental_delete_insert(source.limit(0), source, "id", "at", 30).count() == 5


def stored(path):
    return {f.relative_to(path).as_posix(): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_touched_days_are_rewritten(spark, tmp_path):
    path = tmp_path / "fact"
    first = spark.sql("select id, timestamp '2024-01-01 12:00:00' + make_dt_interval(cast(id as int)) as at, 'old' as v from range(4)")
    assert len(upsert_days(str(path), first, "id", "at", 60)) == 4
    before = stored(path)
    # key 3 comes again on its day, key 9 is new on the next day, key 0 lies before the look-back and is not read
    more = spark.sql("select * from values (3, timestamp '2024-01-04 12:00:00', 'new'), (9, timestamp '2024-01-05 01:00:00', 'new'), (0, timestamp '2024-01-01 12:00:00', 'new') as t(id, at, v)")
    more = more.withColumn("id", F.col("id").cast("bigint"))
    assert [str(d) for d in upsert_days(str(path), more, "id", "at", 60, key_moves=False)] == ["2024-01-04", "2024-01-05"]
    after = stored(path)
    assert {k: v for k, v in before.items() if "01-04" not in k} == {k: v for k, v in after.items() if "01-04" not in k and "01-05" not in k}
    assert {r.id: r.v for r in spark.read.parquet(str(path)).collect()} == {0: "old", 1: "old", 2: "old", 3: "new", 9: "new"}


def test_a_key_that_moves_leaves_its_old_day(spark, tmp_path):
    path = str(tmp_path / "fact")
    upsert_days(path, spark.sql("select 1 as id, timestamp '2024-01-01 12:00:00' as at"), "id", "at", 60)
    upsert_days(path, spark.sql("select 1 as id, timestamp '2024-01-03 12:00:00' as at"), "id", "at", 60)
    assert [str(r.dt) for r in spark.read.parquet(path).collect()] == ["2024-01-03"]
    assert upsert_days(path, spark.sql("select 1 as id, timestamp '2023-01-03 12:00:00' as at"), "id", "at", 60) == []


def test_points_without_a_position_match_nothing_and_are_projected_once(spark):
    line = spark.sql("select 'l' as line, array(named_struct('ordinal', 0, 'latitude', 50.0D, 'longitude', 9.0D), named_struct('ordinal', 1, 'latitude', 50.1D, 'longitude', 9.0D)) as geometry")
    points = spark.createDataFrame([("a", 50.05, 9.001), ("b", None, 9.0), ("c", 50.05, None)], "point string, latitude double, longitude double")
    near = distance_join(points, line, ["point"], ["line"], 500.0)
    assert [r.point for r in near.collect()] == ["a"]
    filters = [x for x in near._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("ATANH" in x for x in filters)


def test_intermediates_are_deleted_when_asked(spark):
    df = cut_lineage(spark.range(3))
    assert df.count() == 3 and drop_intermediates(spark) >= 1 and drop_intermediates(spark) == 0


def test_zero_distance_consumes_nothing_per_100km(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (2.0, 0.0), (2.0, None)], "kwh double, km double")
    assert [r[0] for r in rows.select(consumption_kwh_per_100km(F.col("kwh"), F.col("km"))).collect()] == [20.0, 0.0, None]


def test_small_means_few_rows_and_few_bytes(spark, monkeypatch):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert is_small(df, 100) and not is_small(df, 99)
    monkeypatch.setattr("strom.operators.sizes.MAX_BROADCAST_BYTES", 50_000)
    assert not is_small(df, 100) and is_small(df.select("id"), 100)


def test_cap_beyond_the_limit_is_an_error():
    with pytest.raises(ValueError):
        live_vehicles(None, None, None, cap=1001)


def test_delta_feed_resumes_without_skipping(spark):
    states = spark.createDataFrame([(f"v{i}", i // 3) for i in range(10)], "vehicle_id string, recorded_at int")
    seen, since, after = [], -1, None
    while rows := telemetry.delta_feed(states, since, 2, after).collect():
        seen += [r.vehicle_id for r in rows]
        since, after = rows[-1].recorded_at, rows[-1].vehicle_id
    assert seen == [f"v{i}" for i in range(10)]


def test_counters_cover_every_batch(spark, tmp_path):
    for i in range(12):
        deliver(tmp_path / "in", i, message(f"m{i}", at(i)), "{broken")
    stream = messages.parse_envelope(messages.read_messages(spark, str(tmp_path / "in"), files_per_trigger=1), "telemetry")
    totals = telemetry.run_counted(stream, telemetry.append_batch(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert (totals.consumed, totals.rejected) == (24, 12) and totals.batches >= 12
    assert not math.isnan(totals.last_batch)
