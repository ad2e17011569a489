"""Joins of points and lines: no pair is shuffled or sorted, and the results are those of comparing everything."""

import math
import random
from datetime import datetime, timezone
from types import SimpleNamespace

from pyspark.sql import functions as F

from strom.functions.geo import with_utm32
from strom.operators import spatial
from strom.operators import nearest as nearest_module
from strom.operators.nearest import _finer, nearest
from strom.operators.spatial import closest_spots, distance_join, line_edges
from strom.plans.traffic import event_lines_on_segments, paint_events
from strom.plans.weather import route_weather
from strom.registry import corridors

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
LINE = "geometry array<struct<ordinal: int, latitude: double, longitude: double>>"


def walk(rng, steps, step=0.02):
    lat, lon, out = 50 + rng.random() / 5, 9 + rng.random() / 5, []
    for i in range(steps):
        out.append((i, lat, lon))
        lat, lon = lat + rng.uniform(-step, step), lon + rng.uniform(-step, step)
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def metres(spark, rows):
    """(x, y) of every (latitude, longitude)."""
    at = with_utm32(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, latitude double, longitude double"), "latitude", "longitude", "x", "y")
    return [(r.x, r.y) for r in at.orderBy("i").collect()]


def test_spots_on_lines_of_many_edges_equal_brute_force_and_shuffle_no_pair(spark):
    rng = random.Random(3)
    lines = {"short": walk(rng, 2), "long": walk(rng, 40, 0.003), **{f"r{i}": walk(rng, 6) for i in range(8)}}
    points = [(f"p{i}", 50 + rng.random() / 4, 9 + rng.random() / 4) for i in range(200)]
    points += [("p0", 50.1, 9.1), ("p1", *points[1][1:]), (None, 50.1, 9.1), (None, 50.15, 9.12), ("nowhere", None, 9.0)]
    line_df = spark.createDataFrame(list(lines.items()), f"route_id string, {LINE}")
    point_df = spark.createDataFrame(points, "station_id string, latitude double, longitude double")
    got = {(r.route_id, r.station_id): (r.distance_m, r.offset_m) for r in distance_join(point_df, line_df, ["station_id"], ["route_id"], 1500.0).collect()}
    where = [p for p in points if p[1] is not None]
    spots = metres(spark, [p[1:] for p in where])
    want = {}
    for name, vertices in lines.items():
        xy, before = metres(spark, [v[1:] for v in vertices]), 0.0
        for (x0, y0), (x1, y1) in zip(xy, xy[1:]):
            length = math.hypot(x1 - x0, y1 - y0)
            for (station, *_), (px, py) in zip(where, spots):
                along = max(0.0, min(length, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / length))
                far = math.hypot(px - x0 - along / length * (x1 - x0), py - y0 - along / length * (y1 - y0))
                if far <= 1500.0:
                    want[name, station] = min(want.get((name, station), (math.inf, 0.0)), (far, before + along))
            before += length
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-6) for k in want for a, b in zip(got[k], want[k]))
    once = distance_join(point_df.where("station_id is not null").dropDuplicates(["station_id"]), line_df, ["station_id"], ["route_id"], 1500.0)
    plan = plan_of(once)
    assert "hashpartitioning(route_id" not in plan and "hashpartitioning(station_id" not in plan and "Aggregate" not in plan


def test_edges_of_a_group_of_lines_count_as_one_line(spark):
    edges = line_edges(spark.createDataFrame([
        ("a", [(0, 50.0, 9.0), (1, 50.0, 9.02)]), ("b", [(0, 50.005, 9.0), (1, 50.005, 9.02)]), ("c", [(0, 50.0, 9.0), (1, 50.0, 9.02)]),
    ], f"part string, {LINE}"), ["part"]).withColumn("whole", F.when(F.col("part") == "c", "y").otherwise("x"))
    points = spark.createDataFrame([(1, 50.004, 9.01), (2, 50.0, 9.01)], "id int, latitude double, longitude double")
    best = closest_spots(points, edges, ["id"], ["whole"], 2000.0, lambda d, o, e: F.struct(F.round(d, 6).alias("m"), e("part").alias("part")))
    assert {(r.id, r.whole, r._best.part) for r in best.collect()} == {(1, "x", "b"), (1, "y", "c"), (2, "x", "a"), (2, "y", "c")}


def test_painting_keeps_the_worst_severity_without_sorting(spark):
    placed = spark.createDataFrame([("r", 100.0, "low", False), ("r", 120.0, "high", False), ("r", 6_000.0, "moderate", True), ("r", 9_900.0, None, False)],
                                   "route_id string, offset_m double, severity string, is_blocked boolean")
    lengths = spark.createDataFrame([("r", 10_000.0)], "route_id string, line_m double")
    painted = paint_events(placed, lengths)
    got = {r.bin: r.severity for r in painted.collect()}
    assert got == {b: "high" if b <= 4 else "severe" if 8 <= b <= 16 else None for b in range(20)}
    assert "SortAggregate" not in plan_of(painted)


def test_event_lines_meet_each_segment_once_without_a_distinct(spark):
    rng = random.Random(5)
    active = f"traffic_event_id string, starts_at timestamp, ends_at timestamp, latitude double, longitude double, {LINE}"
    events = [(f"e{i}", None, None, 50.0, 9.0, walk(rng, 2, 0.2) if i % 2 else None) for i in range(60)]
    segments = spark.createDataFrame([(f"g{i}", walk(rng, 2, 0.2)) for i in range(60)], f"route_segment_id string, {LINE}")
    pairs = event_lines_on_segments(spark.createDataFrame(events, active), segments, AT, 1500.0)
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) > 100
    assert "hashpartitioning(traffic_event_id" not in plan_of(pairs)
    # the same lines twice, and cut at an additional vertex: the same pairs
    twice = event_lines_on_segments(spark.createDataFrame(events + events, active), segments.union(segments), AT, 1500.0)
    again = [tuple(r) for r in twice.collect()]
    assert len(again) == len(set(again)) and set(again) == set(found)


def test_nearest_starts_with_cells_of_about_one_site(spark):
    rng = random.Random(9)
    sites = [(i, 50 + rng.random(), 9 + rng.random()) for i in range(2000)]
    site_df = spark.createDataFrame(sites, "site int, latitude double, longitude double")
    rings = _finer(with_utm32(site_df, "latitude", "longitude", "sx", "sy"), 15_000.0)
    assert rings and rings[0] < 5_000.0 and all(r < 15_000.0 for r in rings)
    points = spark.createDataFrame([(i, 49.5 + 2 * rng.random(), 8.5 + 2 * rng.random()) for i in range(100)], "id int, latitude double, longitude double")
    got = {r.id: r.site for r in nearest(points, site_df, ["id"], "site").collect()}
    xy = metres(spark, [s[1:] for s in sites])
    for p, (px, py) in zip(sorted(points.collect()), metres(spark, [(p.latitude, p.longitude) for p in sorted(points.collect())])):
        assert got[p.id] == min(range(len(xy)), key=lambda i: (math.hypot(xy[i][0] - px, xy[i][1] - py), i))


def test_weather_of_routes_counts_stations_without_a_distinct(spark):
    routes = spark.createDataFrame([("r", [(0, 50.0, 9.0), (1, 50.0, 9.5)])], f"route_id string, {LINE}")
    readings = spark.createDataFrame([("w1", AT, 50.01, 9.1, 1.0, 0.0, 2.0), ("w1", AT, 50.01, 9.1, 3.0, 0.0, 2.0), ("w2", AT, 50.01, 9.2, 5.0, 0.0, 2.0)],
        "weather_station_id string, observed_at timestamp, latitude double, longitude double, temperature_c double, precipitation_mm double, wind_speed_ms double")
    weather = route_weather(routes, readings, AT, 25_000.0)
    assert [(r.temperature_c, r.station_count) for r in weather.collect()] == [(3.0, 2)]
    assert "hashpartitioning(route_id, weather_station_id" not in plan_of(weather)


def test_nearest_segments_of_crowded_cells_equal_brute_force_and_meet_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    lines = {f"g{i}": walk(rng, 2, 0.02) for i in range(500)}
    lines |= {"a": lines["g7"], "h": lines["g8"], "many": walk(rng, 5, 0.01), "dot": [(0, 50.1, 9.1), (1, 50.1, 9.1)], "none": None}
    points = [(i, 50 + rng.random() / 4, 9 + rng.random() / 4) for i in range(900)]
    points += [(i, 50 + rng.random() / 50, 9 + rng.random() / 50) for i in range(900, 1500)] + [(0, *points[5][1:]), (None, 50.1, 9.1), (2000, None, 9.0), (2001, 55.0, 9.0)]
    wide = spark.createDataFrame(list(lines.items()), f"id string, {LINE}")
    for column in ("route_id", "ordinal", "start_offset_m", "distance_m", "road_class", "speed_limit_kmh", "assumed_speed_kmh", "elevation_gain_m",
                   "temperature_c", "traffic_severity", "predicted_kwh_per_100km", "predicted_kwh", "energy_intensity"):
        wide = wide.withColumn(column, F.lit(1))
    telemetry = spark.createDataFrame([(*p, "driving") for p in points], "telemetry_id int, latitude double, longitude double, state string")
    met = []

    def seen(*given, **named):
        met.append(matches(*given, **named))
        return met[0]

    matches = corridors.edge_matches
    monkeypatch.setattr(corridors, "edge_matches", seen)
    monkeypatch.setattr(spatial, "_CROWDED", 2, raising=False)  # few rows are enough to cut cells several times
    got = {r.telemetry_id: (r.route_segment_id, r.distance_m) for r in corridors.points_to_segments(SimpleNamespace(route_segments=wide, telemetry=telemetry)).collect()}
    where = [p for p in points if p[1] is not None]
    spots, edges = metres(spark, [v[1:] for vertices in lines.values() for v in vertices or ()]), []
    for name, vertices in lines.items():
        xy = [spots.pop(0) for _ in vertices or ()]
        edges += [(name, *a, *b) for a, b in zip(xy, xy[1:])]
    want, pairs = {}, 0
    for (key, *_), (px, py) in zip(where, metres(spark, [p[1:] for p in where])):
        for name, x0, y0, x1, y1 in edges:
            length = math.hypot(x1 - x0, y1 - y0)
            share = max(0.0, min(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / length**2)) if length else 0.0
            far = math.hypot(px - x0 - share * (x1 - x0), py - y0 - share * (y1 - y0))
            if far <= 2000.0:
                pairs += 1
                want[key] = min(want.get(key, (math.inf, "")), (round(far, 6), name))
    assert got.keys() == want.keys() and len(want) > 1000
    assert all(got[k][0] == want[k][1] and abs(got[k][1] - want[k][0]) < 1e-3 for k in want)
    assert met[0].count() * 2 < pairs


def test_lines_without_geometry_have_no_edges_and_geometries_are_not_checked_at_the_scan(spark):
    lines = spark.createDataFrame([("a", walk(random.Random(1), 3)), ("a", None), ("b", None), ("c", []), (None, walk(random.Random(2), 2))], f"id string, {LINE}")
    edges = line_edges(lines, ["id"])
    assert sorted((r.id or "", r.edge_no) for r in edges.collect()) == [("", 1), ("a", 1), ("a", 2)]
    assert "size(" not in plan_of(edges)


def test_points_far_from_all_sites_meet_few_of_them(spark, monkeypatch):
    rng = random.Random(13)
    sites = [(i, 50 + rng.random(), 9 + rng.random()) for i in range(3000)] + [(3000, 50.5, 9.5), (3001, 50.5, 9.5), (3002, None, 9.0)]
    points = [(i, 50 + rng.random(), 15 + 10 * rng.random()) for i in range(300)] + [(300, 50.5, 9.5), (300, 50.5, 9.5), (301, 30.0, 9.5), (302, None, 9.0), (303, 50.5, 12.0)]
    site_df = spark.createDataFrame(sites, "site int, latitude double, longitude double")
    point_df = spark.createDataFrame(points, "id int, latitude double, longitude double")
    met, kept = [], nearest_module.cut_lineage

    def counted(df, **options):
        out = kept(df, **options)
        met.append(out.count())
        return out

    monkeypatch.setattr(nearest_module, "cut_lineage", counted)
    xy = metres(spark, [s[1:] for s in sites[:-1]])
    known = [p for p in points if p[1] is not None]
    best = {p[0]: min((math.hypot(x - px, y - py), i) for i, (x, y) in enumerate(xy)) for p, (px, py) in zip(known, metres(spark, [p[1:] for p in known]))}
    for radius in (None, 300_000.0):
        got = {r.id: (r.site, r.distance_m) for r in nearest(point_df, site_df, ["id"], "site", radius).collect()}
        assert got.keys() == {p[0] for p in points} and got[302] == (None, None)
        for key, (far, site) in best.items():
            assert got[key] == (None, None) if radius and far > radius else got[key][0] == site and math.isclose(got[key][1], far, abs_tol=1e-6)
    assert max(met) <= 20 * len(points)
    # the boxes a point goes on with, and no ring that holds every site
    far = nearest_module._descend(
        with_utm32(point_df.where("id < 300"), "latitude", "longitude", "px", "py"), with_utm32(site_df, "latitude", "longitude", "sx", "sy").select("site", "sx", "sy"),
        ["id"], "site", 1e7, 2_000.0, 2e6, nearest_module.DEFAULT)
    assert {r.id: r._b.site for r in far.collect()} == {i: best[i][1] for i in range(300)}
