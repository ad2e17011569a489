"""Figures of the points near each line: the results are those of all pairs, and no pair becomes a row."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from strom.operators.spatial import distance_join, line_edges
from strom.operators.tiles import along_lines, one_row_each
from strom.plans import analysis, chargeplan, corridors, traffic
from strom.registry import corridors as C
from strom.registry import streams

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
LINE = "geometry array<struct<ordinal: int, latitude: double, longitude: double>>"


def walk(rng, steps, step=0.3):
    lat, lon, out = 50 + rng.random(), 9 + rng.random(), []
    for i in range(steps):
        out.append((i, lat, lon))
        lat, lon = lat + rng.uniform(-step, step), lon + rng.uniform(-step, step)
    return out


def places(rng, count):
    return [(49.5 + 2 * rng.random(), 8.5 + 2 * rng.random()) for _ in range(count)]


def near_rows(rows):
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows)


def same(a, b):
    """Rows alike but for the rounding of sums."""
    a, b = (sorted((tuple(r) for r in rows), key=lambda r: tuple(str(round(v, 1) if isinstance(v, float) else v) for v in r)) for rows in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(math.isclose(p, q, abs_tol=2e-3) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("by_spot", [False, True])
def test_hits_equal_the_pairs_of_the_distance_join(spark, by_spot):
    rng = random.Random(1)
    spots = places(rng, 1500)
    lines = {f"r{i}": walk(rng, 12) for i in range(20)} | {"again": walk(rng, 2) * 2, "dot": [(0, *spots[0]), (1, *spots[0])], "far": [(0, 40.0, 9.0), (1, 40.0, 9.1)], "none": None}
    line_df = spark.createDataFrame([*lines.items(), (None, walk(rng, 3))], f"route_id string, {LINE}")
    points = spark.createDataFrame([(f"s{i}", *p) for i, p in enumerate(spots)] + [("nowhere", None, 9.0), ("odd", float("nan"), 9.0)], "station_id string, latitude double, longitude double")
    want = distance_join(points, line_df, ["station_id"], ["route_id"], 5000.0).select("route_id", "station_id", "distance_m", "offset_m").collect()

    def all_of(hits):
        return list(zip(hits.of("station_id"), hits.distance.tolist(), hits.offset().tolist()))

    got = along_lines(points, line_edges(line_df, ["route_id"]), "route_id", 5000.0, all_of, "station_id string, distance_m double, offset_m double",
                      rank=["edge_no", "edge_start_m"], by_spot=by_spot, tile_m=20_000.0).collect()
    assert len(want) > 1000
    same(got, want)


def network(spark, monkeypatch):
    rng = random.Random(2)
    segments = []
    for r in range(12):
        vertices = walk(rng, 30, 0.08)
        for j, (a, b) in enumerate(zip(vertices, vertices[1:])):
            segments.append((f"G{r}-{j}", f"R{r}", j * 6e3, 6e3 + 50 * (j % 5), [(0, *a[1:]), (1, *b[1:])]))
    segments.append(("G0-3", "R0", 18e3, 6e3, segments[3][4]))
    sites = [(f"S{i}", float(rng.choice([20, 50, 150, 150, 300])), *p) for i, p in enumerate(places(rng, 1500))]
    sites += [sites[0], (None, 400.0, *sites[5][2:])]
    monkeypatch.setattr(C, "stg_routes", lambda t: None)
    monkeypatch.setattr(C, "routed_segments", lambda t, routes: spark.createDataFrame(
        segments, f"route_segment_id string, route_id string, start_offset_m double, segment_distance_m double, {LINE}"))
    monkeypatch.setattr(C, "stg_stations", lambda t: spark.createDataFrame(sites, "station_id string, max_power_kw double, latitude double, longitude double"))


def test_best_sites_of_corridors_equal_those_of_all_pairs_without_broadcasting_segments(spark, monkeypatch):
    network(spark, monkeypatch)
    placed, closest = [], C.closest_spots
    monkeypatch.setattr(C, "closest_spots", lambda points, edges, *more, **named: placed.append(edges) or closest(points, edges, *more, **named))
    pairs = C.corridor_candidates(None).withColumn("offset_km", F.col("offset_m") / 1000.0).cache()
    assert "BroadcastHashJoin" not in placed[0]._jdf.queryExecution().executedPlan().toString()
    few = streams._candidates(None)
    thin = chargeplan.thin_candidates(few, ["route_id"]).select("route_id", "station_id", "offset_km").collect()
    same(thin, chargeplan.thin_candidates(pairs, ["route_id"]).select("route_id", "station_id", "offset_km").collect())
    assert few.count() * 1.5 < pairs.count() and len(thin) > 50
    strongest = {r.route_id: r.station_id for r in C.strongest_in_range(None).collect()}
    inside = pairs.where("offset_m between 50000 and 150000").collect()
    want = {}
    for r in inside:
        want.setdefault(r.route_id, []).append((-r.max_power_kw, r.offset_m, r.station_id))
    assert strongest == {route: min(rows, key=lambda x: x[:2])[2] for route, rows in want.items()} and len(want) > 5


def test_a_site_in_two_places_still_counts_once_per_corridor(spark, monkeypatch):
    network(spark, monkeypatch)
    moved = C.stg_stations(None).union(spark.createDataFrame([("S7", 150.0, 50.2, 9.2)], "station_id string, max_power_kw double, latitude double, longitude double"))
    moved = moved.withColumn("max_power_kw", F.when(F.col("station_id") == "S7", 150.0).otherwise(F.col("max_power_kw")))
    monkeypatch.setattr(C, "stg_stations", lambda t: moved)
    assert one_row_each(moved, ["station_id", "max_power_kw"]) is None
    same(C.corridor_candidates(None, pick=corridors.best_per_stretch(10.0)).collect(), C.corridor_candidates(None).collect())


def stations_and_routes(spark, count=1200):
    rng = random.Random(3)
    routes = [(f"R{i}", "s", f"n{i}", 264e3, walk(rng, 12)) for i in range(15)]
    # to and fro on the same line, the same vertex twice, far from all sites, a route of one vertex
    there = walk(rng, 6)
    routes += [("back", "s", "b", 1e5, there + there[::-1]), ("stay", None, "t", 1e5, there[:3] + there[2:]), ("far", "s", "f", 1e5, [(0, 40.0, 9.0), (1, 40.0, 9.1)]), ("R-", "s", "x", 0.0, there[:1])]
    routes = [(*r[:4], [(k, *v[1:]) for k, v in enumerate(r[4])]) for r in routes]
    sites = [(f"S{i}", rng.choice([None, 20.0, 50.0, 150.0]), rng.choice([None, True, False]), *p) for i, p in enumerate(places(rng, count))]
    sites += [sites[0], (None, 50.0, True, *sites[9][3:]), ("twin", 50.0, True, *sites[9][3:]), ("lost", 50.0, True, None, 9.0)]
    return (spark.createDataFrame(routes, f"route_id string, slug string, name string, distance_m double, {LINE}"),
            spark.createDataFrame(sites, "station_id string, max_power_kw double, is_fast_charger boolean, latitude double, longitude double"))


@pytest.mark.parametrize("options", [{}, {"top_gaps": 3, "min_reported_gap_km": 5.0}, {"count_all_stations": False, "include_geometry": True}])
def test_gaps_of_routes_equal_those_of_all_pairs_without_pairs(spark, monkeypatch, options):
    routes, stations = stations_and_routes(spark)
    with monkeypatch.context() as patched:
        patched.setattr(corridors, "one_row_each", lambda points, key: None, raising=False)
        want = corridors.coverage_query(routes, stations, **options).collect()

    def refused(*given, **named):
        raise AssertionError("pairs of site and route")

    monkeypatch.setattr(corridors, "distance_join", refused)
    got = corridors.coverage_query(routes, stations, **options).collect()
    assert len(want) > 40 and {r.route_id for r in want} >= {"back", "stay", "far"}
    same([[r[c] for c in want[0].__fields__] for r in got], want)


def test_painted_routes_equal_those_of_all_pairs_from_few_events(spark):
    rng = random.Random(4)
    routes = spark.createDataFrame([(f"R{i}", walk(rng, 12)) for i in range(10)], f"route_id string, {LINE}")
    events = [(f"T{i}", None, None, rng.choice(["low", "moderate", "high", "severe", None]), rng.choice([None, False, False, False, True]), "A1", *p)
              for i, p in enumerate(places(rng, 3000))]
    events += [events[0], (None, None, None, "high", False, "A1", *events[9][6:])]
    events = spark.createDataFrame(events, "traffic_event_id string, starts_at timestamp, ends_at timestamp, severity string, is_blocked boolean, road_name string, latitude double, longitude double")
    lengths = line_edges(routes, ["route_id"]).select("route_id", "line_m").distinct()
    every, few = traffic.events_along_route(routes, events, AT, 3000.0), traffic.worst_along_route(routes, events, AT, 3000.0)
    want = sorted(map(tuple, traffic.paint_events(every, lengths).collect()))
    assert sorted(map(tuple, traffic.paint_events(few, lengths).collect())) == want and {r[2] for r in want} >= {"severe", "high", None}
    assert few.count() * 1.5 < every.count()


def test_impact_of_events_equals_that_of_all_pairs_without_pairs(spark, monkeypatch):
    rng = random.Random(6)
    segments = [(f"G{i}", rng.choice(["R1", "R2", None]), float(i), walk(rng, 2, 0.1)) for i in range(400)] + [(None, "R1", 1.0, walk(rng, 2))]
    segments = spark.createDataFrame(segments, f"route_segment_id string, route_id string, segment_distance_km double, {LINE}")
    events = [(f"T{i}", rng.randrange(100), *p) for i, p in enumerate(places(rng, 2500))]
    events += [events[0], ("T1", 100, *events[1][2:]), (None, 7, *events[9][2:]), ("lost", 3, None, 9.0)]
    events = spark.createDataFrame(events, "traffic_event_id string, _group long, latitude double, longitude double")

    def figures():
        touched, matched = traffic._touched(events, segments, 2000.0, traffic.DEFAULT)
        return sorted(map(tuple, touched.collect())), sorted((r["_group"], r["corridor_matched_event_count"]) for r in matched.collect() if r["corridor_matched_event_count"])

    with monkeypatch.context() as patched:
        patched.setattr(traffic, "one_row_each", lambda points, key: None)
        want = figures()
    monkeypatch.setattr(traffic, "distance_join", None)
    monkeypatch.setattr("strom.operators.tiles.MOST_EDGES", 60)  # several tasks for a tile
    assert figures() == want and len(want[0]) > 100 and len(want[1]) > 50


def test_tallies_of_event_lines_equal_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    segments = spark.createDataFrame([(f"G{i}", walk(rng, 2, 0.2)) for i in range(300)] + [("none", None), (None, walk(rng, 2))], f"route_segment_id string, {LINE}")
    events = [(f"T{i}", None, None, rng.choice(["low", "high", None]), *p, [(0, *p), (1, p[0] + rng.uniform(-0.3, 0.3), p[1] + rng.uniform(-0.3, 0.3))] if i % 3 else None)
              for i, p in enumerate(places(rng, 600))]
    events = spark.createDataFrame(events + [("lost", None, None, "high", None, 9.0, None)], f"traffic_event_id string, starts_at timestamp, ends_at timestamp, severity string, latitude double, longitude double, {LINE}")
    tally = analysis.severity_tally(events)

    def figures(rows):
        out = rows.groupBy("route_segment_id").agg(F.max("severity_ordinal").alias("m"), F.sum("event_rows").alias("n"))
        return sorted((r.route_segment_id, r.m, r.n) for r in out.collect() if r.route_segment_id)

    want = figures(traffic.event_lines_on_segments(events, segments, AT, 1500.0, keep=tally))
    twice = events.union(events.limit(20))
    want_twice = figures(traffic.event_lines_on_segments(twice, segments, AT, 1500.0, keep=analysis.severity_tally(twice)))
    assert figures(traffic.event_tally_on_segments(twice, segments, AT, 1500.0, analysis.severity_tally(twice))) == want_twice
    monkeypatch.setattr(traffic, "event_lines_on_segments", None)
    found = traffic.event_tally_on_segments(events, segments, AT, 1500.0, tally)
    assert figures(found) == want and len(want) > 150 and sum(r[2] for r in want) > 5 * found.count() / 2
