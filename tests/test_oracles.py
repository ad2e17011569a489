"""Registered queries against their DuckDB oracles. ``STROM_ALL=1`` runs every one of them."""

import os

import pytest

from tests.harness import SF_DIR, compare, connect
from strom.registry import all_oracles, all_queries

CORE = (
    "trip_energy", "fct_trips", "fct_vehicle_telemetry", "stg_charging_stations", "station_power", "dim_charging_station", "charging_infrastructure",
    "corridor_stations", "corridor_coverage", "coverage_query", "coverage_query_geometry", "underserved", "region_comparison", "live_vehicles", "trip_series",
    "energy_by_congestion", "dashboard_summary", "quality_by_source", "validate_station", "quality_report", "monotonic_violations",
    "check_orphan_segments", "mart_route_energy", "traffic_impact", "event_lines_on_segments", "nearest_observation", "segment_polyline",
    "dominant_class", "segment_energy", "driver_ladder", "route_analysis", "window_features", "clean_training_windows", "grouped_split",
    "extract_validity", "read_register_csv", "read_traffic_json", "upsert_changed", "incremental_delete_insert", "upsert_days", "distance_join", "segment_conditions", "stream_append",
    "stream_trip_totals", "exact_percentiles", "sliced_history",
)
# every demo corridor has a fast charger in the given tables; the smallest ones have no route with an orphan segment
EMPTY = {"uncovered_routes", "check_orphan_segments"}
NAMES = sorted(all_oracles()) if os.environ.get("STROM_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    verdict, detail = compare(spark, duck, name, all_queries()[name], all_oracles()[name])
    assert verdict == "ok" or (verdict == "empty" and name in EMPTY), f"{verdict} {detail}"
