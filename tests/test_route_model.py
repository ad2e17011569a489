"""Route answers served by a model: saved pipelines, cases, rescaling, modes."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strom.functions import energy
from strom.plans import learning, route_model


def fixed(expression):
    return PipelineModel(stages=[SQLTransformer(statement=f"select *, cast({expression} as double) as predicted from __THIS__")])


@pytest.fixture(scope="module")
def asked(spark):
    """Two segments of one route, one of them without time, and four requests in two cases."""
    conditions = spark.createDataFrame(
        [("s1", "r1", 0, "motorway", 120.0, "low", 20.0, 100.0, 100.0, 720.0, 10.0, 0.0, 3.0), ("s2", "r1", 1, "primary", None, "severe", 5.0, 60.0, 25.0, 720.0, -5.0, 1.0, 0.0)],
        "route_segment_id string, route_id string, segment_ordinal int, road_class string, speed_limit_kmh double, traffic_severity string, distance_km double, "
        "free_flow_speed_kmh double, speed_kmh double, duration_s double, temperature_c double, precipitation_mm double, wind_speed_ms double")
    models = spark.createDataFrame([("v1", 2100.0, 0.5, 0.009, 60.0, 16.0, 150.0)], "vehicle_model_id string, mass_kg double, drag_area_m2 double, "
                                   "rolling_resistance double, usable_capacity_kwh double, nominal_consumption_kwh_100km double, max_dc_power_kw double")
    requests = spark.createDataFrame([(1, "r1", "v1", 80.0), (2, "r1", "v1", 80.0), (3, "r1", "v1", 8.0), (4, "gone", "v1", 8.0)],
                                     "request_id bigint, route_id string, vehicle_model_id string, start_soc_percent double")
    driven = route_model.driven_energies(requests, conditions, models)
    return requests, driven, route_model.charge_cases(requests, driven)


def test_cases_are_scored_once(asked):
    requests, driven, cases = asked
    assert cases.count() == 2 and route_model.served_segments(driven, cases, fixed("20")).count() == 4


def test_the_parts_add_up_to_the_prediction(asked):
    _, driven, cases = asked
    for rate in (20.0, 0.0):
        for r in route_model.served_segments(driven, cases, fixed(rate)).collect():
            assert r.kwh == pytest.approx(rate * r.distance_km / 100.0) and r.physical_kwh > 0
            parts = sum(getattr(r, p) for p in energy.ENERGY_FIELDS if p not in ("kwh", "regen_kwh")) - abs(r.regen_kwh)
            assert parts == pytest.approx(r.kwh, abs=1e-6)
    assert all(r.kwh == 0 for r in route_model.served_segments(driven, cases, fixed("-5")).collect())  # no energy from a prediction below zero


def test_without_a_model_the_physics_is_served(spark, asked):
    requests, driven, cases = asked
    served = route_model.served_segments(driven, cases, None)
    modes = spark.createDataFrame([("r1", "live", "cache", "fixture", "fixture")], "route_id string, routing_mode string, weather_mode string, traffic_mode string, data_mode string")
    rows = {r.request_id: r for r in route_model.answers(requests, route_model.case_totals(served), modes, None).collect()}
    assert set(rows) == {1, 2, 3}  # nothing is known of the fourth's route
    assert rows[1].model_kwh_100km is None and rows[1].model_name is None and rows[1].baseline_kwh_100km == rows[1].avg_consumption_kwh_100km
    assert rows[3].charging_required and rows[3].arrival_soc_percent >= 0 and not rows[1].charging_required


def test_the_model_is_told_the_mean_charge(asked):
    _, driven, cases = asked
    physical = sum(r.kwh for r in driven.collect())
    told = {r.start_soc_percent: r.predicted_kwh_100km for r in route_model.served_segments(driven, cases, fixed("soc_percent")).collect()}
    assert told[80.0] == pytest.approx(80.0 - physical / 60.0 * 100.0 / 2) and told[8.0] == pytest.approx((8.0 + max(0.0, 8.0 - physical / 60.0 * 100.0)) / 2)


def test_what_the_model_adds_is_its_own_driver(asked):
    requests, driven, cases = asked
    totals = route_model.case_totals(route_model.served_segments(driven, cases, fixed("40")))
    rows = [r for r in route_model.drivers(requests, driven, totals).collect() if r.request_id == 1]
    wind = sum(r.kwh for r in driven.collect())
    found = {r.factor: r for r in rows}
    assert found["model_correction"].delta_kwh == pytest.approx(40.0 * 25.0 / 100.0 - wind) and found["model_correction"].direction == "increase"
    assert [r.rank for r in sorted(rows, key=lambda r: -abs(r.delta_percent))] == list(range(1, len(rows) + 1))


def test_a_trained_pipeline_is_saved_and_loaded(spark, tmp_path, asked):
    _, driven, cases = asked
    rows = spark.range(40).select(*(((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(learning.FEATURES)))
    rows = rows.withColumn(learning.TARGET, F.col("speed_kmh") * 0.1 + 12)
    learner = LinearRegression(featuresCol="features", labelCol=learning.TARGET, predictionCol="predicted", regParam=0.01)
    model = route_model.as_pipeline(learner.fit(learning.with_vector(rows)))
    route_model.save_model(model, str(tmp_path / "model"))
    again = route_model.load_model(spark, str(tmp_path / "model"))
    key = lambda df: sorted((r.route_segment_id, r.start_soc_percent, r.kwh) for r in df.collect())
    assert key(route_model.served_segments(driven, cases, again)) == key(route_model.served_segments(driven, cases, model))
    route_model.save_model(PipelineModel(stages=[]), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        route_model.load_model(spark, str(tmp_path / "empty"))


def test_the_weakest_source_names_the_mode(spark):
    segments = spark.createDataFrame([("s1", "r1"), ("s2", "r2")], "route_segment_id string, route_id string")
    lines = spark.createDataFrame([("r1", "live"), ("r2", "live"), ("r3", "cache")], "route_id string, routing_mode string")
    pairs = spark.createDataFrame([("s1", "e1"), ("s2", "e1"), ("s2", "e2")], "route_segment_id string, traffic_event_id string")
    events = spark.createDataFrame([("e1", "live"), ("e2", "fixture")], "traffic_event_id string, provider_mode string")
    readings = spark.createDataFrame([("s1", "w1"), ("s2", None)], "route_segment_id string, weather_station_id string")
    stations = spark.createDataFrame([("w1", "cache")], "weather_station_id string, provider_mode string")
    rows = {r.route_id: (r.weather_mode, r.traffic_mode, r.data_mode) for r in route_model.source_modes(lines, pairs, events, readings, stations, segments).collect()}
    assert rows == {"r1": ("cache", "cache", "cache"), "r2": ("fixture", "fixture", "fixture"), "r3": ("fixture", "fixture", "fixture")}
