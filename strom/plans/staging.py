"""Typed, cleaned views of the raw tables: one narrow projection per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.functions.lookups import blank_to_null, km, share_percent

_PROVENANCE = ("source_identifier", "source_url", "source_timestamp", "data_origin", "ingestion_run_id", "ingested_at")


def _provenance(df: DataFrame) -> list:
    source = [F.col("source").alias("source_system")] if "source" in df.columns else []
    return source + [F.col(c) for c in _PROVENANCE if c in df.columns]


def _carry(df: DataFrame, *names: str) -> list:
    return [F.col(n) for n in names if n in df.columns]


def charging_stations(raw: DataFrame) -> DataFrame:
    postal = blank_to_null(F.col("postal_code"))
    return raw.select(
        F.col("id").alias("station_id"), "external_id",
        *(blank_to_null(F.col(c)).alias(c) for c in ("operator", "street", "house_number")),
        F.when(F.length(postal) < 5, F.lpad(postal, 5, "0")).otherwise(postal).alias("postal_code"),
        blank_to_null(F.col("city")).alias("city"), "bundesland",
        F.upper(blank_to_null(F.col("country"))).alias("country"),
        "latitude", "longitude", "commissioned_on", F.year("commissioned_on").alias("commissioned_year"),
        "charging_points_count", "max_power_kw", "total_power_kw", "charging_category", "is_fast_charger",
        *_provenance(raw),
    )


def charging_points(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("charging_point_id"), "station_id", F.col("ordinal").alias("connector_ordinal"),
        "connector_type", "current_type", "power_kw", blank_to_null(F.col("public_key")).alias("public_key"),
        *_provenance(raw),
    )


def routes(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("route_id"),
        *(blank_to_null(F.col(c)).alias(c) for c in ("slug", "name", "origin_name", "destination_name")),
        "origin_latitude", "origin_longitude", "destination_latitude", "destination_longitude",
        *_carry(raw, "geometry"), "distance_m", km(F.col("distance_m")).alias("distance_km"),
        "duration_s", F.round(F.col("duration_s") / 60.0, 1).alias("duration_min"), "routing_profile", "is_demo",
        *_provenance(raw),
    )


def route_segments(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("route_segment_id"), "route_id", F.col("ordinal").alias("segment_ordinal"),
        *_carry(raw, "geometry"), "start_offset_m", km(F.col("start_offset_m")).alias("start_offset_km"),
        F.col("distance_m").alias("segment_distance_m"), km(F.col("distance_m")).alias("segment_distance_km"),
        "road_class", "speed_limit_kmh", "assumed_speed_kmh", "elevation_gain_m", "temperature_c",
        "traffic_severity", "predicted_kwh_per_100km", "predicted_kwh", "energy_intensity",
        F.lit("derived").alias("data_origin"),
    )


def telemetry(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({"state": "vehicle_state"})


def traffic_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("traffic_event_id"), "external_id", "event_type", "severity",
        F.upper(blank_to_null(F.col("road_name"))).alias("road_name"),
        *(blank_to_null(F.col(c)).alias(c) for c in ("direction", "title", "description")),
        "latitude", "longitude", *_carry(raw, "geometry"), "starts_at", "ends_at", "is_blocked", "delay_minutes",
        *_provenance(raw),
    )


def trips(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("id").alias("trip_uuid"), "trip_id", F.col("vehicle_id").alias("vehicle_uuid"), "route_id",
        "started_at", "ended_at", "start_soc_percent", "end_soc_percent",
        F.col("distance_m").alias("reported_distance_m"), km(F.col("distance_m")).alias("reported_distance_km"),
        F.col("energy_kwh").alias("reported_energy_kwh"),
        F.col("avg_consumption_kwh_100km").alias("reported_avg_consumption_kwh_100km"),
        F.col("state").alias("trip_state"), *_provenance(raw),
    )


def weather_observations(raw: DataFrame, sentinel: float = -999.0) -> DataFrame:
    measured = (
        "temperature_c", "precipitation_mm", "wind_speed_ms", "wind_gust_ms", "humidity_percent", "pressure_hpa",
    )
    return raw.select(
        F.col("id").alias("weather_observation_id"), "weather_station_id", "observed_at", "latitude", "longitude",
        *(F.nullif(F.col(c), F.lit(sentinel)).alias(c) for c in measured),
        F.col("condition").alias("weather_condition"), *_provenance(raw),
    )


def vehicle_models(raw: DataFrame) -> DataFrame:
    """Profile dimension with drag area, usable share, nominal range and shortest 10-80 % charge."""
    usable, nominal = F.col("usable_capacity_kwh"), F.col("nominal_consumption_kwh_100km")
    charge = F.when(F.col("max_dc_power_kw") > 0, usable * (60.0 * 0.7) / F.col("max_dc_power_kw"))
    return raw.withColumnsRenamed({"id": "vehicle_model_id", "code": "vehicle_model_code"}).withColumns({
        "drag_area_m2": F.round(F.col("drag_coefficient") * F.col("frontal_area_m2"), 4),
        "usable_capacity_share_percent": share_percent(usable, F.col("battery_capacity_kwh")),
        "nominal_range_km": share_percent(usable, nominal),
        "min_dc_charge_10_to_80_min": F.round(charge, 1),
        "data_origin": F.lit("derived"),
    })
