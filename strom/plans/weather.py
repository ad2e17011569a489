"""Weather readings matched to points and corridors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.operators.nearest import nearest
from strom.operators.spatial import distance_join
from strom.session import cut_lineage

MEASURES = ("temperature_c", "precipitation_mm", "wind_speed_ms", "humidity_percent", "pressure_hpa")
# fixed values: worst condition first
CONDITION_RANK = {"storm": 6, "snow": 5, "fog": 4, "rain": 3, "clouds": 2, "clear": 1}


def freshest_reading(observations: DataFrame, as_of: datetime) -> DataFrame:
    """Newest reading at or before ``as_of`` of each station: one row per station is all that is shuffled."""
    columns = ["weather_observation_id", "observed_at", "latitude", "longitude", *MEASURES, "weather_condition"]
    newest = F.max_by(F.struct(*columns), F.struct("observed_at", "weather_observation_id"))
    past = observations.where(F.col("observed_at") <= F.lit(as_of))
    return past.groupBy("weather_station_id").agg(newest.alias("_r")).select("weather_station_id", "_r.*")


def nearest_observation(
    points: DataFrame, point_id: list[str], observations: DataFrame, as_of: datetime, radius_m: float | None = None,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Freshest reading of the nearest station for every point; points without one are kept."""
    readings = cut_lineage(freshest_reading(observations, as_of))
    matched = nearest(points, readings, point_id, "weather_station_id", radius_m, cfg)
    return matched.join(readings.drop("latitude", "longitude"), "weather_station_id", "left")


def nearest_stations(points: DataFrame, point_id: list[str], catalogue: DataFrame, cap: int, cfg: Config = DEFAULT) -> DataFrame:
    """The ``cap`` catalogue stations that are nearest to some point, closest first."""
    served = nearest(points, catalogue, point_id, "station_id", None, cfg).where(F.col("station_id").isNotNull())
    closest = served.groupBy("station_id").agg(F.min("distance_m").alias("distance_m"), F.count(F.lit(1)).alias("points_served"))
    return closest.orderBy("distance_m", "station_id").limit(cap)


def asof_pick(rows: DataFrame, key: str, ts: str, at: datetime, tiebreak: str) -> DataFrame:
    """Per key the newest row at or before ``at``, else the earliest row."""
    others = F.struct(*(c for c in rows.columns if c != key))
    past = F.when(F.col(ts) <= F.lit(at), F.struct(ts, tiebreak))
    picked = F.coalesce(F.max_by(F.when(past.isNotNull(), others), past), F.min_by(others, F.struct(ts, tiebreak)))
    return rows.groupBy(key).agg(picked.alias("_r")).select(key, "_r.*")


def align_products(temperature: DataFrame, wind: DataFrame, rain: DataFrame) -> DataFrame:
    """Three feeds on (station, time); a feed without the reading leaves NULLs."""
    key = ["weather_station_id", "observed_at"]
    return temperature.join(wind, key, "left").join(rain, key, "left")


def route_weather(routes: DataFrame, observations: DataFrame, since: datetime, radius_m: float, cfg: Config = DEFAULT) -> DataFrame:
    """Mean weather of the stations around each corridor.

    Readings are summed up per station before the distance join, which then only sees stations.
    """
    recent = observations.where((F.col("observed_at") >= F.lit(since)) & F.col("temperature_c").isNotNull())
    means = ("temperature_c", "precipitation_mm", "wind_speed_ms")
    stations = recent.groupBy("weather_station_id").agg(
        F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.max("observed_at").alias("observed_at"),
        *(F.sum(c).alias(f"sum_{c}") for c in means), *(F.count(c).alias(f"n_{c}") for c in means),
    )
    carried = ["observed_at", *(f"sum_{c}" for c in means), *(f"n_{c}" for c in means)]
    near = distance_join(stations, routes, ["weather_station_id"], ["route_id"], radius_m, cfg, keep=carried)
    return near.groupBy("route_id").agg(
        *((F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(c) for c in means),
        F.max("observed_at").alias("observed_at"), F.count("weather_station_id").alias("station_count")  # each once per corridor,
    )


def weather_context(observations: DataFrame, key: str) -> DataFrame:
    """Mean and lowest temperature, summed rain, mean wind and the worst condition per key."""
    from strom.functions.lookups import lookup

    known = F.when(F.col("weather_condition") != "unknown", F.col("weather_condition"))
    return observations.groupBy(key).agg(
        F.avg("temperature_c").alias("mean_temperature_c"), F.min("temperature_c").alias("min_temperature_c"),
        F.coalesce(F.sum("precipitation_mm"), F.lit(0.0)).alias("precipitation_mm"),
        F.coalesce(F.avg("wind_speed_ms"), F.lit(0.0)).alias("mean_wind_speed_ms"),
        F.coalesce(F.max_by(known, lookup(known, CONDITION_RANK)), F.lit("unknown")).alias("condition"),
    )


def traffic_context(events: DataFrame, key: str) -> DataFrame:
    """Event count, worst severity and number of blocked roads per key."""
    from strom.functions.lookups import severity_ordinal

    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("event_count"), F.max_by("severity", severity_ordinal(F.col("severity"))).alias("worst_severity"),
        F.count_if("is_blocked").alias("blocked_count"),
    )
