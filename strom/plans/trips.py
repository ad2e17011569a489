"""Fleet facts: energy and distance per trip, trip facts, telemetry facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import energy, lookups
from strom.functions.lookups import km, seconds_between, share_percent
from strom.operators.sizes import join_to_dimension
from strom.operators.sliced import with_history


def telemetry_steps(telemetry: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Counter differences between consecutive samples of a vehicle, only inside one trip.

    A step back of either counter is flagged and contributes neither energy nor distance.
    """
    on_trip = telemetry.where(F.col("trip_id").isNotNull()).select(
        "telemetry_id", "vehicle_id", "trip_id", "recorded_at", "speed_kmh", "acceleration_ms2",
        "battery_soc_percent", "battery_temperature_c", "outside_temperature_c", "cumulative_energy_kwh",
        "odometer_m", "road_class",
    )
    carried = ("trip_id", "recorded_at", "cumulative_energy_kwh", "odometer_m")
    steps = with_history(on_trip, ["vehicle_id"], "recorded_at", ["telemetry_id"], cfg.slice_seconds, lag=carried)
    same_trip = F.col("prev_trip_id").eqNullSafe(F.col("trip_id"))
    energy_step = F.when(same_trip, F.col("cumulative_energy_kwh") - F.col("prev_cumulative_energy_kwh"))
    distance_step = F.when(same_trip, F.col("odometer_m") - F.col("prev_odometer_m"))
    return steps.withColumns({
        "step_seconds": F.when(same_trip, seconds_between(F.col("prev_recorded_at"), F.col("recorded_at"))),
        "step_energy_kwh": F.when(energy_step >= 0, energy_step),
        "step_distance_m": F.when(distance_step >= 0, distance_step),
        "step_is_anomalous": F.coalesce((energy_step < 0) | (distance_step < 0), F.lit(False)),
    })


def trip_energy(telemetry: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per trip: energy, distance and time from counter differences, speed and SOC figures."""
    at = F.struct("recorded_at", "telemetry_id")
    hard = F.abs("acceleration_ms2") > 1.0
    soc, speed = F.col("battery_soc_percent"), F.col("speed_kmh")
    totals = telemetry_steps(telemetry, cfg).groupBy("trip_id").agg(
        F.min("vehicle_id").alias("vehicle_id"),
        F.count_distinct("vehicle_id").alias("distinct_vehicle_count"),
        F.count(F.lit(1)).alias("telemetry_point_count"),
        F.count_if("step_is_anomalous").alias("anomalous_step_count"),
        F.min("recorded_at").alias("first_recorded_at"), F.max("recorded_at").alias("last_recorded_at"),
        F.sum("step_distance_m").alias("distance_m"), F.sum("step_energy_kwh").alias("energy_kwh"),
        F.sum("step_seconds").alias("tracked_seconds"),
        F.sum(F.when(F.col("road_class") == "motorway", F.col("step_distance_m"))).alias("motorway_distance_m"),
        F.min_by(soc, at).alias("start_soc_percent"), F.max_by(soc, at).alias("end_soc_percent"),
        F.min(soc).alias("min_soc_percent"), F.max(soc).alias("max_soc_percent"),
        F.avg(speed).alias("mean_tick_speed_kmh"), F.max(speed).alias("max_speed_kmh"),
        F.stddev_samp(speed).alias("speed_stddev_kmh"),
        F.avg(F.abs("acceleration_ms2")).alias("acceleration_abs_mean_ms2"),
        F.count_if(F.coalesce(hard, F.lit(False))).alias("acceleration_event_count"),
        F.avg("outside_temperature_c").alias("mean_outside_temperature_c"),
        F.min("outside_temperature_c").alias("min_outside_temperature_c"),
        F.avg("battery_temperature_c").alias("mean_battery_temperature_c"),
    )

    driven_km = F.when(F.col("distance_m") > 0, F.col("distance_m") / 1000.0)
    hours = F.when(F.col("tracked_seconds") > 0, F.col("tracked_seconds") / 3600.0)
    return totals.withColumns({
        "elapsed_seconds": seconds_between(F.col("first_recorded_at"), F.col("last_recorded_at")),
        "distance_km": km(F.col("distance_m")),
        "motorway_distance_share_percent": share_percent(F.col("motorway_distance_m"), F.col("distance_m")),
        "avg_consumption_kwh_100km": F.round(F.col("energy_kwh") / driven_km * 100.0, 3),
        "accel_events_per_km": F.round(F.col("acceleration_event_count") / driven_km, 3),
        "avg_speed_kmh": F.round(F.col("distance_m") / 1000.0 / hours, 2),
        "soc_used_percent": F.col("start_soc_percent") - F.col("end_soc_percent"),
    })


def fct_trips(
    trips: DataFrame, energy_per_trip: DataFrame, vehicles: DataFrame, models: DataFrame, routes: DataFrame,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """Both energy accounts of every trip side by side; trips without telemetry are kept."""
    measured = energy_per_trip.select(
        "trip_id",
        F.col("distance_m").alias("measured_distance_m"), F.col("distance_km").alias("measured_distance_km"),
        F.col("energy_kwh").alias("measured_energy_kwh"),
        F.col("avg_consumption_kwh_100km").alias("measured_avg_consumption_kwh_100km"),
        F.col("start_soc_percent").alias("measured_start_soc_percent"),
        F.col("end_soc_percent").alias("measured_end_soc_percent"),
        "telemetry_point_count", "anomalous_step_count", "first_recorded_at", "last_recorded_at", "tracked_seconds",
        "min_soc_percent", "soc_used_percent", "avg_speed_kmh", "max_speed_kmh", "speed_stddev_kmh",
        "acceleration_abs_mean_ms2", "accel_events_per_km", "motorway_distance_share_percent",
        "mean_outside_temperature_c", "min_outside_temperature_c", "mean_battery_temperature_c",
    )
    fleet = vehicles.select(
        F.col("id").alias("vehicle_uuid"), "vehicle_id", F.col("vehicle_model_id"), "simulation_run_id"
    )
    profile = models.select(
        "vehicle_model_id", "vehicle_model_code", "vehicle_class", F.col("display_name").alias("vehicle_display_name"),
        "nominal_consumption_kwh_100km", "usable_capacity_kwh",
    )
    corridor = routes.select(
        "route_id", F.col("slug").alias("route_slug"), F.col("name").alias("route_name"),
        F.col("distance_km").alias("route_distance_km"), F.col("is_demo").alias("route_is_demo"),
    )
    reported = trips.withColumnsRenamed({
        "start_soc_percent": "reported_start_soc_percent", "end_soc_percent": "reported_end_soc_percent",
    })
    who = fleet.join(F.broadcast(profile), "vehicle_model_id", "left")  # five fixed profiles
    joined = reported.join(measured, "trip_id", "left")
    for dimension, key in ((who, "vehicle_uuid"), (corridor, "route_id")):
        joined = join_to_dimension(joined, dimension, [key], "left", cfg.broadcast_rows, F.col("trip_id"), cfg.salt_buckets)
    measured_kwh, reported_kwh = F.col("measured_energy_kwh"), F.col("reported_energy_kwh")
    nominal, usable = F.col("nominal_consumption_kwh_100km"), F.col("usable_capacity_kwh")
    rate = F.col("measured_avg_consumption_kwh_100km")
    return joined.withColumns({
        "started_date": F.to_date("started_at"),
        "duration_min": F.round(seconds_between(F.col("started_at"), F.col("ended_at")) / 60.0, 2),
        "is_running": F.col("ended_at").isNull(),
        "telemetry_point_count": F.coalesce("telemetry_point_count", F.lit(0)),
        "anomalous_step_count": F.coalesce("anomalous_step_count", F.lit(0)),
        "energy_divergence_kwh": F.round(measured_kwh - reported_kwh, 3),
        "energy_divergence_percent": share_percent(measured_kwh - reported_kwh, reported_kwh, 2),
        "distance_divergence_m": F.round(F.col("measured_distance_m") - F.col("reported_distance_m"), 1),
        "energy_intensity": lookups.energy_intensity(rate, nominal),
        "consumption_ratio_to_nominal": lookups.round_decimal(F.when(nominal > 0, rate / nominal), 4),
        "usable_battery_consumed_percent": share_percent(measured_kwh, usable),
        "charged_during_trip": F.coalesce(F.col("soc_used_percent") < 0, F.lit(False)),
    })


def fct_vehicle_telemetry(
    telemetry: DataFrame, vehicles: DataFrame, models: DataFrame, cfg: Config = DEFAULT
) -> DataFrame:
    """Telemetry with its vehicle resolved and the row-level derivations."""
    fleet = vehicles.select(
        "vehicle_id", F.col("id").alias("vehicle_uuid"), "vehicle_model_id", "simulation_run_id"
    )
    profile = models.select(
        "vehicle_model_id", "vehicle_model_code", "vehicle_class", "nominal_consumption_kwh_100km",
        "usable_capacity_kwh",
    )
    who = fleet.join(F.broadcast(profile), "vehicle_model_id", "left")  # five fixed profiles
    joined = join_to_dimension(
        telemetry, who, ["vehicle_id"], "left", cfg.broadcast_rows, F.col("telemetry_id"), cfg.salt_buckets)
    rate, nominal = F.col("energy_consumption_kwh_100km"), F.col("nominal_consumption_kwh_100km")
    return joined.withColumns({
        "recorded_date": F.to_date("recorded_at"),
        "recorded_hour": F.date_trunc("hour", "recorded_at"),
        "road_class_ordinal": lookups.road_class_ordinal(F.col("road_class")),
        "is_over_speed_limit": lookups.over_limit(F.col("speed_kmh"), F.col("speed_limit_kmh")),
        "hvac_load_kw_estimate": F.round(energy.hvac_kw_sql(F.col("outside_temperature_c")), 3),
        "energy_intensity": lookups.energy_intensity(rate, nominal),
        "consumption_ratio_to_nominal": lookups.round_decimal(F.when(nominal > 0, rate / nominal), 4),
        "remaining_energy_kwh": F.round(F.col("usable_capacity_kwh") * F.col("battery_soc_percent") / 100.0, 3),
    }).drop("usable_capacity_kwh")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded for reporting; sums of doubles depend on the order of addition.

    Scales and floors instead of ``round``, which goes through decimals and costs more than most plans.
    """
    scale = float(10**digits)

    def tidy(field) -> Column:
        column = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("double", "float"):
            steps = F.floor(F.abs(column) * scale + 0.5)
            return (F.when(column < 0, -steps).otherwise(steps) / scale + 0.0).alias(field.name)
        return column

    return df.select(*(tidy(field) for field in df.schema.fields))
