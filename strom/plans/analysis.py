"""Route analysis for many requests at once.

Energy depends on the stretch, the vehicle and the conditions, not on who asks: it is worked out
once per (segment, vehicle) and only then met with the requests, which add their start charge.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import energy, lookups
from strom.functions.energy import Drive, with_segment_energy
from strom.operators.sizes import is_small, skew_join
from strom.session import cut_lineage

REFERENCE_TEMPERATURE_C = 20.0  # fixed value
MIN_SPEED_KMH = 5.0  # fixed value
MIN_DELTA_PERCENT = 0.5  # fixed value
# fixed values: speed assumed where the map states none
DEFAULT_SPEED_KMH = {
    "motorway": 130.0, "trunk": 120.0, "primary": 100.0, "secondary": 100.0, "tertiary": 80.0, "residential": 50.0,
    "service": 30.0, "unknown": 100.0,
}
DRIVERS = ("speed_profile", "auxiliary", "gradient", "traffic", "temperature", "wind", "model_correction")


def default_speed(road_class: Column) -> Column:
    return lookups.lookup(road_class, DEFAULT_SPEED_KMH, 100.0)


def free_flow_speed(assumed: Column, road_class: Column, limit: Column) -> Column:
    nominal = F.least(default_speed(road_class), F.when(limit > 0, limit))
    return F.greatest(F.lit(MIN_SPEED_KMH), F.coalesce(F.when(assumed > 0, assumed), nominal))


def severity_tally(events: DataFrame) -> DataFrame:
    """Worst severity as a number and number of rows of every event."""
    return events.groupBy("traffic_event_id").agg(
        F.max(lookups.severity_ordinal(F.col("severity"))).alias("severity_ordinal"), F.count(F.lit(1)).alias("event_rows"))


def segment_conditions(
    segments: DataFrame, event_pairs: DataFrame, events: DataFrame, readings: DataFrame, as_of: datetime,
    radius_m: float = 150_000.0, max_age_hours: float = 200.0,
) -> DataFrame:
    """Speed, weather and traffic each segment is driven under.

    ``event_pairs`` matches events to segments, with the figures of ``severity_tally`` or without, ``readings`` gives each segment its nearest reading. A
    reading too far or too old is ignored; the corridor mean, else 20 degrees, stands in.
    """
    if "event_rows" not in event_pairs.columns:
        event_pairs = event_pairs.join(severity_tally(events), "traffic_event_id")
    worst = event_pairs.groupBy("route_segment_id").agg(
        lookups.severity_name(F.max("severity_ordinal")).alias("traffic_severity"), F.sum("event_rows").alias("event_count"))
    age = lookups.seconds_between(F.col("observed_at"), F.lit(as_of)) / 3600.0
    usable = (F.col("distance_m") <= radius_m) & (age <= max_age_hours)
    weather = readings.where(usable).select("route_segment_id", "temperature_c", "precipitation_mm", "wind_speed_ms")
    base = (
        segments.select("route_segment_id", "route_id", "segment_ordinal", "start_offset_m", "segment_distance_m", "road_class",
                        "speed_limit_kmh", F.col("assumed_speed_kmh").alias("_assumed"))
        .join(worst, "route_segment_id", "left").join(weather, "route_segment_id", "left")
    )
    corridor = base.groupBy("route_id").agg(F.avg("temperature_c").alias("_mean_c"))
    return base.join(corridor, "route_id").withColumns({
        "traffic_severity": F.coalesce("traffic_severity", F.lit("low")),
        "event_count": F.coalesce("event_count", F.lit(0)),
        "distance_km": F.col("segment_distance_m") / 1000.0,
        "free_flow_speed_kmh": free_flow_speed(F.col("_assumed"), F.col("road_class"), F.col("speed_limit_kmh")),
        "temperature_c": F.coalesce("temperature_c", "_mean_c", F.lit(REFERENCE_TEMPERATURE_C)),
        "precipitation_mm": F.coalesce("precipitation_mm", F.lit(0.0)),
        "wind_speed_ms": F.coalesce("wind_speed_ms", F.lit(0.0)),
    }).withColumn(
        "speed_kmh", F.greatest(F.lit(MIN_SPEED_KMH), F.col("free_flow_speed_kmh") / lookups.severity_delay_factor(F.col("traffic_severity")))
    ).withColumn("duration_s", F.col("distance_km") / F.col("speed_kmh") * 3600.0).drop("_assumed", "_mean_c", "segment_distance_m")


def _drive(**overrides: Column) -> Drive:
    """Steady driving: no gradient, wind or acceleration unless given; the battery is as warm as the air."""
    temperature = overrides.get("temperature_c", F.col("temperature_c"))
    steady = {
        "gradient_percent": F.lit(0.0), "headwind_ms": F.lit(0.0), "acceleration_ms2": F.lit(0.0),
        "battery_temperature_c": temperature,
    }
    return Drive.of(**(steady | overrides))


def for_vehicles(conditions: DataFrame, requests: DataFrame, models: DataFrame) -> DataFrame:
    """Segments of every (route, vehicle) pair somebody asks about, with the vehicle's road-load figures."""
    profile = models.select(
        "vehicle_model_id", "mass_kg", "drag_area_m2", "rolling_resistance", "usable_capacity_kwh",
        "nominal_consumption_kwh_100km", "max_dc_power_kw",
    )
    pairs = requests.select("route_id", "vehicle_model_id").distinct()
    return pairs.join(conditions, "route_id").join(F.broadcast(profile), "vehicle_model_id")  # five fixed profiles


def segment_energies(driven: DataFrame) -> DataFrame:
    """Energy balance of every (segment, vehicle) row."""
    return with_segment_energy(driven, _drive())


def counterfactuals(driven: DataFrame) -> DataFrame:
    """Adds the energy without traffic, in mild weather, and with neither."""
    free = F.col("speed_kmh") * lookups.severity_delay_factor(F.col("traffic_severity"))
    free_s = F.col("distance_km") / free * 3600.0
    mild = F.lit(REFERENCE_TEMPERATURE_C)
    out = with_segment_energy(driven, _drive(), "")
    for prefix, overrides in (
        ("free_", {"speed_kmh": free, "duration_s": free_s}),
        ("mild_", {"temperature_c": mild}),
        ("neutral_", {"speed_kmh": free, "duration_s": free_s, "temperature_c": mild}),
    ):
        out = with_segment_energy(out, _drive(**overrides), prefix)
        out = out.drop(*(f"{prefix}{f}" for f in energy.ENERGY_FIELDS if f != "kwh"))
    return out


def penalty_percent(actual: Column, counterfactual: Column) -> Column:
    return F.coalesce(F.when(counterfactual > 0, (actual - counterfactual) / counterfactual * 100.0), F.lit(0.0))


def pair_totals(driven: DataFrame) -> DataFrame:
    """Trip totals, component sums and penalties of every (route, vehicle) pair."""
    rows = counterfactuals(driven)
    sums = ("kwh", *(f for f in energy.ENERGY_FIELDS if f != "kwh"), "free_kwh", "mild_kwh", "neutral_kwh", "distance_km", "duration_s")
    totals = rows.groupBy("route_id", "vehicle_model_id").agg(
        *(F.sum(c).alias(c) for c in sums), F.first("usable_capacity_kwh").alias("usable_capacity_kwh"),
        F.first("nominal_consumption_kwh_100km").alias("nominal_consumption_kwh_100km"),
    )
    return totals.withColumns({
        "traffic_penalty_percent": penalty_percent(F.col("kwh"), F.col("free_kwh")),
        "weather_penalty_percent": penalty_percent(F.col("kwh"), F.col("mild_kwh")),
        "total_penalty_percent": penalty_percent(F.col("kwh"), F.col("neutral_kwh")),
    })


def meet_requests(requests: DataFrame, per_pair: DataFrame, cfg: Config = DEFAULT, keys: tuple[str, ...] = ("route_id", "vehicle_model_id")) -> DataFrame:
    """Requests joined to what is known about their ``keys``, the (route, vehicle) pair unless told otherwise; popular ones are split."""
    keys = list(keys)
    if is_small(per_pair, cfg.broadcast_rows):
        return requests.join(F.broadcast(per_pair), keys)
    return skew_join(requests, per_pair, keys, F.col("request_id"), cfg.salt_buckets, hot_rows=cfg.hot_rows)


def mean_soc(start: Column, kwh: Column, usable: Column) -> Column:
    """Charge the model is told: midway between start and the arrival the physics implies."""
    arrival = F.greatest(F.lit(0.0), start - kwh / usable * 100.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (start + arrival) / 2.0))


def route_analysis(
    requests: DataFrame, conditions: DataFrame, models: DataFrame, min_arrival_soc: float = 10.0, cfg: Config = DEFAULT
) -> DataFrame:
    """One answer per request: energy, arrival charge, deficit, consumption, penalties, whether to charge."""
    totals = cut_lineage(pair_totals(for_vehicles(conditions, requests, models)))
    answers = meet_requests(requests, totals, cfg)
    arrival = F.col("start_soc_percent") - F.col("kwh") / F.col("usable_capacity_kwh") * 100.0
    deficit = F.greatest(F.lit(0.0), (F.lit(min_arrival_soc) - arrival) / 100.0 * F.col("usable_capacity_kwh"))
    per_100 = energy.consumption_kwh_per_100km(F.col("kwh"), F.col("distance_km"))
    return answers.select(
        "request_id", "route_id", "vehicle_model_id", "start_soc_percent",
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), arrival)).alias("arrival_soc_percent"),
        F.col("kwh").alias("energy_kwh_total"), deficit.alias("energy_deficit_kwh"), (deficit > 0).alias("charging_required"),
        "distance_km", F.col("duration_s").alias("estimated_duration_s"), per_100.alias("avg_consumption_kwh_100km"),
        lookups.energy_intensity(per_100, F.col("nominal_consumption_kwh_100km")).alias("energy_intensity"),
        "weather_penalty_percent", "traffic_penalty_percent", "total_penalty_percent",
        mean_soc(F.col("start_soc_percent"), F.col("kwh"), F.col("usable_capacity_kwh")).alias("mean_soc_percent"),
    )


def prefix_energy(driven: DataFrame) -> DataFrame:
    """Per (route, vehicle) and segment: energy used up to the end of the segment."""
    upto = W.partitionBy("route_id", "vehicle_model_id").orderBy("segment_ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = segment_energies(driven)
    return rows.select("route_id", "vehicle_model_id", "segment_ordinal", "kwh", F.sum("kwh").over(upto).alias("kwh_upto"), "usable_capacity_kwh")


def soc_trajectory(requests: DataFrame, conditions: DataFrame, models: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """State of charge at the end of every segment of every request; clamped only for display."""
    known = cut_lineage(prefix_energy(for_vehicles(conditions, requests, models)))
    rows = meet_requests(requests, known, cfg)
    soc = F.col("start_soc_percent") - F.col("kwh_upto") / F.col("usable_capacity_kwh") * 100.0
    return rows.select(
        "request_id", "segment_ordinal", soc.alias("soc_percent"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), soc)).alias("soc_at_end_percent"),
    )


def rescale_to_model(rows: DataFrame, target: Column) -> DataFrame:
    """Scales a decomposition to a predicted total; the parts still add up, empty rows stay empty."""
    factor = F.when(F.col("kwh") > 0, target / F.col("kwh")).otherwise(F.lit(1.0))
    scaled = rows.withColumn("_factor", factor)
    return scaled.withColumns({f: F.col(f) * F.col("_factor") for f in energy.ENERGY_FIELDS}).drop("_factor")


def ladder_totals(driven: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Energy of each rung of the driver ladder by ``keys``, with the sums of the columns ``also``."""
    warm = F.lit(REFERENCE_TEMPERATURE_C)
    free = F.col("speed_kmh") * lookups.severity_delay_factor(F.col("traffic_severity"))
    free_s = F.col("distance_km") / free * 3600.0
    reference = {"speed_kmh": free, "duration_s": free_s, "temperature_c": warm, "battery_temperature_c": warm,
                 "gradient_percent": F.lit(0.0), "headwind_ms": F.lit(0.0), "acceleration_ms2": F.col("acceleration_ms2")}
    rungs = [("reference", {})]
    for name, step in (
        ("gradient", {"gradient_percent": F.col("gradient_percent")}),
        ("traffic", {"speed_kmh": F.col("speed_kmh"), "duration_s": F.col("duration_s")}),
        ("temperature", {"temperature_c": F.col("temperature_c"), "battery_temperature_c": F.col("battery_temperature_c")}),
        ("wind", {"headwind_ms": F.col("headwind_ms")}),
    ):
        rungs.append((name, rungs[-1][1] | step))
    rows = driven
    for name, overrides in rungs:
        rows = with_segment_energy(rows, Drive.of(**(reference | overrides)), f"{name}_")
    sums = [f"{name}_kwh" for name, _ in rungs] + ["reference_auxiliary_kwh", "reference_hvac_kwh", *also, "distance_km"]
    totals = rows.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), F.first("nominal_consumption_kwh_100km").alias("_nominal"))
    return totals.withColumn("nominal_kwh", F.col("_nominal") * F.col("distance_km") / 100.0).drop("_nominal")


def driver_ladder(driven: DataFrame, keys: list[str], actual: str = "actual_kwh", min_delta: float = MIN_DELTA_PERCENT) -> DataFrame:
    """Splits the deviation from nominal consumption into seven additive drivers, largest first.

    Each driver is the step between two runs of the road-load model: reference conditions, then
    gradient, traffic, temperature and wind switched on one after the other, then the served value.
    """
    return rank_drivers(ladder_totals(driven, keys, (actual,)), keys, actual, min_delta)


def rank_drivers(totals: DataFrame, keys: list[str], actual: str, min_delta: float = MIN_DELTA_PERCENT) -> DataFrame:
    """The drivers of each row of ``ladder_totals`` whose served energy is ``actual``."""
    standing = F.col("reference_auxiliary_kwh") + F.col("reference_hvac_kwh")
    deltas = {
        "speed_profile": F.col("reference_kwh") - standing - F.col("nominal_kwh"),
        "auxiliary": standing,
        "gradient": F.col("gradient_kwh") - F.col("reference_kwh"),
        "traffic": F.col("traffic_kwh") - F.col("gradient_kwh"),
        "temperature": F.col("temperature_kwh") - F.col("traffic_kwh"),
        "wind": F.col("wind_kwh") - F.col("temperature_kwh"),
        "model_correction": F.col(actual) - F.col("wind_kwh"),
    }
    entries = F.array(*(
        F.struct((-F.round(F.abs(d / F.col("nominal_kwh") * 100.0), 6)).alias("order"), F.lit(n).alias("factor"), d.alias("delta_kwh"))
        for n, d in deltas.items()
    ))
    # seven entries per row: ranked inside the row, the largest is always kept
    ranked = totals.select(*keys, "nominal_kwh", F.posexplode(F.array_sort(entries)).alias("rank", "d"))
    delta = F.col("d.delta_kwh") / F.col("nominal_kwh") * 100.0
    direction = F.when(delta > MIN_DELTA_PERCENT, "increase").when(delta < -MIN_DELTA_PERCENT, "decrease").otherwise("neutral")
    return ranked.where((F.col("rank") == 0) | (F.abs(delta) >= min_delta)).select(
        *keys, (F.col("rank") + 1).alias("rank"), F.col("d.factor").alias("factor"), F.col("d.delta_kwh").alias("delta_kwh"),
        delta.alias("delta_percent"), direction.alias("direction"),
    )


def distance_weighted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distance-weighted speed, headwind and temperature, motorway share, climb and descent."""
    km = F.col("distance_km")
    whole = F.nullif(F.sum(km), F.lit(0.0))
    rise = F.col("gradient_percent") / 100.0 * km * 1000.0
    return rows.groupBy(*keys).agg(
        (F.sum(F.col("speed_kmh") * km) / whole).alias("speed_kmh"),
        (F.sum(F.col("headwind_ms") * km) / whole).alias("headwind_ms"),
        (F.sum(F.col("temperature_c") * km) / whole).alias("temperature_c"),
        (F.sum(F.when(F.col("road_class") == "motorway", km).otherwise(0.0)) / whole * 100.0).alias("motorway_share_percent"),
        F.sum(F.greatest(rise, F.lit(0.0))).alias("climb_m"), F.sum(F.greatest(-rise, F.lit(0.0))).alias("descent_m"),
    )


def reconstruct_profile(rows: DataFrame, models: list[tuple[str, float, float, float]]) -> DataFrame:
    """Code of the generic vehicle nearest to (mass, drag area, nominal consumption), the first winning a tie.

    ``models`` is the fixed catalogue (code, mass, drag area, nominal); compared inside the row.
    """
    entries = F.array(*(
        F.struct(
            (F.abs(F.col("mass_kg") - mass) / 500.0 + F.abs(F.col("drag_area") - area) / 0.2
             + F.abs(F.col("nominal_consumption_kwh_100km") - nominal) / 5.0).alias("distance"),
            F.lit(i).alias("position"), F.lit(code).alias("code"),
        )
        for i, (code, mass, area, nominal) in enumerate(models)
    ))
    return rows.withColumn("nearest_code", F.array_min(entries).getField("code"))
