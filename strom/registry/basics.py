"""Queries and oracles: the shared operators on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from strom.functions import energy, lookups
from strom.functions.sql import register_sql_functions
from strom.operators.quantiles import exact_percentiles
from strom.operators.sliced import with_history
from strom.plans import trips
from strom.plans.trips import rounded
from strom.registry.analytics import tele
from strom.registry.fleet_models import hvac, intensity
from strom.registry.oracle import Registry
from strom.registry.stations import corridor, stg_routes, stg_stations
from strom.sources.driver import Tables

REG = Registry()


def _sql_functions(t: Tables):
    register_sql_functions(t.spark)
    return t.spark.sql(
        """select telemetry_id, energy_intensity(energy_consumption_kwh_100km, 16D) as intensity, charging_category(speed_kmh) as category,
                  road_class_ordinal(road_class) as road_rank, in_germany(latitude, longitude) as inside, meters_to_km(odometer_m) as km,
                  round(hvac_load_kw(outside_temperature_c), 6) as hvac_kw, null_if_missing(speed_limit_kmh) as speed_limit_kmh,
                  severity_ordinal(state) as severity_rank, severity_delay_factor(state) as delay_factor from {rows}""", rows=t.telemetry)


REG.add("sql_functions", _sql_functions, f"""
    select telemetry_id, {intensity("energy_consumption_kwh_100km", "16")} as intensity,
           case when speed_kmh >= 150 then 'ultra_fast' when speed_kmh >= 22 then 'fast' else 'normal' end as category,
           case road_class when 'motorway' then 6 when 'trunk' then 5 when 'primary' then 4 when 'secondary' then 3 when 'residential' then 1 else 0 end as road_rank,
           latitude between 47.2 and 55.1 and longitude between 5.8 and 15.1 as inside, round(odometer_m / 1e3, 3) as km,
           round({hvac("outside_temperature_c")}, 6) as hvac_kw, speed_limit_kmh, null::int as severity_rank, 1::double as delay_factor from telemetry""")
REG.add("column_rules", lambda t: tele(t).select(
    "telemetry_id", lookups.energy_intensity(F.col("energy_consumption_kwh_100km"), F.lit(16.0)).alias("intensity"),
    lookups.charging_category(F.col("speed_kmh")).alias("category"), lookups.over_limit(F.col("speed_kmh"), F.col("speed_limit_kmh")).alias("over_limit"),
    F.round(energy.hvac_kw_physics(F.col("outside_temperature_c")), 9).alias("hvac_kw")), f"""
    select telemetry_id, {intensity("energy_consumption_kwh_100km", "16")} as intensity,
           case when speed_kmh >= 150 then 'ultra_fast' when speed_kmh >= 22 then 'fast' else 'normal' end as category, speed_kmh > speed_limit_kmh + 5 as over_limit,
           round(case when t <= -10 then 3.5 + (-10 - t) * 0.1 when t < 0 then 3.5 + (t + 10) / 10 * (2.2 - 3.5) when t < 10 then 2.2 + t / 10 * (0.9 - 2.2) when t < 20 then 0.9 + (t - 10) / 10 * (0 - 0.9)
                when t < 25 then (t - 20) / 5 * 0.5 when t < 30 then 0.5 + (t - 25) / 5 * (1.2 - 0.5) when t < 35 then 1.2 + (t - 30) / 5 * (2.0 - 1.2) else 2.0 + (t - 35) / 10 * (3.2 - 2.0) end, 9) as hvac_kw
    from (select *, outside_temperature_c::double as t from telemetry)""")
REG.add("telemetry_steps", lambda t: rounded(trips.telemetry_steps(tele(t)).select(
    "telemetry_id", "step_seconds", "step_energy_kwh", "step_distance_m", "step_is_anomalous")), """
    select telemetry_id, round(dt, 6) as step_seconds, round(case when de >= 0 then de end, 6) + 0 as step_energy_kwh, round(case when dm >= 0 then dm end, 6) + 0 as step_distance_m,
           coalesce(de < 0 or dm < 0, false) as step_is_anomalous from trip_steps""")
REG.add("sliced_history", lambda t: rounded(with_history(
    tele(t).select("vehicle_id", "telemetry_id", "recorded_at", "speed_kmh", "odometer_m"), ["vehicle_id"], "recorded_at", ["telemetry_id"], 3600.0,
    lag=["speed_kmh"], sums={"speed_sum": F.col("speed_kmh")}, running_max={"top_before": F.col("odometer_m")}, number="position").drop("recorded_at"), 4), """
    select vehicle_id, telemetry_id, speed_kmh, odometer_m, lag(speed_kmh) over w as prev_speed_kmh, row_number() over w as position,
           round(sum(speed_kmh) over w, 4) as speed_sum, max(odometer_m) over (w rows between unbounded preceding and 1 preceding) as top_before
    from telemetry window w as (partition by vehicle_id order by recorded_at, telemetry_id)""")
REG.add("exact_percentiles", lambda t: rounded(exact_percentiles(
    tele(t), ["road_class", "speed_limit_kmh"], F.col("speed_kmh"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}, one_task_rows=0), 6), """
    select road_class, speed_limit_kmh, round(quantile_cont(speed_kmh, 0.1), 6) as p10, round(quantile_cont(speed_kmh, 0.5), 6) as p50,
           round(quantile_cont(speed_kmh, 0.9), 6) as p90 from telemetry group by 1, 2""")
REG.add("uncovered_routes", lambda t: stg_routes(t).where("is_demo").join(
    corridor(t).where("is_fast_charger").select("route_id"), "route_id", "left_anti").select("route_id"),
    "select route_id from stg_route where is_demo and route_id not in (select route_id from fast_offsets)")
REG.add("months_before", lambda t: stg_stations(t).select("station_id", (F.col("commissioned_on") >= F.add_months(F.lit("2024-06-01").cast("date"), -36)).alias("is_recent")),
        "select station_id, commissioned_on >= date '2024-06-01' - interval 36 month as is_recent from stg_station")
