"""Queries and oracles: staging views, trip energy, fleet facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strom.plans import staging, trips
from strom.plans.trips import rounded
from strom.registry.oracle import Registry, relation
from strom.sources.driver import Tables

REG = Registry()

relation("dim_vehicle_model", """
    select id as vehicle_model_id, code as vehicle_model_code, display_name, vehicle_class, battery_capacity_kwh,
           usable_capacity_kwh, nominal_consumption_kwh_100km, max_dc_power_kw, max_ac_power_kw, mass_kg,
           drag_coefficient, frontal_area_m2, rolling_resistance, is_generic,
           round(drag_coefficient * frontal_area_m2, 4) as drag_area_m2,
           round(100 * usable_capacity_kwh / battery_capacity_kwh, 1) as usable_capacity_share_percent,
           round(100 * usable_capacity_kwh / nominal_consumption_kwh_100km, 1) as nominal_range_km,
           round(42 * usable_capacity_kwh / max_dc_power_kw, 1) as min_dc_charge_10_to_80_min, 'derived' as data_origin
    from vehicle_models""")

relation("trip_steps", """
    select *, trip_id = before_trip as inside,
           case when trip_id = before_trip then (epoch_us(recorded_at) - epoch_us(before_at)) / 1e6 end as dt,
           case when trip_id = before_trip then cumulative_energy_kwh - before_kwh end as de,
           case when trip_id = before_trip then odometer_m - before_m end as dm
    from (select t.*,
                 lag(trip_id) over v as before_trip, lag(recorded_at) over v as before_at,
                 lag(cumulative_energy_kwh) over v as before_kwh, lag(odometer_m) over v as before_m,
                 row_number() over (partition by trip_id order by recorded_at, telemetry_id) as nth,
                 row_number() over (partition by trip_id order by recorded_at desc, telemetry_id desc) as nth_last
          from telemetry t where trip_id is not null
          window v as (partition by vehicle_id order by recorded_at, telemetry_id))""")

relation("trip_energy_raw", """
    select a.*, (epoch_us(last_recorded_at) - epoch_us(first_recorded_at)) / 1e6 as elapsed_seconds,
           round(distance_m / 1e3, 3) as distance_km,
           case when distance_m > 0 then round(100 * motorway_distance_m / distance_m, 1) end as motorway_distance_share_percent,
           case when distance_m > 0 then round(energy_kwh / (distance_m / 1e3) * 100, 3) end as avg_consumption_kwh_100km,
           case when distance_m > 0 then round(acceleration_event_count / (distance_m / 1e3), 3) end as accel_events_per_km,
           case when tracked_seconds > 0 then round(distance_m / 1e3 / (tracked_seconds / 3600), 2) end as avg_speed_kmh,
           start_soc_percent - end_soc_percent as soc_used_percent
    from (select trip_id, min(vehicle_id) as vehicle_id, count(distinct vehicle_id) as distinct_vehicle_count,
                 count(*) as telemetry_point_count, count(*) filter (where de < 0 or dm < 0) as anomalous_step_count,
                 min(recorded_at) as first_recorded_at, max(recorded_at) as last_recorded_at,
                 sum(dm) filter (where dm >= 0) as distance_m, sum(de) filter (where de >= 0) as energy_kwh,
                 sum(dt) as tracked_seconds,
                 sum(dm) filter (where dm >= 0 and road_class = 'motorway') as motorway_distance_m,
                 max(battery_soc_percent) filter (where nth = 1) as start_soc_percent,
                 max(battery_soc_percent) filter (where nth_last = 1) as end_soc_percent,
                 min(battery_soc_percent) as min_soc_percent, max(battery_soc_percent) as max_soc_percent,
                 avg(speed_kmh) as mean_tick_speed_kmh, max(speed_kmh) as max_speed_kmh,
                 stddev_samp(speed_kmh) as speed_stddev_kmh, avg(abs(acceleration_ms2)) as acceleration_abs_mean_ms2,
                 count(*) filter (where abs(acceleration_ms2) > 1) as acceleration_event_count,
                 avg(outside_temperature_c) as mean_outside_temperature_c,
                 min(outside_temperature_c) as min_outside_temperature_c,
                 avg(battery_temperature_c) as mean_battery_temperature_c
          from trip_steps group by trip_id) a""")

_INTENSITY = """case when {nominal} > 0 then case when {actual} / {nominal} < 0.95 then 'low'
    when {actual} / {nominal} < 1.10 then 'medium' when {actual} / {nominal} < 1.30 then 'high'
    when {actual} is not null then 'critical' end end"""


def intensity(actual: str, nominal: str) -> str:
    return _INTENSITY.format(actual=actual, nominal=nominal)


def hvac(t: str) -> str:
    return (
        f"case when {t} <= -10 then 3.5::double when {t} < 20 then 3.5 * (20 - {t}) / 30 "
        f"when {t} < 35 then 2 * ({t} - 20) / 15::double when {t} is not null then 2::double end"
    )


_ORDINAL = (
    "case road_class when 'motorway' then 6 when 'trunk' then 5 when 'primary' then 4 when 'secondary' then 3 "
    "when 'tertiary' then 2 when 'residential' then 1 when 'service' then 1 else 0 end"
)

relation("fct_trips_raw", f"""
    select t.id as trip_uuid, t.trip_id, t.vehicle_id as vehicle_uuid, v.vehicle_id, v.simulation_run_id,
           v.vehicle_model_id, m.vehicle_model_code, m.vehicle_class, m.display_name as vehicle_display_name, t.route_id,
           nullif(trim(r.slug), '') as route_slug, trim(r.name) as route_name, round(r.distance_m / 1e3, 3) as route_distance_km,
           r.is_demo as route_is_demo, t.started_at, t.ended_at, t.started_at::date as started_date,
           round((epoch_us(t.ended_at) - epoch_us(t.started_at)) / 6e7, 2) as duration_min, t.ended_at is null as is_running,
           t.state as trip_state, coalesce(e.telemetry_point_count, 0) as telemetry_point_count,
           coalesce(e.anomalous_step_count, 0) as anomalous_step_count, e.first_recorded_at, e.last_recorded_at, e.tracked_seconds,
           t.distance_m as reported_distance_m, round(t.distance_m / 1e3, 3) as reported_distance_km,
           t.energy_kwh as reported_energy_kwh, t.avg_consumption_kwh_100km as reported_avg_consumption_kwh_100km,
           e.distance_m as measured_distance_m, e.distance_km as measured_distance_km, e.energy_kwh as measured_energy_kwh,
           e.avg_consumption_kwh_100km as measured_avg_consumption_kwh_100km,
           round(e.energy_kwh - t.energy_kwh, 3) as energy_divergence_kwh,
           case when t.energy_kwh > 0 then round(100 * (e.energy_kwh - t.energy_kwh) / t.energy_kwh, 2) end as energy_divergence_percent,
           round(e.distance_m - t.distance_m, 1) as distance_divergence_m, m.nominal_consumption_kwh_100km, m.usable_capacity_kwh,
           {intensity("e.avg_consumption_kwh_100km", "m.nominal_consumption_kwh_100km")} as energy_intensity,
           round((e.avg_consumption_kwh_100km / m.nominal_consumption_kwh_100km)::decimal(18,9), 4)::double as consumption_ratio_to_nominal,
           round(100 * e.energy_kwh / m.usable_capacity_kwh, 1) as usable_battery_consumed_percent,
           t.start_soc_percent as reported_start_soc_percent, t.end_soc_percent as reported_end_soc_percent,
           e.start_soc_percent as measured_start_soc_percent, e.end_soc_percent as measured_end_soc_percent,
           e.min_soc_percent, e.soc_used_percent, coalesce(e.soc_used_percent < 0, false) as charged_during_trip,
           e.avg_speed_kmh, e.max_speed_kmh, e.speed_stddev_kmh, e.acceleration_abs_mean_ms2, e.accel_events_per_km,
           e.motorway_distance_share_percent, e.mean_outside_temperature_c, e.min_outside_temperature_c,
           e.mean_battery_temperature_c, t.source as source_system, t.source_identifier, t.data_origin, t.ingested_at
    from trips t left join trip_energy_raw e using (trip_id) left join vehicles v on v.id = t.vehicle_id
    left join dim_vehicle_model m on m.vehicle_model_id = v.vehicle_model_id left join routes r on r.id = t.route_id""")

relation("fct_telemetry_raw", f"""
    select t.* exclude (state), t.state as vehicle_state, v.id as vehicle_uuid, v.simulation_run_id, v.vehicle_model_id,
           m.vehicle_model_code, m.vehicle_class, t.recorded_at::date as recorded_date,
           date_trunc('hour', t.recorded_at) as recorded_hour, {_ORDINAL} as road_class_ordinal,
           t.speed_kmh > t.speed_limit_kmh + 5 as is_over_speed_limit,
           round({hvac("t.outside_temperature_c")}, 3) as hvac_load_kw_estimate, m.nominal_consumption_kwh_100km,
           {intensity("t.energy_consumption_kwh_100km", "m.nominal_consumption_kwh_100km")} as energy_intensity,
           round((t.energy_consumption_kwh_100km / m.nominal_consumption_kwh_100km)::decimal(18,9), 4)::double as consumption_ratio_to_nominal,
           round(m.usable_capacity_kwh * t.battery_soc_percent / 100, 3) as remaining_energy_kwh
    from telemetry t left join vehicles v using (vehicle_id) left join dim_vehicle_model m using (vehicle_model_id)""")


def round_all(relation_name: str, doubles: list[str], digits: int = 6) -> str:
    changes = ", ".join(f"round({c}, {digits}) + 0 as {c}" for c in doubles)
    return f"select * replace ({changes}) from {relation_name}"


# ---- builders shared with other registries


def models(t: Tables):
    return staging.vehicle_models(t.vehicle_models)


def energy_per_trip(t: Tables):
    return trips.trip_energy(staging.telemetry(t.telemetry))


def fct_trips(t: Tables):
    return trips.fct_trips(
        staging.trips(t.trips), energy_per_trip(t), t.vehicles, models(t), staging.routes(t.routes)
    )


def fct_telemetry(t: Tables):
    return trips.fct_vehicle_telemetry(staging.telemetry(t.telemetry), t.vehicles, models(t))


_TRIP_DOUBLES = [
    "distance_m", "energy_kwh", "tracked_seconds", "motorway_distance_m", "mean_tick_speed_kmh", "speed_stddev_kmh",
    "acceleration_abs_mean_ms2", "mean_outside_temperature_c", "min_outside_temperature_c", "mean_battery_temperature_c", "soc_used_percent",
    "start_soc_percent", "end_soc_percent", "min_soc_percent", "max_soc_percent", "motorway_distance_share_percent",
]
REG.add("trip_energy", lambda t: rounded(energy_per_trip(t)), round_all("trip_energy_raw", _TRIP_DOUBLES))
REG.add(
    "fct_trips", lambda t: rounded(fct_trips(t)),
    round_all("fct_trips_raw", [
        "reported_distance_m", "reported_energy_kwh", "reported_avg_consumption_kwh_100km", "measured_distance_m",
        "measured_energy_kwh", "tracked_seconds", "soc_used_percent", "speed_stddev_kmh", "acceleration_abs_mean_ms2",
        "mean_outside_temperature_c", "min_outside_temperature_c", "mean_battery_temperature_c", "measured_start_soc_percent",
        "measured_end_soc_percent", "energy_divergence_kwh", "energy_divergence_percent", "distance_divergence_m",
    ]),
)
REG.add(
    "fct_vehicle_telemetry", lambda t: rounded(fct_telemetry(t)),
    round_all("fct_telemetry_raw", [
        "cumulative_energy_kwh", "latitude", "longitude", "battery_soc_percent", "battery_temperature_c",
        "outside_temperature_c", "instantaneous_power_kw", "acceleration_ms2", "hvac_load_kw_estimate",
    ]),
)
REG.add("dim_vehicle_model", lambda t: models(t).join(
    t.vehicles.groupBy("vehicle_model_id").agg(F.count("*").alias("fleet_size")),
    "vehicle_model_id", "left"),
    "select d.*, f.fleet_size from dim_vehicle_model d left join "
    "(select vehicle_model_id, count(*) as fleet_size from vehicles group by 1) f using (vehicle_model_id)")

# ---- staging views
REG.add("stg_telemetry", lambda t: rounded(staging.telemetry(t.telemetry)), round_all(
    "(select * exclude (state), state as vehicle_state from telemetry)",
    ["cumulative_energy_kwh", "latitude", "longitude", "battery_soc_percent", "battery_temperature_c",
     "outside_temperature_c", "instantaneous_power_kw", "acceleration_ms2"]))
REG.add("stg_trips", lambda t: rounded(staging.trips(t.trips)), """
    select id as trip_uuid, trip_id, vehicle_id as vehicle_uuid, route_id, started_at, ended_at, start_soc_percent,
           end_soc_percent, round(distance_m, 6) + 0 as reported_distance_m, round(distance_m / 1e3, 3) as reported_distance_km,
           round(energy_kwh, 6) + 0 as reported_energy_kwh,
           round(avg_consumption_kwh_100km, 6) as reported_avg_consumption_kwh_100km, state as trip_state,
           source as source_system, source_identifier, data_origin, ingested_at from trips""")
relation("stg_station", """
    select id as station_id, external_id, nullif(trim(operator), '') as operator, nullif(trim(street), '') as street,
           nullif(trim(house_number), '') as house_number,
           case when trim(postal_code) <> '' then right('00000' || trim(postal_code), greatest(5, length(trim(postal_code)))) end as postal_code,
           nullif(trim(city), '') as city, bundesland, nullif(upper(trim(country)), '') as country, latitude, longitude,
           commissioned_on, cast(year(commissioned_on) as int) as commissioned_year, charging_points_count, max_power_kw,
           total_power_kw, charging_category, is_fast_charger, source as source_system, source_identifier, data_origin,
           ingested_at from charging_stations""")
relation("stg_point", """
    select id as charging_point_id, station_id, ordinal as connector_ordinal, connector_type, current_type, power_kw,
           nullif(trim(public_key), '') as public_key, source as source_system, data_origin from charging_points""")
REG.add("stg_charging_stations", lambda t: rounded(staging.charging_stations(t.charging_stations)),
        "select * replace (round(latitude, 6) as latitude, round(longitude, 6) as longitude, "
        "round(max_power_kw, 6) as max_power_kw, round(total_power_kw, 6) as total_power_kw) from stg_station")
REG.add("stg_charging_points", lambda t: rounded(staging.charging_points(t.charging_points)),
        "select * replace (round(power_kw, 6) as power_kw) from stg_point")
relation("stg_route", """
    select id as route_id, nullif(trim(slug), '') as slug, nullif(trim(name), '') as name, origin_name, destination_name,
           origin_latitude, origin_longitude, destination_latitude, destination_longitude, distance_m,
           round(distance_m / 1e3, 3) as distance_km, duration_s, round(duration_s / 60, 1) as duration_min,
           routing_profile, is_demo, source as source_system, data_origin, route_key from routes""")
_XY = "origin_latitude origin_longitude destination_latitude destination_longitude".split()
REG.add("stg_routes", lambda t: rounded(staging.routes(t.routes).drop("geometry")),
        "select * exclude (route_key) replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _XY) + ") from stg_route")
relation("stg_segment", """
    select id as route_segment_id, route_id, ordinal as segment_ordinal, start_offset_m,
           round(start_offset_m / 1e3, 3) as start_offset_km, distance_m as segment_distance_m,
           round(distance_m / 1e3, 3) as segment_distance_km, road_class, speed_limit_kmh, assumed_speed_kmh,
           elevation_gain_m, temperature_c, traffic_severity, predicted_kwh_per_100km, predicted_kwh, energy_intensity,
           'derived' as data_origin from route_segments""")
_SEG = "temperature_c predicted_kwh_per_100km predicted_kwh".split()
REG.add("stg_route_segments", lambda t: rounded(staging.route_segments(t.route_segments).drop("geometry")),
        "select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _SEG) + ") from stg_segment")
relation("stg_traffic", """
    select id as traffic_event_id, external_id, event_type, severity, nullif(upper(trim(road_name)), '') as road_name,
           nullif(trim(direction), '') as direction, nullif(trim(title), '') as title,
           nullif(trim(description), '') as description, latitude, longitude, extent_latitude, extent_longitude, starts_at,
           ends_at, is_blocked, delay_minutes, source as source_system, data_origin, ingested_at from traffic_events""")
REG.add("stg_traffic_events", lambda t: rounded(staging.traffic_events(t.traffic_events).drop("geometry")),
        "select * exclude (extent_latitude, extent_longitude) replace (round(latitude, 6) as latitude, "
        "round(longitude, 6) as longitude, round(delay_minutes, 6) as delay_minutes) from stg_traffic")
_MEASURES = "temperature_c precipitation_mm wind_speed_ms wind_gust_ms humidity_percent pressure_hpa".split()
relation("stg_weather", "select id as weather_observation_id, weather_station_id, observed_at, latitude, longitude, "
         + ", ".join(f"case when {c} <> -999 then {c} end as {c}" for c in _MEASURES)
         + ", condition as weather_condition, source as source_system, data_origin from weather_observations")
REG.add("stg_weather_observations", lambda t: rounded(staging.weather_observations(t.weather_observations)),
        "select * replace (" + ", ".join(f"round({c}, 6) + 0 as {c}" for c in [*_MEASURES, "latitude", "longitude"]) + ") from stg_weather")
