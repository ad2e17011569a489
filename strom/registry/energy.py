"""Queries and oracles: road-load energy, route analysis, learning."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from strom.functions import energy
from strom.functions.energy import Drive, with_segment_energy
from strom.plans import analysis, fleet, learning, route_model, staging, traffic, trips
from strom.plans import weather as weather_plans
from strom.plans.trips import rounded
from strom.registry import corridors as C
from strom.registry.analytics import tele, weather
from strom.registry.fleet_models import models
from strom.registry.oracle import RELATIONS, Registry, relation
from strom.session import checkpoint_root, cut_lineage, reuse
from strom.sources.driver import TRAFFIC_NOW, Tables

REG = Registry()


def curve_sql(curve, x: str) -> str:
    out = f"case when {x} <= {curve[0][0]} then {curve[0][1]}::double"
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out += f" when {x} < {x1} then {y0} + ({x} - ({x0})) / ({x1} - ({x0}))::double * ({y1} - {y0})"
    return f"(case when {x} is not null then {out} else {curve[-1][1]}::double end end)"


def energy_sql(source: str, prefix: str = "", **overrides: str) -> str:
    """Oracle spelling of the road-load balance: a subquery over ``source`` with the parts added."""
    d = {name: overrides.get(name, name) for name in Drive.__dataclass_fields__}
    v, cold = f"(({d['speed_kmh']}) / 3.6)", f"(1 + greatest(0, 15 - ({d['battery_temperature_c']})) * 0.008)"
    go = f"({d['duration_s']}) > 0 and ({d['speed_kmh']}) > 0"
    parts = {
        "rolling": f"({d['rolling_resistance']}) * ({d['mass_kg']}) * 9.80665::double * cos(atan(({d['gradient_percent']}) / 100)) * {v}",
        "aero": f"1.225::double * 288.15::double / (273.15::double + ({d['temperature_c']})) * 0.5 * ({d['drag_area_m2']}) * ({v} + ({d['headwind_ms']})) * abs({v} + ({d['headwind_ms']})) * {v}",
        "gradient": f"({d['mass_kg']}) * 9.80665::double * sin(atan(({d['gradient_percent']}) / 100)) * {v}",
        "inertia": f"({d['mass_kg']}) * ({d['acceleration_ms2']}) * 1.05::double * {v}",
    }
    watts = ", ".join(f"case when {go} then {e} else 0::double end as {p}_w" for p, e in parts.items())
    wheel = "(rolling_w + aero_w + gradient_w + inertia_w)"
    battery = f"case when {wheel} >= 0 then {wheel} / 0.9::double * {cold} else greatest({wheel} * 0.65::double / {cold}, -50000) end"
    to_kwh = f"case when {wheel} <> 0 then {battery} / {wheel} * greatest(({d['duration_s']}), 0) / 3600000::double else 0::double end"
    hours = f"(greatest(({d['duration_s']}), 0) / 3600::double)"
    shrink = "case when raw_ < 0 and neg_ < 0 then (neg_ - raw_) / neg_ else 1::double end"
    names = ", ".join(f"case when {p}_k < 0 then {p}_k * sc_ else {p}_k end as {prefix}{p}_kwh" for p in parts)
    total = " + ".join(f"case when {p}_k < 0 then {p}_k * sc_ else {p}_k end" for p in parts)
    drop = ", ".join([f"{p}_w, {p}_k" for p in parts])
    return f"""(select * exclude ({drop}, f_, aux_, hv_, raw_, neg_, sc_), {names}, greatest(raw_, 0) as {prefix}kwh, aux_ as {prefix}auxiliary_kwh,
        hv_ as {prefix}hvac_kwh, least(0, {total}) as {prefix}regen_kwh
      from (select *, {shrink} as sc_ from (select *, {" + ".join(f"{p}_k" for p in parts)} + aux_ + hv_ as raw_, {" + ".join(f"least({p}_k, 0)" for p in parts)} as neg_
      from (select *, {", ".join(f"{p}_w * f_ as {p}_k" for p in parts)} from (select *, {to_kwh} as f_, {hours} * 0.35::double as aux_,
        {curve_sql(energy.HVAC_CURVE, "(" + d['temperature_c'] + ")")} * {hours} as hv_ from (select *, {watts} from {source}) e1) e2) e3) e4) e5)"""


# ---- telemetry samples driven for 30 seconds each
_WIND_V, _WIND_D, _GRADE = "telemetry_id % 12", "telemetry_id * 7 % 360", "(telemetry_id % 13 - 6) / 2"


def drive_rows(t: Tables):
    """Every telemetry sample as a 30 second stretch of its vehicle."""
    fleet_profile = t.vehicles.select("vehicle_id", F.coalesce("vehicle_model_id", F.lit("vm-0")).alias("vehicle_model_id")).join(
        F.broadcast(models(t).select("vehicle_model_id", "mass_kg", "drag_area_m2", "rolling_resistance", "nominal_consumption_kwh_100km")), "vehicle_model_id")
    n = F.col("telemetry_id")
    return tele(t).join(fleet_profile, "vehicle_id").select(
        "telemetry_id", "trip_id", "vehicle_model_id", "road_class", "speed_kmh", "acceleration_ms2", "battery_temperature_c",
        "mass_kg", "drag_area_m2", "rolling_resistance", "nominal_consumption_kwh_100km",
        F.col("outside_temperature_c").alias("temperature_c"), F.lit(30.0).alias("duration_s"), (F.col("speed_kmh") * 30.0 / 3600.0).alias("distance_km"),
        ((n % 13 - 6) / 2).alias("gradient_percent"),
        energy.headwind_ms((n % 12).cast("double"), (n * 7 % 360).cast("double"), F.col("heading_deg")).alias("headwind_ms"),
        F.element_at(F.array(*(F.lit(s) for s in ("low", "moderate", "high", "severe"))), (n % 4 + 1).cast("int")).alias("traffic_severity"),
    )


relation("drive_row", f"""
    select t.telemetry_id, t.trip_id, m.vehicle_model_id, t.road_class, t.speed_kmh, t.acceleration_ms2, t.battery_temperature_c, m.mass_kg, m.drag_area_m2,
           m.rolling_resistance, m.nominal_consumption_kwh_100km, t.outside_temperature_c as temperature_c, 30::double as duration_s,
           t.speed_kmh * 30 / 3600 as distance_km, {_GRADE}::double as gradient_percent,
           ({_WIND_V}) * cos(radians(({_WIND_D}) - t.heading_deg)) as headwind_ms,
           case telemetry_id % 4 when 0 then 'low' when 1 then 'moderate' when 2 then 'high' else 'severe' end as traffic_severity
    from telemetry t join vehicles v using (vehicle_id) join dim_vehicle_model m on m.vehicle_model_id = coalesce(v.vehicle_model_id, 'vm-0')""")
relation("drive_energy", f"select * from {energy_sql('drive_row')}")
_PARTS = ("kwh", "rolling_kwh", "aero_kwh", "gradient_kwh", "inertia_kwh", "auxiliary_kwh", "hvac_kwh", "regen_kwh")
_ROUNDED = ", ".join(f"round({p}, 6) + 0 as {p}" for p in _PARTS)
REG.add("segment_energy", lambda t: rounded(with_segment_energy(drive_rows(t)).select("telemetry_id", *_PARTS)),
        f"select telemetry_id, {_ROUNDED} from drive_energy")
REG.add("consumption", lambda t: rounded(with_segment_energy(drive_rows(t)).select(
    "telemetry_id", energy.consumption_kwh_per_100km(F.col("kwh"), F.col("distance_km")).alias("kwh_per_100km")), 4),
    "select telemetry_id, round(case when distance_km > 0 then kwh / distance_km * 100 when distance_km = 0 then 0 end, 4) as kwh_per_100km from drive_energy")
_WHEEL = "(w_roll + w_aero + w_grade + w_inert)"
REG.add("instantaneous_power", lambda t: rounded(drive_rows(t).select("telemetry_id", energy.instantaneous_power_kw(Drive.of()).alias("power_kw"))), f"""
    select telemetry_id, round(case when speed_kmh > 0 then (case when {_WHEEL} >= 0 then {_WHEEL} / 0.9::double * cold
               else greatest({_WHEEL} * 0.65::double / cold, -50000) end) / 1000 + idle else idle end, 6) as power_kw
    from (select telemetry_id, speed_kmh, rolling_resistance * mass_kg * 9.80665::double * cos(atan(gradient_percent / 100)) * speed_kmh / 3.6 as w_roll,
                 1.225::double * 288.15 / (273.15 + temperature_c) * 0.5 * drag_area_m2 * (speed_kmh / 3.6 + headwind_ms) * abs(speed_kmh / 3.6 + headwind_ms) * speed_kmh / 3.6 as w_aero,
                 mass_kg * 9.80665::double * sin(atan(gradient_percent / 100)) * speed_kmh / 3.6 as w_grade, mass_kg * acceleration_ms2 * 1.05::double * speed_kmh / 3.6 as w_inert,
                 1 + greatest(0, 15 - battery_temperature_c) * 0.008::double as cold, {curve_sql(energy.HVAC_CURVE, "temperature_c")} + 0.35::double as idle from drive_row)""")
REG.add("headwind", lambda t: drive_rows(t).select("telemetry_id", (F.round("headwind_ms", 6) + 0.0).alias("headwind_ms")),
        "select telemetry_id, round(headwind_ms, 6) + 0 as headwind_ms from drive_row")
REG.add("trip_totals", lambda t: rounded(with_segment_energy(drive_rows(t)).where("trip_id is not null").groupBy("trip_id").agg(
    *(F.sum(c).alias(c) for c in (*_PARTS, "distance_km", "duration_s"))), 9),
    "select trip_id, " + ", ".join(f"round(sum({p}), 9) + 0 as {p}" for p in (*_PARTS, "distance_km", "duration_s")) + " from drive_energy where trip_id is not null group by 1")
REG.add("distance_weighted", lambda t: rounded(analysis.distance_weighted(drive_rows(t).where("trip_id is not null"), ["trip_id"]), 5), """
    select trip_id, round(sum(speed_kmh * distance_km) / nullif(sum(distance_km), 0), 5) as speed_kmh, round(sum(headwind_ms * distance_km) / nullif(sum(distance_km), 0), 5) + 0 as headwind_ms,
           round(sum(temperature_c * distance_km) / nullif(sum(distance_km), 0), 5) + 0 as temperature_c,
           round(sum(case when road_class = 'motorway' then distance_km else 0 end) / nullif(sum(distance_km), 0) * 100, 5) as motorway_share_percent,
           round(sum(greatest(gradient_percent / 100 * distance_km * 1000, 0)), 5) as climb_m, round(sum(greatest(-gradient_percent / 100 * distance_km * 1000, 0)), 5) + 0 as descent_m
    from drive_row where trip_id is not null group by 1""")
REG.add("rescale_to_model", lambda t: rounded(analysis.rescale_to_model(
    with_segment_energy(drive_rows(t)), F.col("kwh") * (F.lit(1.0) + (F.col("telemetry_id") % 5) / 100.0)).select("telemetry_id", *_PARTS), 10),
    "select telemetry_id, " + ", ".join(f"round({p} * case when kwh > 0 then 1 + (telemetry_id % 5) / 100 else 1 end, 10) + 0 as {p}" for p in _PARTS) + " from drive_energy")

# ---- the ladder of drivers, per trip
_FACTOR = "(case traffic_severity when 'moderate' then 1.15 when 'high' then 1.4 when 'severe' then 2.0 else 1.0 end::double)"
_FREE, _FREE_S = f"speed_kmh * {_FACTOR}", f"(case when speed_kmh > 0 then distance_km / (speed_kmh * {_FACTOR}) * 3600 end)"


def ladder_rows(t: Tables):
    driven = drive_rows(t).where((F.col("speed_kmh") > 0) & F.col("trip_id").isNotNull())
    served = with_segment_energy(driven, prefix="_s_").withColumn("actual_kwh", F.col("_s_kwh") * 1.03)
    return served.drop(*(f"_s_{p}" for p in _PARTS))


_r = energy_sql("(select * exclude (kwh, rolling_kwh, aero_kwh, gradient_kwh, inertia_kwh, auxiliary_kwh, hvac_kwh, regen_kwh), kwh * 1.03 as kwh "
                "from drive_energy where speed_kmh > 0 and trip_id is not null)", "reference_",
                speed_kmh=_FREE, duration_s=_FREE_S, temperature_c="20", battery_temperature_c="20", gradient_percent="0", headwind_ms="0")
_r = energy_sql(_r, "gradient_", speed_kmh=_FREE, duration_s=_FREE_S, temperature_c="20", battery_temperature_c="20", headwind_ms="0")
_r = energy_sql(_r, "traffic_", temperature_c="20", battery_temperature_c="20", headwind_ms="0")
_r = energy_sql(_r, "temperature_", headwind_ms="0")
_r = energy_sql(_r, "wind_")
relation("ladder_sum", f"""
    select trip_id, sum(reference_kwh) as r, sum(reference_auxiliary_kwh) + sum(reference_hvac_kwh) as st, sum(gradient_kwh) as g, sum(traffic_kwh) as t,
           sum(temperature_kwh) as c, sum(wind_kwh) as w, sum(kwh) as a, any_value(nominal_consumption_kwh_100km) * sum(distance_km) / 100 as nom from {_r} group by 1""")
REG.add("driver_ladder", lambda t: rounded(analysis.driver_ladder(ladder_rows(t), ["trip_id"]), 8), """
    with d as (select trip_id, nom, unnest([{'f': 'speed_profile', 'd': r - st - nom}, {'f': 'auxiliary', 'd': st}, {'f': 'gradient', 'd': g - r}, {'f': 'traffic', 'd': t - g},
                      {'f': 'temperature', 'd': c - t}, {'f': 'wind', 'd': w - c}, {'f': 'model_correction', 'd': a - w}]) as x from ladder_sum),
    k as (select trip_id, x.f as factor, x.d as delta_kwh, x.d / nom * 100 as pct, row_number() over (partition by trip_id order by round(abs(x.d / nom * 100), 6) desc, x.f) as rank from d)
    select trip_id, rank::int as rank, factor, round(delta_kwh, 8) + 0 as delta_kwh, round(pct, 8) + 0 as delta_percent,
           case when pct > 0.5 then 'increase' when pct < -0.5 then 'decrease' else 'neutral' end as direction from k where rank = 1 or abs(pct) >= 0.5""")

# ---- batch route analysis
relation("event_line_segment", C.EVENT_LINE_SEGMENT)


def condition_inputs(t: Tables, routes=None, tallied: bool = False):
    """Segments of ``routes`` (those that requests name, if not given), events, their pairs, and each segment's nearest reading at the fixed analysis time.

    With ``tallied`` rows of segments with figures of several events stand for the pairs.
    """
    on_routes = cut_lineage(C.routed_segments(t, t.requests if routes is None else routes))
    events = staging.traffic_events(t.traffic_events)
    tally = analysis.severity_tally(events)
    if tallied:
        pairs = traffic.event_tally_on_segments(events, on_routes, C.AT, 1500.0, tally)
    else:
        pairs = traffic.event_lines_on_segments(events, on_routes, C.AT, 1500.0, keep=tally)
    middles = on_routes.select("route_segment_id", ((F.col("geometry")[0].latitude + F.col("geometry")[1].latitude) / 2).alias("latitude"),
                                   ((F.col("geometry")[0].longitude + F.col("geometry")[1].longitude) / 2).alias("longitude"))
    readings = weather_plans.nearest_observation(middles, ["route_segment_id"], weather(t), C.AT, 150_000.0)
    return on_routes, events, pairs, readings


def conditions(t: Tables, routes=None):
    """Conditions on the segments of ``condition_inputs``."""
    on_routes, events, pairs, readings = condition_inputs(t, routes, tallied=True)
    return cut_lineage(analysis.segment_conditions(on_routes, pairs, events, readings, C.AT))


_COND = ("distance_km", "free_flow_speed_kmh", "speed_kmh", "duration_s", "temperature_c", "precipitation_mm", "wind_speed_ms")
_HOURS = f"(epoch_us(timestamp '{TRAFFIC_NOW}') - epoch_us(observed_at)) / 3.6e9"
relation("segment_reading", """
    select p.route_segment_id, d, f.observed_at, f.temperature_c, f.precipitation_mm, f.wind_speed_ms
    from (select p.route_segment_id, s.weather_station_id, sqrt(power(px - sx, 2) + power(py - sy, 2)) as d from middle_xy p, freshest_xy s) p
    join freshest f using (weather_station_id) where d <= 150000
    qualify row_number() over (partition by p.route_segment_id order by d, weather_station_id) = 1""")
relation("condition_raw", f"""
    with base as (select s.route_segment_id, s.route_id, s.segment_ordinal, s.start_offset_m, s.segment_distance_m / 1e3 as distance_km, s.road_class, s.speed_limit_kmh,
                         s.assumed_speed_kmh, coalesce(w.sev, 'low') as traffic_severity, coalesce(w.n, 0) as event_count, r.temperature_c as t_c, r.precipitation_mm as rain, r.wind_speed_ms as wind
                  from stg_segment s join routes ro on ro.id = s.route_id
                  left join (select route_segment_id, arg_max(severity, severity_ordinal) as sev, count(*) as n from event_line_segment join traffic_fact using (traffic_event_id) group by 1) w using (route_segment_id)
                  left join (select * from segment_reading where {_HOURS} <= 200) r using (route_segment_id))
    select * exclude (assumed_speed_kmh, t_c, rain, wind, ff), ff as free_flow_speed_kmh, greatest(5, ff / {_FACTOR}) as speed_kmh, distance_km / greatest(5, ff / {_FACTOR}) * 3600 as duration_s
    from (select *, coalesce(t_c, avg(t_c) over (partition by route_id), 20) as temperature_c, coalesce(rain, 0) as precipitation_mm, coalesce(wind, 0) as wind_speed_ms,
                 greatest(5, case when assumed_speed_kmh > 0 then assumed_speed_kmh else least(case road_class when 'motorway' then 130 when 'trunk' then 120 when 'tertiary' then 80
                     when 'residential' then 50 when 'service' then 30 else 100 end::double, speed_limit_kmh) end) as ff from base)""")
REG.add("segment_conditions", lambda t: rounded(conditions(t, C.stg_routes(t))),
        "select * replace (" + ", ".join(f"round({c}, 6) + 0 as {c}" for c in _COND) + ") from condition_raw")
_STEADY = {"battery_temperature_c": "temperature_c", "gradient_percent": "0", "headwind_ms": "0", "acceleration_ms2": "0"}
relation("driven_raw", """
    select c.*, m.vehicle_model_id, m.mass_kg, m.drag_area_m2, m.rolling_resistance, m.usable_capacity_kwh, m.nominal_consumption_kwh_100km
    from condition_raw c join (select distinct route_id, vehicle_model_id from requests) q using (route_id) join dim_vehicle_model m using (vehicle_model_id)""")
relation("driven_energy", f"select * from {energy_sql('driven_raw', **_STEADY)}")
_MILD = dict(_STEADY, temperature_c="20", battery_temperature_c="20")
_c = energy_sql("driven_raw", **_STEADY)
_c = energy_sql(_c, "free_", **dict(_STEADY, speed_kmh=_FREE, duration_s=_FREE_S))
_c = energy_sql(_c, "mild_", **_MILD)
_c = energy_sql(_c, "neutral_", **dict(_MILD, speed_kmh=_FREE, duration_s=_FREE_S))
relation("pair_total", f"""
    select route_id, vehicle_model_id, sum(kwh) as kwh, sum(free_kwh) as free_kwh, sum(mild_kwh) as mild_kwh, sum(neutral_kwh) as neutral_kwh, sum(distance_km) as distance_km,
           sum(duration_s) as duration_s, any_value(usable_capacity_kwh) as usable, any_value(nominal_consumption_kwh_100km) as nominal from {_c} group by 1, 2""")
REG.add("counterfactuals", lambda t: rounded(analysis.pair_totals(analysis.for_vehicles(conditions(t), t.requests, models(t))).select(
    "route_id", "vehicle_model_id", "kwh", "free_kwh", "mild_kwh", "neutral_kwh", "weather_penalty_percent", "traffic_penalty_percent", "total_penalty_percent"), 4), """
    select route_id, vehicle_model_id, round(kwh, 4) as kwh, round(free_kwh, 4) as free_kwh, round(mild_kwh, 4) as mild_kwh, round(neutral_kwh, 4) as neutral_kwh,
           round((kwh - mild_kwh) / mild_kwh * 100, 4) + 0 as weather_penalty_percent, round((kwh - free_kwh) / free_kwh * 100, 4) + 0 as traffic_penalty_percent,
           round((kwh - neutral_kwh) / neutral_kwh * 100, 4) + 0 as total_penalty_percent from pair_total""")
REG.add("route_analysis", lambda t: rounded(analysis.route_analysis(t.requests, conditions(t), models(t)), 4), """
    select request_id, route_id, vehicle_model_id, start_soc_percent, round(least(100, greatest(0, arr)), 4) as arrival_soc_percent, round(kwh, 4) as energy_kwh_total,
           round(greatest(0, (10 - arr) / 100 * usable), 4) + 0 as energy_deficit_kwh, (10 - arr) > 0 as charging_required, round(distance_km, 4) as distance_km,
           round(duration_s, 4) as estimated_duration_s, round(kwh / distance_km * 100, 4) as avg_consumption_kwh_100km,
           case when kwh / distance_km * 100 / nominal < 0.95 then 'low' when kwh / distance_km * 100 / nominal < 1.10 then 'medium' when kwh / distance_km * 100 / nominal < 1.30 then 'high' else 'critical' end as energy_intensity,
           round((kwh - mild_kwh) / mild_kwh * 100, 4) + 0 as weather_penalty_percent, round((kwh - free_kwh) / free_kwh * 100, 4) + 0 as traffic_penalty_percent,
           round((kwh - neutral_kwh) / neutral_kwh * 100, 4) + 0 as total_penalty_percent, round(least(100, greatest(0, (start_soc_percent + greatest(0, arr)) / 2)), 4) as mean_soc_percent
    from (select q.*, p.* exclude (route_id, vehicle_model_id), start_soc_percent - kwh / usable * 100 as arr from requests q join pair_total p using (route_id, vehicle_model_id))""")
REG.add("soc_trajectory", lambda t: rounded(analysis.soc_trajectory(t.requests, conditions(t), models(t)), 4), """
    select request_id, segment_ordinal, round(soc, 4) + 0 as soc_percent, round(least(100, greatest(0, soc)), 4) + 0 as soc_at_end_percent
    from (select request_id, segment_ordinal, start_soc_percent - upto / usable_capacity_kwh * 100 as soc from requests join (
        select route_id, vehicle_model_id, segment_ordinal, usable_capacity_kwh, sum(kwh) over (partition by route_id, vehicle_model_id order by segment_ordinal) as upto
        from driven_energy) using (route_id, vehicle_model_id))""")
REG.add("features_from_conditions", lambda t: rounded(learning.features_from_conditions(
    analysis.for_vehicles(conditions(t), t.requests, models(t))), 4), f"""
    select route_segment_id, vehicle_model_id, round(speed_kmh, 4) as speed_kmh, round(speed_kmh, 4) as avg_speed_kmh, 0::double as speed_std_kmh, 0::double as acceleration_abs_mean_ms2,
           0::double as accel_events_per_km, round(temperature_c, 4) + 0 as outside_temperature_c, round(temperature_c, 4) + 0 as battery_temperature_c, 60::double as soc_percent,
           case road_class when 'motorway' then 6 when 'trunk' then 5 when 'primary' then 4 when 'secondary' then 3 when 'residential' then 1 else 0 end::double as road_class_ordinal,
           coalesce(speed_limit_kmh, case road_class when 'motorway' then 130 when 'trunk' then 120 when 'residential' then 50 else 100 end::double) as speed_limit_kmh,
           case traffic_severity when 'low' then 1 when 'moderate' then 2 when 'high' then 3 else 4 end::double as traffic_severity_ordinal, round(precipitation_mm, 4) as precipitation_mm,
           round(wind_speed_ms, 4) as wind_speed_ms, 0::double as gradient_percent, round(distance_km, 4) as segment_distance_km, mass_kg, drag_area_m2 as drag_area, nominal_consumption_kwh_100km,
           round({curve_sql(energy.HVAC_CURVE, "temperature_c")}, 4) + 0 as hvac_load_kw, (road_class = 'motorway')::int::double as is_motorway from driven_raw""")

# ---- route analysis by a model: a fixed linear one stands for a trained pipeline, so that the oracle can work it out again
LINEAR = ("4.0137e0 + 0.0703141e0 * speed_kmh + 0.1207397e0 * (25 - outside_temperature_c) + 0.0101377e0 * (100 - soc_percent) + 0.3011713e0 * traffic_severity_ordinal"
          " + 0.2013931e0 * precipitation_mm + 0.0010173e0 * mass_kg + 0.4019773e0 * hvac_load_kw")


def linear_model(t: Tables):
    """Saved and loaded again, as a trained pipeline would be."""
    path = f"{checkpoint_root(t.spark)}/strom-model-{uuid.uuid4().hex}"
    route_model.save_model(PipelineModel(stages=[SQLTransformer(statement=f"select *, cast({LINEAR} as double) as predicted from __THIS__")]), path)
    return route_model.load_model(t.spark, path)


class ModelRun:
    """Tables that the answers, drivers and segments of one model share."""

    def __init__(self, t: Tables, model):
        self.requests = t.requests
        segments, events, pairs, readings = condition_inputs(t)
        pairs, readings = cut_lineage(pairs), cut_lineage(readings)
        told = cut_lineage(analysis.segment_conditions(segments, pairs, events, readings, C.AT))
        self.driven = route_model.driven_energies(t.requests, told, models(t))
        self.served = cut_lineage(route_model.served_segments(self.driven, route_model.charge_cases(t.requests, self.driven), model))
        self.totals = cut_lineage(route_model.case_totals(self.served))
        age = (F.unix_micros(F.lit(C.AT)) - F.unix_micros("observed_at")) / 3.6e9
        used = readings.where((F.col("distance_m") <= 150_000.0) & (age <= 200.0))
        event_modes = t.traffic_events.select(F.col("id").alias("traffic_event_id"), F.when(F.col("source") == "police", "fixture").otherwise("live").alias("provider_mode"))
        # every seventh station's readings come from a test file
        fixture = F.substring("id", 2, 20).cast("bigint") % 7 == 0
        reading_modes = t.weather_stations.select(F.col("id").alias("weather_station_id"), F.when(fixture, "fixture").otherwise("live").alias("provider_mode"))
        lines = t.routes.select(F.col("id").alias("route_id"), F.when(F.col("is_demo"), "cache").otherwise("live").alias("routing_mode"))
        self.modes = route_model.source_modes(lines, pairs, event_modes, used, reading_modes, segments)


relation("charge_case", """
    select distinct route_id, vehicle_model_id, start_soc_percent, usable,
           least(100, greatest(0, (start_soc_percent + greatest(0, start_soc_percent - kwh / usable * 100)) / 2)) as soc_percent
    from requests join pair_total using (route_id, vehicle_model_id)""")
relation("served_raw", f"""
    select *, case when physical_kwh > 0 then greatest(0, {LINEAR}) * distance_km / 100 else physical_kwh end as served_kwh
    from (select d.* exclude (kwh), d.kwh as physical_kwh, start_soc_percent, soc_percent, usable, temperature_c as outside_temperature_c,
                 case traffic_severity when 'low' then 1 when 'moderate' then 2 when 'high' then 3 else 4 end as traffic_severity_ordinal,
                 {curve_sql(energy.HVAC_CURVE, "temperature_c")} as hvac_load_kw
          from driven_energy d join charge_case using (route_id, vehicle_model_id))""")
relation("served_total", "select route_id, vehicle_model_id, start_soc_percent, sum(served_kwh) as served, any_value(usable) as usable, any_value(soc_percent) as soc, "
         + ", ".join(f"sum(case when physical_kwh > 0 then {p} * served_kwh / physical_kwh else {p} end) as {p}" for p in energy.ENERGY_FIELDS if p != "kwh") + " from served_raw group by 1, 2, 3")
relation("route_mode", f"""
    select route_id, routing, coalesce(w.m, 3) as weather, coalesce(e.m, 3) as traffic
    from (select id as route_id, case when is_demo then 2 else 1 end as routing from routes)
    left join (select route_id, max(case when substr(s.weather_station_id, 2)::bigint % 7 = 0 then 3 else 2 end) as m
               from (select p.route_segment_id, p.weather_station_id, f.observed_at from (
                         select p.route_segment_id, s.weather_station_id, sqrt(power(px - sx, 2) + power(py - sy, 2)) as d from middle_xy p, freshest_xy s) p
                     join freshest f using (weather_station_id) where d <= 150000 qualify row_number() over (partition by p.route_segment_id order by d, weather_station_id) = 1) s
               join stg_segment g using (route_segment_id) where {_HOURS} <= 200 group by 1) w using (route_id)
    left join (select route_id, max(case when source = 'police' then 3 else 2 end) as m
               from event_line_segment l join traffic_events t on t.id = l.traffic_event_id join stg_segment g using (route_segment_id) group by 1) e using (route_id)""")
_OTHER_PARTS = [p for p in energy.ENERGY_FIELDS if p != "kwh"]
REG.add("route_analysis_model", lambda t: rounded((lambda run: route_model.answers(run.requests, run.totals, run.modes, "linear"))(ModelRun(t, linear_model(t))), 4), f"""
    select request_id, route_id, vehicle_model_id, start_soc_percent, round(least(100, greatest(0, arr)), 4) as arrival_soc_percent, round(served, 4) as energy_kwh_total,
           round(greatest(0, (10 - arr) / 100 * usable), 4) + 0 as energy_deficit_kwh, (10 - arr) > 0 as charging_required, round(distance_km, 4) as distance_km,
           round(duration_s, 4) as estimated_duration_s, round(served / distance_km * 100, 4) as avg_consumption_kwh_100km, round(kwh / distance_km * 100, 4) as baseline_kwh_100km,
           round(served / distance_km * 100, 4) as model_kwh_100km, 'linear' as model_name,
           case when served / distance_km * 100 / nominal < 0.95 then 'low' when served / distance_km * 100 / nominal < 1.10 then 'medium' when served / distance_km * 100 / nominal < 1.30 then 'high' else 'critical' end as energy_intensity,
           round((kwh - mild_kwh) / mild_kwh * 100, 4) + 0 as weather_penalty_percent, round((kwh - free_kwh) / free_kwh * 100, 4) + 0 as traffic_penalty_percent,
           round((kwh - neutral_kwh) / neutral_kwh * 100, 4) + 0 as total_penalty_percent, round(soc, 4) as mean_soc_percent,
           {", ".join(f"round({p}, 4) + 0 as {p}" for p in _OTHER_PARTS)},
           names[routing] as routing_mode, names[weather] as weather_mode, names[traffic] as traffic_mode, names[greatest(routing, weather, traffic)] as data_mode
    from (select q.request_id, q.route_id, q.vehicle_model_id, q.start_soc_percent, s.* exclude (route_id, vehicle_model_id, start_soc_percent, usable), p.* exclude (route_id, vehicle_model_id),
                 m.* exclude (route_id), q.start_soc_percent - served / p.usable * 100 as arr, ['live', 'cache', 'fixture'] as names
          from requests q join served_total s using (route_id, vehicle_model_id, start_soc_percent) join pair_total p using (route_id, vehicle_model_id) join route_mode m using (route_id))""")
_d = energy_sql("driven_raw", "reference_", **dict(_MILD, speed_kmh=_FREE, duration_s=_FREE_S))
_d = energy_sql(_d, "traffic_", **_MILD)
_d = energy_sql(_d, "temperature_", **_STEADY)
relation("pair_ladder", f"""
    select route_id, vehicle_model_id, sum(reference_kwh) as r, sum(reference_auxiliary_kwh) + sum(reference_hvac_kwh) as st, sum(traffic_kwh) as t, sum(temperature_kwh) as c,
           any_value(nominal_consumption_kwh_100km) * sum(distance_km) / 100 as nom from {_d} group by 1, 2""")
REG.add("route_drivers", lambda t: rounded((lambda run: route_model.drivers(run.requests, run.driven, run.totals))(ModelRun(t, linear_model(t))), 4), """
    with d as (select route_id, vehicle_model_id, start_soc_percent, nom, unnest([{'f': 'speed_profile', 'd': r - st - nom}, {'f': 'auxiliary', 'd': st}, {'f': 'gradient', 'd': 0::double},
                      {'f': 'traffic', 'd': t - r}, {'f': 'temperature', 'd': c - t}, {'f': 'wind', 'd': 0::double}, {'f': 'model_correction', 'd': served - c}]) as x
               from served_total join pair_ladder using (route_id, vehicle_model_id)),
    k as (select *, x.d / nom * 100 as pct, row_number() over (partition by route_id, vehicle_model_id, start_soc_percent order by round(abs(x.d / nom * 100), 6) desc, x.f) as rank from d)
    select request_id, route_id, vehicle_model_id, start_soc_percent, rank::int as rank, x.f as factor, round(x.d, 4) + 0 as delta_kwh, round(pct, 4) + 0 as delta_percent,
           case when pct > 0.5 then 'increase' when pct < -0.5 then 'decrease' else 'neutral' end as direction
    from requests join k using (route_id, vehicle_model_id, start_soc_percent) where rank = 1 or abs(pct) >= 0.5""")
REG.add("route_segments_model", lambda t: rounded(route_model.segment_answers(ModelRun(t, linear_model(t)).served), 4), """
    select route_id, vehicle_model_id, start_soc_percent, segment_ordinal, route_segment_id, round(served_kwh, 4) as kwh, round(served_kwh / distance_km * 100, 4) as kwh_per_100km,
           round(physical_kwh / distance_km * 100, 4) as baseline_kwh_per_100km, round(least(100, greatest(0, start_soc_percent - upto / usable * 100)), 4) + 0 as soc_at_end_percent,
           case when q < 0.95 then 'low' when q < 1.10 then 'medium' when q < 1.30 then 'high' else 'critical' end as energy_intensity
    from (select *, served_kwh / distance_km * 100 / nominal_consumption_kwh_100km as q,
                 sum(served_kwh) over (partition by route_id, vehicle_model_id, start_soc_percent order by segment_ordinal) as upto from served_raw)""")
REG.add("free_flow_speed", lambda t: C.segments(t).select("route_segment_id", analysis.free_flow_speed(
    F.col("assumed_speed_kmh"), F.col("road_class"), F.col("speed_limit_kmh")).alias("free_flow_speed_kmh")), """
    select route_segment_id, greatest(5, case when assumed_speed_kmh > 0 then assumed_speed_kmh else least(case road_class when 'motorway' then 130 when 'trunk' then 120 when 'tertiary' then 80
        when 'residential' then 50 when 'service' then 30 else 100 end::double, speed_limit_kmh) end) as free_flow_speed_kmh from stg_segment""")

# ---- charging curves on every request's vehicle and start charge
REG.add("charge_time", lambda t: rounded(t.requests.join(F.broadcast(models(t).select("vehicle_model_id", "max_dc_power_kw", "usable_capacity_kwh")), "vehicle_model_id").select(
    "request_id", energy.charging_power_kw(F.col("max_dc_power_kw"), F.col("start_soc_percent"), F.lit(5.0)).alias("power_kw"),
    energy.charge_time_minutes(F.col("max_dc_power_kw"), F.col("usable_capacity_kwh"), F.col("start_soc_percent"), F.lit(90.0), F.lit(150.0), F.lit(20.0)).alias("minutes_to_90")), 9), f"""
    with q as (select request_id, start_soc_percent as s, max_dc_power_kw as dc, usable_capacity_kwh as cap, greatest(1, ceil((90 - start_soc_percent) / 0.25)) as n
               from requests join dim_vehicle_model using (vehicle_model_id)),
    step as (select request_id, s, dc, cap, (90 - s) / n as w, unnest(range(n::bigint)) as i from q where s < 90)
    select q.request_id, round(case when q.s >= 100 then 0 else q.dc * {curve_sql(energy.SOC_TAPER, "q.s")} * 0.75 end, 9) + 0 as power_kw,
           round(coalesce(sum(step.cap * w / 100 / least(150, greatest(1, step.dc * {curve_sql(energy.SOC_TAPER, "(step.s + (i + 0.5) * w)")})) * 60), 0), 9) as minutes_to_90
    from q left join step using (request_id) group by q.request_id, q.s, q.dc""")

# ---- learning


def window_input(t: Tables):
    n = F.col("telemetry_id")
    steps = trips.telemetry_steps(tele(t))
    extra = tele(t).select("telemetry_id", "speed_limit_kmh", "vehicle_state")
    congestion = fleet.congestion_class(F.col("speed_kmh"), F.col("speed_limit_kmh"), F.col("road_class"))
    return steps.join(extra, "telemetry_id").withColumns({
        "severity_ordinal": F.coalesce(congestion, F.lit(1)), "precipitation_mm": (n % 5) / 10.0,
        "wind_speed_ms": (n % 12).cast("double"), "gradient_percent": (n % 13 - 6) / 2.0,
    })


def vehicle_profiles(t: Tables):
    return t.vehicles.select("vehicle_id", "vehicle_model_id").join(F.broadcast(models(t)), "vehicle_model_id")


def windows(t: Tables):
    return learning.window_features(window_input(t), vehicle_profiles(t))


_REFV = "coalesce(nullif(speed_limit_kmh, 0), case road_class " + " ".join(f"when '{k}' then {v}" for k, v in fleet.REFERENCE_SPEED_KMH.items()) + " end)"
_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unknown")
relation("window_raw", f"""
    with s as (select st.*, floor((epoch_us(recorded_at) - epoch_us(min(recorded_at) over (partition by trip_id))) / 6e7)::bigint as window_index,
                      min(recorded_at) over (partition by trip_id) as first_at, state,
                      coalesce(case when speed_kmh / {_REFV} >= 0.9 then 1 when speed_kmh / {_REFV} >= 0.7 then 2 when speed_kmh / {_REFV} >= 0.5 then 3 when {_REFV} is not null then 4 end, 1) as sev
               from trip_steps st),
    w as (select trip_id, vehicle_id, window_index, any_value(first_at) as first_at, sum(dm / 1e3) filter (dm >= 0) as distance_km, sum(dt) as duration_s, sum(de) filter (de >= 0) as energy_kwh,
                 avg(speed_kmh) as v, avg(speed_kmh * speed_kmh) as vv, avg(abs(acceleration_ms2)) as acc, count(*) filter (abs(acceleration_ms2) > 0.5) as ev,
                 avg(outside_temperature_c) as outside_temperature_c, avg(battery_temperature_c) as battery_temperature_c, avg((telemetry_id % 5) / 10) as precipitation_mm,
                 avg(telemetry_id % 12) as wind_speed_ms, avg((telemetry_id % 13 - 6) / 2) as gradient_percent, avg(battery_soc_percent) as soc_percent,
                 avg(coalesce(speed_limit_kmh, 130)) as speed_limit_kmh, round_even(avg(sev), 0)::int as sevo, bool_and(state = 'driving') as ok,
                 {", ".join(f"count(*) filter (road_class = '{c}') as c_{c}" for c in _CLASSES)} from s group by 1, 2, 3)
    select trip_id, vehicle_id, window_index, m.vehicle_model_code as vehicle_code, m.mass_kg, m.drag_area_m2 as drag_area, m.nominal_consumption_kwh_100km,
           first_at + to_microseconds(window_index * 60000000) as window_start, first_at + to_microseconds((window_index + 1) * 60000000) as window_end, distance_km, duration_s, energy_kwh, v as speed_kmh,
           distance_km / (duration_s / 3600) as avg_speed_kmh, sqrt(greatest(0, vv - v * v)) as speed_std_kmh, acc as acceleration_abs_mean_ms2, ev / distance_km as accel_events_per_km,
           outside_temperature_c, battery_temperature_c, precipitation_mm, wind_speed_ms, gradient_percent, soc_percent, speed_limit_kmh,
           greatest({", ".join(f"{{'n': c_{c}, 'r': {r}, 'c': '{c}'}}" for c, r in zip(_CLASSES, (6, 5, 4, 3, 2, 1, 1, 0)))}).c as road_class,
           ['low', 'moderate', 'high', 'severe'][greatest(1, least(4, sevo))] as traffic_severity, greatest(1, least(4, sevo)) as traffic_severity_ordinal, distance_km as segment_distance_km,
           {curve_sql(energy.HVAC_CURVE, "outside_temperature_c")} as hvac_load_kw, energy_kwh / distance_km * 100 as energy_consumption_kwh_100km, 'simulated' as data_origin
    from w join vehicles ve using (vehicle_id) join dim_vehicle_model m using (vehicle_model_id) where ok and distance_km >= 0.05 and duration_s > 0""")
_WD = ("distance_km duration_s energy_kwh speed_kmh avg_speed_kmh speed_std_kmh acceleration_abs_mean_ms2 accel_events_per_km outside_temperature_c battery_temperature_c precipitation_mm "
       "wind_speed_ms gradient_percent soc_percent speed_limit_kmh segment_distance_km hvac_load_kw energy_consumption_kwh_100km").split()
relation("window_row", """select *, case road_class when 'motorway' then 6 when 'trunk' then 5 when 'primary' then 4 when 'secondary' then 3 when 'tertiary' then 2 when 'residential' then 1 when 'service' then 1 else 0 end as road_class_ordinal,
    (road_class = 'motorway')::int as is_motorway from window_raw""")
WINDOW_ROW_SQL = "select * replace (" + ", ".join(f"round({c}, 8) + 0 as {c}" for c in _WD) + f") from ({RELATIONS['window_row']})"
REG.add("window_features", lambda t: rounded(windows(t), 8), WINDOW_ROW_SQL)


def dirty(t: Tables):
    """The windows twice over, so that every repeated window is dropped again."""
    rows = cut_lineage(windows(t))
    return rows.withColumn("copy", F.lit(0)).unionByName(rows.withColumn("copy", F.lit(1)))


_RULE = """case when vehicle_code is null then 'null_identifier' when soc_percent is null or energy_kwh is null then 'null_numeric' when energy_consumption_kwh_100km <= 0 then 'non_positive_target'
    when energy_consumption_kwh_100km < 1 then 'implausible_low_target' when energy_consumption_kwh_100km > 120 then 'implausible_target' when soc_percent not between 0 and 100 then 'soc_out_of_range' end"""
REG.add("clean_training_windows", lambda t: learning.clean_training_windows(dirty(t), "copy")[1], f"""
    select coalesce(rule, 'kept') as rule, count(*) as rows from (select {_RULE} as rule from window_row union all select coalesce({_RULE}, 'duplicate_window') from window_row) group by 1""")
REG.add("feature_problems", lambda t: learning.feature_problems(windows(t)), " union all ".join(
    f"select '{f}' as feature, count(*) filter ({f} is null) as null_count, 0::bigint as non_finite_count from window_row" for f in learning.FEATURES))


def training_rows(t: Tables):
    return learning.clean_training_windows(cut_lineage(windows(t)).withColumn("copy", F.lit(0)), "copy")[0]


REG.add("project_features", lambda t: rounded(learning.project_features(reuse(training_rows(t))), 8),
        "select " + ", ".join(f"round({f}, 8)::double + 0 as {f}" for f in learning.FEATURES) + f" from window_row where ({_RULE}) is null")
_FOLD = "case when p < 0.7 then 'train' when p < 0.85 then 'validation' else 'test' end"
REG.add("grouped_split", lambda t: learning.grouped_split(training_rows(t)).groupBy("trip_id", "fold").agg(F.count("*").alias("rows")),
        f"select trip_id, {_FOLD} as fold, count(*) as rows from (select trip_id, ('0x' || substr(md5('42:' || trip_id), 1, 7))::bigint / 268435456 as p from window_row where ({_RULE}) is null) group by 1, 2")
relation("baseline_raw", "select *, kwh / distance_km * 100 as baseline from " + energy_sql(
    f"(select w.* exclude (mass_kg), m.mass_kg, m.drag_area_m2, m.rolling_resistance from window_row w join dim_vehicle_model m on m.vehicle_model_code = w.vehicle_code where ({_RULE}) is null)",
    temperature_c="outside_temperature_c", headwind_ms="0", acceleration_ms2="0"))


def baseline(t: Tables):
    return cut_lineage(learning.baseline_predictions(training_rows(t), models(t)))


REG.add("baseline_predictions", lambda t: rounded(baseline(t).select("trip_id", "window_start", "baseline"), 4),
        "select trip_id, window_start, round(baseline, 4) as baseline from baseline_raw")
_E = "(baseline - energy_consumption_kwh_100km)"
REG.add("regression_metrics", lambda t: rounded(learning.regression_metrics(baseline(t), learning.TARGET, "baseline", ["vehicle_code"]), 4), f"""
    select vehicle_code, count(*) as rows, round(avg(abs({_E})), 4) as mae, round(sqrt(avg({_E} * {_E})), 4) as rmse,
           round(1 - sum({_E} * {_E}) / nullif(var_pop(energy_consumption_kwh_100km) * count(*), 0), 4) as r2 from baseline_raw group by 1""")
REG.add("residual_histogram", lambda t: rounded(learning.residual_histogram(baseline(t), F.col("baseline") - F.col(learning.TARGET))), f"""
    with r as (select {_E} as r from baseline_raw), e as (select max(abs(r)) as e from r)
    select bin, round(2 * e / 25 * (bin + 0.5) - e, 6) + 0 as bucket, coalesce(n, 0) as count from (select unnest(range(25)) as bin), e left join (
        select greatest(0, least(24, floor((r + e) / (2 * e / 25))))::bigint as b, count(*) as n from r, e group by 1) on b = bin""")
REG.add("residual_quantiles", lambda t: rounded(learning.residual_quantiles(baseline(t), F.col("baseline") - F.col(learning.TARGET), ["vehicle_code"]), 4), f"""
    select vehicle_code, round(avg({_E}), 4) as mean, round(stddev_samp({_E}), 4) as std, round(quantile_cont({_E}, 0.05), 4) as p05, round(quantile_cont({_E}, 0.5), 4) as p50,
           round(quantile_cont({_E}, 0.95), 4) as p95 from baseline_raw group by 1""")
_CATALOGUE = [("compact_ev", 1700.0, 0.594, 15.5), ("sedan_ev", 2100.0, 0.529, 16.5), ("performance_ev", 2200.0, 0.5875, 20.0), ("suv_ev", 2400.0, 0.7685, 19.5), ("van_ev", 2500.0, 1.089, 23.0)]
REG.add("reconstruct_profile", lambda t: analysis.reconstruct_profile(
    t.events.select("event_id", (F.lit(1500.0) + F.col("event_id") % 1100).alias("mass_kg"), (F.lit(0.45) + (F.col("event_id") % 71) / 100.0).alias("drag_area"),
                    (F.lit(14.0) + (F.col("event_id") % 97) / 9.0).alias("nominal_consumption_kwh_100km")), _CATALOGUE).select("event_id", "nearest_code"), """
    select event_id, arg_min(code, (abs(mass_kg - (1500 + event_id % 1100)) / 500 + abs(area - (0.45 + (event_id % 71) / 100)) / 0.2 + abs(nom - (14 + (event_id % 97) / 9)) / 5, pos)) as nearest_code
    from events, (values """ + ", ".join(f"('{c}', {m}::double, {a}::double, {n}::double, {i})" for i, (c, m, a, n) in enumerate(_CATALOGUE)) + ") p(code, mass_kg, area, nom, pos) group by 1")


def _trained(t: Tables):
    rows = cut_lineage(learning.grouped_split(training_rows(t)))
    return rows, learning.train_energy_model(rows)


def training_report(t: Tables):
    """Errors of the trained model and of the physical baseline on the same test rows."""
    rows, model = _trained(t)
    test = reuse(learning.predict_batch(rows.where("fold = 'test'"), model, models(t)))
    return learning.regression_metrics(test, learning.TARGET, "predicted").withColumn("model", F.lit("boosted_trees")).unionByName(
        learning.regression_metrics(test, learning.TARGET, "baseline").withColumn("model", F.lit("physics")))


REG.add("train_energy_model", training_report)


def _importances(t: Tables):
    rows, model = _trained(t)
    gains = learning.gain_importance(model, t.spark)
    held = reuse(rows.where("fold = 'validation'").withColumn("row_key", F.concat_ws("|", "trip_id", F.col("window_index").cast("string"))))
    shuffled = learning.permutation_importance(held, model, "row_key").withColumnRenamed("importance", "permutation")
    return gains.join(shuffled, "feature", "left")


REG.add("feature_importance", _importances)


def _log(t: Tables):
    rows, model = _trained(t)
    return learning.prediction_log(learning.predict_batch(rows.where("fold = 'test'"), model, models(t)), "boosted_trees")


REG.add("prediction_log", _log)


def _stored_windows(t: Tables):
    path = f"{checkpoint_root(t.spark)}/strom-windows-{uuid.uuid4().hex}"
    windows(t).write.parquet(path)
    return learning.load_training_windows(t.spark, path)


REG.add("load_training_windows", lambda t: rounded(_stored_windows(t).groupBy("vehicle_code", "road_class").agg(
    F.count(F.lit(1)).alias("windows"), F.count_distinct("trip_id").alias("trips"), F.sum("distance_km").alias("km")), 4),
    "select vehicle_code, road_class, count(*) as windows, count(distinct trip_id) as trips, round(sum(distance_km), 4) as km from window_row group by 1, 2")


def _appended(t: Tables):
    """Two calls of one linear model, the first of them twice, read back from the log."""
    path = f"{checkpoint_root(t.spark)}/strom-predictions-{uuid.uuid4().hex}"
    scored = cut_lineage(learning.predict_batch(training_rows(t), linear_model(t), models(t)))
    for call, part in (("a", scored.where("soc_percent < 50")), ("a", scored.where("soc_percent < 50")), ("b", scored.where("soc_percent >= 50"))):
        learning.append_predictions(path, part, "linear", call, C.AT, ["vehicle_code", "road_class"])
    return learning.logged_predictions(t.spark, path).select(
        "call", "trip_id", "window_start", "model_name", "predicted_kwh_100km", "baseline_kwh_100km",
        F.get_json_object("features", "$.soc_percent").cast("double").alias("soc_percent"), F.get_json_object("context", "$.road_class").alias("road_class"))


REG.add("append_predictions", lambda t: rounded(_appended(t), 4), f"""
    select case when soc_percent < 50 then 'a' else 'b' end as call, trip_id, window_start, 'linear' as model_name, round({LINEAR}, 4) as predicted_kwh_100km,
           round(baseline, 4) as baseline_kwh_100km, round(soc_percent, 4) + 0 as soc_percent, road_class from (select b.*, w.mass_kg from (select * exclude (mass_kg) from baseline_raw) b join window_row w using (trip_id, window_index))""")
