"""Queries and oracles: routes, segments, traffic, weather, spatial functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.functions import geo
from strom.functions.geo import duck_utm32
from strom.operators.nearest import interval_join
from strom.operators.spatial import closest_spots, edge_matches, line_edges
from strom.operators.tiles import along_lines, one_row_each
from strom.plans.corridors import Pick, picked_sites, strongest_between
from strom.plans import routes as R
from strom.plans import staging, traffic
from strom.plans import weather as weather_plans
from strom.plans.trips import rounded
from strom.registry.analytics import tele, weather
from strom.registry.fleet_models import hvac, intensity, models
from strom.registry.oracle import Registry, relation
from strom.registry.stations import nearest_sql, stg_routes, stg_stations
from strom.sources.driver import TRAFFIC_NOW, Tables

REG = Registry()
AT = dt.datetime.fromisoformat(TRAFFIC_NOW).replace(tzinfo=dt.UTC)


def segments(t: Tables):
    return staging.route_segments(t.route_segments)


def routed_segments(t: Tables, routes):
    """Segments of the given routes; segments whose route is gone belong to none."""
    return segments(t).join(routes.select("route_id").distinct(), "route_id", "left_semi")


def traffic_facts(t: Tables):
    return traffic.fct_traffic_events(staging.traffic_events(t.traffic_events), AT)


_share = "case when {w} > 0 then round(100 * {p} / {w}, 1) end"
relation("dim_route_raw", f"""
    select r.* exclude (slug, name, route_key), r.slug as route_slug, r.name as route_name, l.line_km as geometry_length_km,
           coalesce(n, 0) as segment_count, coalesce(analysed, 0) as analysed_segment_count, coalesce(jam, 0) as segments_with_traffic_count,
           first_ as first_segment_ordinal, last_ as last_segment_ordinal, round(m / 1e3, 3) as segments_distance_km,
           {_share.format(w="m", p="motorway")} as motorway_distance_share_percent, {_share.format(w="m", p="main_")} as trunk_primary_distance_share_percent,
           {_share.format(w="m", p="minor")} as minor_road_distance_share_percent, round(lim::decimal(18,9), 1)::double as mean_speed_limit_kmh,
           round(spd::decimal(18,9), 1)::double as mean_assumed_speed_kmh, gain as elevation_gain_m,
           case when r.distance_m > 0 then round(100 * m / r.distance_m, 1) end as segmentation_coverage_percent,
           case when duration_s > 0 then round(r.distance_m / 1e3 / (duration_s / 3600), 1) end as free_flow_avg_speed_kmh
    from stg_route r left join route_length l using (route_id) left join (
        select route_id, count(*) as n, sum(segment_distance_m) as m, min(segment_ordinal) as first_, max(segment_ordinal) as last_,
               coalesce(sum(segment_distance_m) filter (road_class = 'motorway'), 0) as motorway,
               coalesce(sum(segment_distance_m) filter (road_class in ('trunk', 'primary')), 0) as main_,
               coalesce(sum(segment_distance_m) filter (road_class in ('secondary', 'tertiary', 'residential', 'service')), 0) as minor,
               avg(speed_limit_kmh) as lim, avg(assumed_speed_kmh) as spd, sum(elevation_gain_m) as gain, count(predicted_kwh) as analysed,
               count(traffic_severity) as jam from stg_segment group by 1) s using (route_id)""")
_XY = ("origin_latitude", "origin_longitude", "destination_latitude", "destination_longitude")
REG.add("dim_route", lambda t: rounded(R.dim_route(stg_routes(t), segments(t))),
        "select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _XY) + ") from dim_route_raw")

_FACTOR = "case traffic_severity when 'moderate' then 1.15 when 'high' then 1.4 when 'severe' then 2.0 else 1.0 end::double"


def _dec(expression: str, digits: int) -> str:
    return f"round(({expression})::decimal(18,9), {digits})::double"


REG.add("mart_route_energy", lambda t: rounded(R.mart_route_energy(segments(t), stg_routes(t), models(t))), f"""
    with a as (select s.*, r.slug as route_slug, r.name as route_name, r.origin_name, r.destination_name, r.is_demo as route_is_demo,
                      case when assumed_speed_kmh > 0 then segment_distance_km / assumed_speed_kmh end as h,
                      {hvac("temperature_c")} as hvac_load_kw, {_FACTOR} as traffic_delay_factor
               from stg_segment s join stg_route r using (route_id)),
    b as (select *, {_dec("hvac_load_kw * h", 4)} as hvac_energy_kwh, {_dec("(0.35 + hvac_load_kw) * h", 4)} as auxiliary_energy_kwh,
                 {_dec("(0.35 + hvac_load_kw) * h * (traffic_delay_factor - 1)", 4)} as traffic_extra_auxiliary_kwh,
                 {_dec("h * 60", 2)} as free_flow_minutes, {_dec("h * traffic_delay_factor * 60", 2)} as delayed_minutes,
                 {intensity("predicted_kwh_per_100km", "15.5")} as energy_intensity_vs_reference from a),
    c as (select *, case when predicted_kwh - hvac_energy_kwh > 0 then {_dec("100 * hvac_energy_kwh / (predicted_kwh - hvac_energy_kwh)", 2)} end as weather_penalty_percent,
                 case when predicted_kwh > 0 then {_dec("100 * traffic_extra_auxiliary_kwh / predicted_kwh", 2)} end as traffic_penalty_percent,
                 round(delayed_minutes - free_flow_minutes, 2) as traffic_delay_minutes from b),
    w as (select route_id, sum(predicted_kwh) as kwh, sum(segment_distance_km) as km, count(*) as route_segment_count,
                 count(predicted_kwh) as route_analysed_segment_count,
                 count(*) filter (energy_intensity_vs_reference = 'low') as route_low_intensity_segment_count,
                 count(*) filter (energy_intensity_vs_reference = 'medium') as route_medium_intensity_segment_count,
                 count(*) filter (energy_intensity_vs_reference = 'high') as route_high_intensity_segment_count,
                 count(*) filter (energy_intensity_vs_reference = 'critical') as route_critical_intensity_segment_count,
                 sum(hvac_energy_kwh) as hv, sum(traffic_extra_auxiliary_kwh) as ex, sum(traffic_delay_minutes) as delay,
                 max(predicted_kwh_per_100km) as top, sum(predicted_kwh_per_100km * segment_distance_km) as weighted from c group by 1)
    select route_segment_id, route_id, route_slug, route_name, origin_name, destination_name, route_is_demo, segment_ordinal, start_offset_km,
           round(start_offset_km + segment_distance_km, 3) as end_offset_km, segment_distance_km, road_class,
           case road_class when 'motorway' then 6 when 'trunk' then 5 when 'primary' then 4 when 'secondary' then 3 when 'tertiary' then 2
                when 'residential' then 1 else 0 end as road_class_ordinal, road_class = 'motorway' as is_motorway, speed_limit_kmh,
           assumed_speed_kmh, elevation_gain_m, round(100 * elevation_gain_m / segment_distance_m, 3) as gradient_percent,
           round(temperature_c, 6) as temperature_c, traffic_severity,
           case traffic_severity when 'low' then 1 when 'moderate' then 2 when 'high' then 3 when 'severe' then 4 end as traffic_severity_ordinal,
           traffic_delay_factor, round(predicted_kwh, 6) as predicted_kwh, round(predicted_kwh_per_100km, 6) as predicted_kwh_per_100km,
           energy_intensity, energy_intensity_vs_reference, {_dec("predicted_kwh_per_100km / 15.5", 4)} as consumption_ratio_to_reference,
           'compact_ev' as reference_vehicle_code, 15.5::double as reference_nominal_kwh_100km, 54::double as reference_usable_capacity_kwh,
           round(hvac_load_kw, 6) + 0 as hvac_load_kw, hvac_energy_kwh, auxiliary_energy_kwh, traffic_extra_auxiliary_kwh, free_flow_minutes, delayed_minutes,
           traffic_delay_minutes, weather_penalty_percent, traffic_penalty_percent, {_dec("kwh", 3)} as route_predicted_kwh,
           {_dec("km", 3)} as route_segments_distance_km, route_segment_count, route_analysed_segment_count,
           {_dec("weighted / km", 3)} as route_kwh_per_100km, round(top, 6) as route_max_segment_kwh_per_100km,
           route_low_intensity_segment_count, route_medium_intensity_segment_count, route_high_intensity_segment_count,
           route_critical_intensity_segment_count, round(100 * route_critical_intensity_segment_count / route_segment_count, 1) as route_critical_intensity_share_percent,
           {_dec("hv", 3)} as route_hvac_energy_kwh, {_dec("ex", 3)} as route_traffic_extra_auxiliary_kwh, {_dec("delay", 2)} as route_traffic_delay_minutes,
           case when kwh > 0 and kwh - hv > 0 then {_dec("100 * hv / (kwh - hv)", 2)} end as route_weather_penalty_percent,
           case when kwh > 0 then {_dec("100 * ex / kwh", 2)} end as route_traffic_penalty_percent,
           round(100 * kwh / 54, 1) as route_reference_battery_required_percent, data_origin
    from c join w using (route_id)""")

# ---- traffic
_T = f"timestamp '{TRAFFIC_NOW}'"
_ACTIVE = f"(coalesce(starts_at <= {_T}, true) and coalesce(ends_at >= {_T}, true))"
relation("traffic_fact", f"""
    select *, case severity when 'low' then 1 when 'moderate' then 2 when 'high' then 3 else 4 end as severity_ordinal,
           case severity when 'low' then 1.0 when 'moderate' then 1.15 when 'high' then 1.4 else 2.0 end::double as severity_delay_factor,
           extent_latitude is not null as has_extent_geometry, {_T} as evaluated_at,
           round((epoch_us(ends_at) - epoch_us(starts_at)) / 3.6e9, 2) as planned_duration_hours, {_ACTIVE} as is_active_now,
           coalesce(starts_at > {_T}, false) as is_upcoming, coalesce(ends_at < {_T}, false) as is_expired,
           starts_at is null as is_open_started, ends_at is null as is_open_ended, delay_minutes is not null as has_reported_delay
    from stg_traffic""")
_TR = "replace (round(latitude, 6) as latitude, round(longitude, 6) as longitude, round(delay_minutes, 6) as delay_minutes)"
REG.add("fct_traffic_events", lambda t: rounded(traffic_facts(t).drop("geometry")),
        f"select * exclude (extent_latitude, extent_longitude) {_TR} from traffic_fact")
REG.add("active_at", lambda t: traffic_facts(t).select("traffic_event_id", "is_active_now", "is_upcoming", "is_expired"),
        "select traffic_event_id, is_active_now, is_upcoming, is_expired from traffic_fact")
REG.add("traffic_filter", lambda t: traffic.traffic_filter(
    staging.traffic_events(t.traffic_events), box=(7.0, 48.0, 12.0, 53.0), severity="high", road="a5 ", active_at_time=AT).select(
        "traffic_event_id", "road_name", "starts_at"), f"""
    select traffic_event_id, road_name, starts_at from stg_traffic where longitude between 7 and 12 and latitude between 48 and 53
    and severity = 'high' and road_name = 'A5' and {_ACTIVE}""")

relation("segment_edge", "select *, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) as m, 0::double as start_m, "
         "sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) as line_m, 1 as edge_no from "
         + duck_utm32(duck_utm32("(select id as route_segment_id, route_id, is_demo, ordinal, start_offset_m, distance_m, lat0, lon0, lat1, lon1 from route_segments)", "lat0", "lon0", "x0", "y0"), "lat1", "lon1", "x1", "y1"))
relation("event_xy", "select * from " + duck_utm32("traffic_fact", "latitude", "longitude", "px", "py"))
_NEAR_BOX = "p.px between least(e.x0, e.x1) - {b} and greatest(e.x0, e.x1) + {b} and p.py between least(e.y0, e.y1) - {b} and greatest(e.y0, e.y1) + {b}"
relation("event_segment", nearest_sql("event_xy", "traffic_event_id", "segment_edge", "route_segment_id", 2000, _NEAR_BOX.format(b=2000)))
REG.add("events_on_segments", lambda t: rounded(traffic.events_on_segments(traffic_facts(t), segments(t), 2000.0).select(
    "traffic_event_id", "route_segment_id", "distance_m"), 3),
    "select traffic_event_id, route_segment_id, round(distance_m, 3) as distance_m from event_segment")
REG.add("traffic_impact", lambda t: rounded(traffic.traffic_impact(traffic_facts(t), segments(t))), f"""
    with hit as (select traffic_event_id, road_name, event_type, severity, s.route_id, route_segment_id, segment_distance_km
                 from event_segment join traffic_fact using (traffic_event_id) join stg_segment s using (route_segment_id)),
    stretch as (select road_name, event_type, severity, count(distinct route_id) as routes_, count(*) as segs, sum(segment_distance_km) as km
                from (select distinct road_name, event_type, severity, route_id, route_segment_id, segment_distance_km from hit) group by 1, 2, 3),
    hits as (select road_name, event_type, severity, count(distinct traffic_event_id) as n_hit from hit group by 1, 2, 3),
    roll as (select road_name, event_type, severity, count(*) as event_count, count(*) filter (is_active_now) as active_event_count,
                    count(*) filter (is_upcoming) as upcoming_event_count, count(*) filter (is_expired) as expired_event_count,
                    count(*) filter (is_blocked) as blocked_event_count, count(*) filter (is_open_ended) as open_ended_event_count,
                    count(*) filter (has_extent_geometry) as events_with_extent_count, count(distinct direction) as direction_count,
                    count(*) filter (has_reported_delay) as events_with_reported_delay_count, sum(delay_minutes) as total_, avg(delay_minutes) as mean_,
                    max(delay_minutes) as top_, min(starts_at) as earliest_starts_at, max(ends_at) as latest_ends_at, avg(planned_duration_hours) as hours_,
                    max(evaluated_at) as evaluated_at, string_agg(distinct source_system, ', ' order by source_system) as source_systems,
                    string_agg(distinct data_origin, ', ' order by data_origin) as data_origins, max(ingested_at) as latest_ingested_at,
                    any_value(severity_ordinal) as severity_ordinal, any_value(severity_delay_factor) as severity_delay_factor
             from traffic_fact group by 1, 2, 3)
    select r.road_name, r.event_type, r.severity, event_count, active_event_count, upcoming_event_count, expired_event_count, blocked_event_count,
           open_ended_event_count, events_with_extent_count, direction_count, events_with_reported_delay_count, earliest_starts_at, latest_ends_at,
           evaluated_at, source_systems, data_origins, latest_ingested_at, severity_ordinal, severity_delay_factor,
           r.road_name is not null as is_road_known, active_event_count > 0 as has_active_event, {_dec("total_", 1)} as total_reported_delay_minutes,
           {_dec("mean_", 1)} as mean_reported_delay_minutes, round(top_, 6) as max_reported_delay_minutes, {_dec("hours_", 2)} as mean_planned_duration_hours,
           round(100 * events_with_reported_delay_count / event_count, 1) as delay_reporting_coverage_percent, 2::double as match_buffer_km,
           coalesce(routes_, 0) as affected_route_count, coalesce(segs, 0) as affected_segment_count, coalesce(n_hit, 0) as corridor_matched_event_count,
           coalesce({_dec("km", 3)}, 0) as affected_segment_distance_km, round(100 * coalesce(n_hit, 0) / event_count, 1) as corridor_match_share_percent
    from roll r left join stretch s on s.road_name is not distinct from r.road_name and s.event_type = r.event_type and s.severity = r.severity
    left join hits h on h.road_name is not distinct from r.road_name and h.event_type = r.event_type and h.severity = r.severity""")
relation("event_line", "select * from " + duck_utm32(duck_utm32(
    f"(select traffic_event_id, latitude, longitude, coalesce(extent_latitude, latitude) as la2, coalesce(extent_longitude, longitude) as lo2 from stg_traffic where {_ACTIVE})",
    "latitude", "longitude", "ax0", "ay0"), "la2", "lo2", "ax1", "ay1"))


def _end(px, py, x0, y0, x1, y1) -> str:
    t = f"(case when {x0} = {x1} and {y0} = {y1} then 0 else greatest(0, least(1, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (power({x1} - {x0}, 2) + power({y1} - {y0}, 2)))) end)"
    return f"sqrt(power({px} - {x0} - {t} * ({x1} - {x0}), 2) + power({py} - {y0} - {t} * ({y1} - {y0}), 2))"


def _side(p, q, i) -> str:
    return f"(({p}x1 - {p}x0) * ({q}y{i} - {p}y0) - ({p}y1 - {p}y0) * ({q}x{i} - {p}x0))"


_A, _S = ("ax0", "ay0", "ax1", "ay1"), ("x0", "y0", "x1", "y1")
EVENT_LINE_SEGMENT = f"""
    select traffic_event_id, route_segment_id from event_line, segment_edge
    where least(ax0, ax1) <= greatest(x0, x1) + 1500 and least(x0, x1) <= greatest(ax0, ax1) + 1500
    and least(ay0, ay1) <= greatest(y0, y1) + 1500 and least(y0, y1) <= greatest(ay0, ay1) + 1500
    and (least({_end("ax0", "ay0", *_S)}, {_end("ax1", "ay1", *_S)}, {_end("x0", "y0", *_A)}, {_end("x1", "y1", *_A)}) <= 1500
         or ({_side("a", "", 0)} * {_side("a", "", 1)} < 0 and {_side("", "a", 0)} * {_side("", "a", 1)} < 0))"""
REG.add("event_lines_on_segments", lambda t: traffic.event_lines_on_segments(
    staging.traffic_events(t.traffic_events), segments(t), AT, 1500.0), EVENT_LINE_SEGMENT)


def along(t: Tables, worst_per_bin: bool = False):
    placed = traffic.worst_along_route if worst_per_bin else traffic.events_along_route
    return placed(stg_routes(t), staging.traffic_events(t.traffic_events), AT, 3000.0)


relation("along_raw", nearest_sql(f"(select * from event_xy where {_ACTIVE})", "traffic_event_id", "route_edges", "route_id", 3000))
REG.add("events_along_route", lambda t: rounded(along(t), 3), """
    select a.route_id, a.traffic_event_id, severity, is_blocked, road_name, round(distance_m, 3) as distance_m, round(offset_m, 3) as offset_m,
           round(line_m, 3) as line_m from along_raw a join stg_traffic using (traffic_event_id)""")
REG.add("paint_events", lambda t: traffic.paint_events(
    along(t, worst_per_bin=True), line_edges(stg_routes(t), ["route_id"]).select("route_id", "line_m").distinct()), """
    with hit as (select route_id, floor(offset_m / 500)::bigint as c, case when is_blocked then 'severe' else severity end as sev
                 from along_raw join stg_traffic using (traffic_event_id)),
    bins as (select route_id, unnest(range(ceil(line_m / 500)::bigint)) as bin from route_length)
    select b.route_id, b.bin, arg_max(sev, case sev when 'low' then 1 when 'moderate' then 2 when 'high' then 3 else 4 end) as severity
    from bins b left join hit h on h.route_id = b.route_id and b.bin between c - 4 and c + 4 group by 1, 2""")

# ---- station and telemetry positions on segments
relation("sample_xy", "select * from " + duck_utm32("(select telemetry_id, latitude, longitude from telemetry)", "latitude", "longitude", "px", "py"))
relation("sample_segment", nearest_sql("sample_xy", "telemetry_id", "segment_edge", "route_segment_id", 2000, _NEAR_BOX.format(b=2000)))


def points_to_segments(t: Tables):
    edges = line_edges(segments(t), ["route_segment_id"])
    near = edge_matches(tele(t).select("telemetry_id", "latitude", "longitude"), edges, 2000.0, nearest_by=["route_segment_id"])
    best = F.min(F.struct(F.round("distance_m", 6).alias("d"), "route_segment_id")).alias("b")
    return near.groupBy("telemetry_id").agg(best).select(
        "telemetry_id", F.col("b.route_segment_id").alias("route_segment_id"), F.round("b.d", 3).alias("distance_m"))


REG.add("points_to_segments", points_to_segments, """
    select telemetry_id, arg_min(route_segment_id, (round(distance_m, 6), route_segment_id)) as route_segment_id, round(min(round(distance_m, 6)), 3) as distance_m
    from sample_segment group by 1""")
relation("site_segment", nearest_sql("station_xy", "station_id", "segment_edge", "route_segment_id", 5000, _NEAR_BOX.format(b=5000)))


def corridor_candidates(t: Tables, min_kw: float = 50.0, buffer_m: float = 5000.0, pick: Pick | None = None, routes: DataFrame | None = None):
    """Each strong enough site anchored to the nearest segment of each corridor, or of each of ``routes``, it lies on.

    With ``pick`` sites may be left out that it does not choose among those of a corridor in one tile.
    """
    on_routes = routed_segments(t, stg_routes(t) if routes is None else routes)
    strong = stg_stations(t).where(F.col("max_power_kw") >= min_kw)
    # no broadcast chosen by the size of the files: that knows nothing of the rows that come out of exploded arrays
    placed = line_edges(on_routes, ["route_segment_id"]).join(
        on_routes.select("route_segment_id", "route_id", "start_offset_m", "segment_distance_m").hint("merge"), "route_segment_id")
    columns = ["route_id", "station_id", "max_power_kw", "route_segment_id", "offset_m", "lateral_m"]
    if pick is not None and (single := one_row_each(strong, ["station_id", "max_power_kw"])) is not None:
        found = along_lines(
            single, placed, "route_id", buffer_m, picked_sites(pick), "station_id string, max_power_kw double, route_segment_id string, offset_m double, lateral_m double",
            rank=["route_segment_id", "edge_no", "start_offset_m", "segment_distance_m"], digits=6)
        return found.select(*columns)

    def rank(distance, offset, edge):
        return F.struct(F.round(distance, 6).alias("lateral_m"), edge("route_segment_id").alias("route_segment_id"), distance.alias("exact_m"), edge("edge_no").alias("edge_no"),
                        (edge("start_offset_m") + offset / edge("line_m") * edge("segment_distance_m")).alias("offset_m"))

    # all segments of a corridor count as one line, so that no pair of site and segment is shuffled
    near = closest_spots(strong, placed, ["station_id"], ["route_id"], buffer_m, rank, keep=["max_power_kw"])
    return near.select("route_id", "station_id", "max_power_kw", *(F.col(f"_best.{c}").alias(c) for c in ("route_segment_id", "offset_m", "lateral_m")))


relation("candidate_raw", """
    select route_id, station_id, max_power_kw, route_segment_id, start_offset_m + offset_m / line_m * distance_m as offset_m, side_m as lateral_m
    from (select n.station_id, n.route_segment_id, n.offset_m, n.line_m, round(n.distance_m, 6) as side_m, e.route_id, e.start_offset_m, e.distance_m, s.max_power_kw
          from site_segment n join segment_edge e using (route_segment_id) join stg_station s using (station_id)
          where s.max_power_kw >= 50 and e.route_id in (select route_id from route_base)
          qualify row_number() over (partition by e.route_id, n.station_id order by round(n.distance_m, 6), n.route_segment_id) = 1)""")
REG.add("corridor_candidates", lambda t: rounded(corridor_candidates(t), 3), """
    select route_id, station_id, route_segment_id, round(max_power_kw, 3) as max_power_kw, round(offset_m, 3) as offset_m, round(lateral_m, 3) as lateral_m from candidate_raw""")


def strongest_in_range(t: Tables):
    """Strongest site between kilometre 50 and 150 of each corridor, the first one winning a tie."""
    inside = corridor_candidates(t, pick=strongest_between(50_000.0, 150_000.0)).where(F.col("offset_m").between(50_000.0, 150_000.0))
    return inside.groupBy("route_id").agg(F.max_by("station_id", F.struct("max_power_kw", -F.col("offset_m"))).alias("station_id"))


REG.add("strongest_in_range", strongest_in_range, """
    select route_id, station_id from candidate_raw where offset_m between 50000 and 150000
    qualify row_number() over (partition by route_id order by max_power_kw desc, offset_m) = 1""")

# ---- weather
relation("freshest", f"""select * from stg_weather where observed_at <= {_T}
    qualify row_number() over (partition by weather_station_id order by observed_at desc, weather_observation_id desc) = 1""")
relation("freshest_xy", "select * from " + duck_utm32("freshest", "latitude", "longitude", "sx", "sy"))


def _midpoints(t: Tables):
    return t.route_segments.select(F.col("id").alias("route_segment_id"), ((F.col("lat0") + F.col("lat1")) / 2).alias("latitude"),
                                   ((F.col("lon0") + F.col("lon1")) / 2).alias("longitude"))


relation("middle_xy", "select * from " + duck_utm32(
    "(select id as route_segment_id, (lat0 + lat1) / 2 as latitude, (lon0 + lon1) / 2 as longitude from route_segments)", "latitude", "longitude", "px", "py"))


def _nearest_reading_sql(points: str, key: str, radius: float) -> str:
    return f"""
    select {key}, weather_station_id, round(d, 3) as distance_m, weather_observation_id, observed_at, round(temperature_c, 6) as temperature_c
    from {points} left join (
        select p.{key}, s.weather_station_id, d, weather_observation_id, observed_at, temperature_c
        from (select p.{key}, s.weather_station_id, sqrt(power(px - sx, 2) + power(py - sy, 2)) as d from {points} p, freshest_xy s) p
        join freshest s using (weather_station_id) where d <= {radius}
        qualify row_number() over (partition by {key} order by d, weather_station_id) = 1) n using ({key})"""


_READING = ("weather_station_id", "distance_m", "weather_observation_id", "observed_at", "temperature_c")


def _reading(df, key):
    return df.select(key, "weather_station_id", F.round("distance_m", 3).alias("distance_m"), "weather_observation_id", "observed_at",
                     F.round("temperature_c", 6).alias("temperature_c"))


REG.add("nearest_observation", lambda t: _reading(weather_plans.nearest_observation(
    _midpoints(t), ["route_segment_id"], weather(t), AT, 150_000.0), "route_segment_id"), _nearest_reading_sql("middle_xy", "route_segment_id", 150000))
REG.add("latest_observation_at", lambda t: _reading(weather_plans.nearest_observation(
    stg_stations(t).select("station_id", "latitude", "longitude"), ["station_id"], weather(t), AT, 40_000.0), "station_id"),
    _nearest_reading_sql("station_xy", "station_id", 40000))
REG.add("nearest_stations", lambda t: rounded(weather_plans.nearest_stations(
    stg_stations(t).select(F.col("station_id").alias("site_id"), "latitude", "longitude"), ["site_id"],
    t.weather_stations.withColumnRenamed("id", "station_id"), 20), 3), """
    select station_id, round(min(d), 3) as distance_m, count(*) as points_served
    from (select p.station_id as site, w.id as station_id, sqrt(power(px - sx, 2) + power(py - sy, 2)) as d
          from station_xy p, """ + duck_utm32("weather_stations", "latitude", "longitude", "sx", "sy") + """ w
          qualify row_number() over (partition by p.station_id order by d, w.id) = 1) where d <= 600000 group by 1 order by min(d), 1 limit 20""")
REG.add("asof_pick", lambda t: rounded(weather_plans.asof_pick(
    weather(t).select("weather_station_id", "observed_at", "weather_observation_id", "temperature_c"),
    "weather_station_id", "observed_at", AT, "weather_observation_id")), f"""
    select weather_station_id, observed_at, weather_observation_id, round(temperature_c, 6) as temperature_c from stg_weather
    qualify row_number() over (partition by weather_station_id order by (observed_at <= {_T}) desc,
        case when observed_at <= {_T} then -epoch_us(observed_at) else epoch_us(observed_at) end,
        case when observed_at <= {_T} then weather_observation_id end desc, weather_observation_id) = 1""")


def _products(t: Tables):
    w = weather(t)
    key = ["weather_station_id", "observed_at"]
    return weather_plans.align_products(
        w.groupBy(*key).agg(F.max("temperature_c").alias("temperature_c"), F.max("humidity_percent").alias("humidity_percent")),
        w.where("wind_speed_ms > 5").groupBy(*key).agg(F.max("wind_speed_ms").alias("wind_speed_ms")),
        w.where("precipitation_mm > 0").groupBy(*key).agg(F.max("precipitation_mm").alias("precipitation_mm")))


REG.add("align_products", lambda t: rounded(_products(t)), """
    select weather_station_id, observed_at, round(max(temperature_c), 6) as temperature_c, round(max(humidity_percent), 6) as humidity_percent,
           round(max(wind_speed_ms) filter (wind_speed_ms > 5), 6) as wind_speed_ms, round(max(precipitation_mm) filter (precipitation_mm > 0), 6) as precipitation_mm
    from stg_weather group by 1, 2""")
SINCE = AT - dt.timedelta(days=400)
relation("weather_site_near", nearest_sql(
    duck_utm32("(select id as weather_station_id, latitude, longitude from weather_stations)", "latitude", "longitude", "px", "py"),
    "weather_station_id", "route_edges", "route_id", 25000))
REG.add("route_weather", lambda t: rounded(weather_plans.route_weather(stg_routes(t), weather(t), SINCE, 25_000.0)), f"""
    select route_id, round(avg(temperature_c), 6) as temperature_c, round(avg(precipitation_mm), 6) as precipitation_mm,
           round(avg(wind_speed_ms), 6) as wind_speed_ms, max(observed_at) as observed_at, count(distinct weather_station_id) as station_count
    from weather_site_near join stg_weather using (weather_station_id)
    where observed_at >= {_T} - interval 400 day and temperature_c is not null group by 1""")
REG.add("weather_context", lambda t: rounded(weather_plans.weather_context(weather(t), "weather_station_id"), 4), """
    select weather_station_id, round(avg(temperature_c), 4) as mean_temperature_c, round(min(temperature_c), 4) as min_temperature_c,
           round(coalesce(sum(precipitation_mm), 0), 4) as precipitation_mm, round(coalesce(avg(wind_speed_ms), 0), 4) as mean_wind_speed_ms,
           coalesce(arg_max(weather_condition, case weather_condition when 'rain' then 3 when 'clouds' then 2 else 1 end), 'unknown') as condition
    from stg_weather group by 1""")
REG.add("traffic_context", lambda t: weather_plans.traffic_context(staging.traffic_events(t.traffic_events), "road_name"), """
    select road_name, count(*) as event_count, arg_max(severity, severity_ordinal) as worst_severity, count(*) filter (is_blocked) as blocked_count
    from traffic_fact group by 1""")

# ---- geometry
relation("geo_edges", """
    select *, sum(m) over (partition by route_id) as line_m, sum(m) over (partition by route_id order by edge_no) - m as start_m
    from (select route_id, edge_no, lat0, lon0, lat1, lon1, 2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(lat1 - lat0) / 2), 2)
                 + cos(radians(lat0)) * cos(radians(lat1)) * power(sin(radians(lon1 - lon0) / 2), 2)))) as m from route_edges)""")
REG.add("polyline_length", lambda t: rounded(R.geodesic_edges(stg_routes(t)).select("route_id", "edge_no", "edge_m", "edge_start_m", "line_m"), 3),
        "select route_id, edge_no::int as edge_no, round(m, 3) as edge_m, round(start_m, 3) as edge_start_m, round(line_m, 3) as line_m from geo_edges")
REG.add("line_length_utm", lambda t: rounded(R.route_lengths(stg_routes(t)), 3),
        "select route_id, round(line_m, 3) as geometry_length_m from route_length")
_BEARING = "((degrees(atan2(sin(radians(lon1 - lon0)) * cos(radians(lat1)), cos(radians(lat0)) * sin(radians(lat1)) - sin(radians(lat0)) * cos(radians(lat1)) * cos(radians(lon1 - lon0)))) + 360) % 360)"
REG.add("bearing", lambda t: t.route_segments.select("id", F.round(geo.bearing_deg(*(F.col(c) for c in ("lat0", "lon0", "lat1", "lon1"))), 6).alias("bearing_deg")),
        f"select id, round({_BEARING}, 6) as bearing_deg from route_segments")
REG.add("haversine", lambda t: t.charging_stations.select("id", F.round(geo.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(50.11), F.lit(8.68)), 3).alias("distance_m")), """
    select id, round(2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(50.11 - latitude) / 2), 2)
        + cos(radians(50.11)) * cos(radians(latitude)) * power(sin(radians(8.68 - longitude) / 2), 2)))), 3) as distance_m from charging_stations""")
REG.add("utm32", lambda t: geo.with_utm32(t.charging_stations, "latitude", "longitude", "x", "y").select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")),
        "select id, round(x, 3) as x, round(y, 3) as y from " + duck_utm32("charging_stations", "latitude", "longitude", "x", "y"))
_MET = 3.141592653589793 / 180 * 6371008.8
_SX0, _SY0 = f"((lon0 - longitude) * cos(radians(latitude)) * {_MET})", f"((lat0 - latitude) * {_MET})"
_SX1, _SY1 = f"((lon1 - longitude) * cos(radians(latitude)) * {_MET})", f"((lat1 - latitude) * {_MET})"
REG.add("point_to_edge", lambda t: t.route_segments.select(
    "id", F.round(geo.point_to_edge_m((F.col("lat0") + F.col("lat1")) / 2 + 0.01, F.col("lon0"), *(F.col(c) for c in ("lat0", "lon0", "lat1", "lon1"))), 3).alias("distance_m")),
    f"select id, round({_end('0', '0', _SX0, _SY0, _SX1, _SY1)}, 3) as distance_m from (select *, (lat0 + lat1) / 2 + 0.01 as latitude, lon0 as longitude from route_segments)")


def _offsets(t: Tables):
    return t.trips.select("trip_id", "route_id", (F.col("distance_m") * 20).alias("offset_m"))


REG.add("point_at_offset", lambda t: rounded(R.point_at_offset(stg_routes(t), _offsets(t)), 5), """
    select trip_id, route_id, round(o, 5) as offset_m, round(lat0 + (lat1 - lat0) * f, 5) as latitude, round(lon0 + (lon1 - lon0) * f, 5) as longitude
    from (select *, greatest(0, least(1, (greatest(0, least(o, line_m)) - start_m) / m)) as f
          from (select trip_id, route_id, distance_m * 20 as o from trips) join geo_edges using (route_id)
          where greatest(0, least(o, line_m)) >= start_m and (greatest(0, least(o, line_m)) < start_m + m or start_m + m >= line_m - 1e-6))""")
REG.add("densify", lambda t: rounded(R.densify(stg_routes(t), 4000.0)), """
    select route_id, edge_no::int as edge_no, step::int as step, round(lat0 + (lat1 - lat0) * step / k, 6) as latitude, round(lon0 + (lon1 - lon0) * step / k, 6) as longitude
    from (select *, greatest(1, ceil(m / 4000)) as k, unnest(range(greatest(1, ceil(m / 4000))::bigint + case when start_m + m >= line_m - 1e-6 then 1 else 0 end)) as step from geo_edges)""")
REG.add("sample_vertices", lambda t: R.sample_vertices(stg_routes(t), 4), """
    select route_id, round(latitude, 3) as latitude, round(longitude, 3) as longitude, min(ordinal)::int as position
    from route_vertices where ordinal % 3 = 0 or ordinal = 11 group by 1, 2, 3""")
REG.add("extent_expand", lambda t: rounded(R.extent(stg_routes(t), 0.5)), """
    select route_id, round(min(longitude) - 0.5, 6) as west, round(min(latitude) - 0.5, 6) as south, round(max(longitude) + 0.5, 6) as east,
           round(max(latitude) + 0.5, 6) as north from route_vertices group by 1""")


def _substrings(t: Tables):
    pieces = stg_routes(t).select("route_id", F.explode(F.array(*(F.struct(F.lit(i).alias("piece"), F.lit(a).alias("start_m"), F.lit(b).alias("end_m")) for i, (a, b) in enumerate(_PIECES)))).alias("p")).select("route_id", "p.*")
    text = F.array_join(F.transform("vertices", lambda v: F.format_string("%.4f %.4f", v.longitude, v.latitude)), ",")
    return R.line_substring(stg_routes(t), pieces).select("route_id", "piece", F.size("vertices").alias("vertex_count"), text.alias("line"))


_PIECES = ((1_234.5, 55_555.5), (60_000.25, 61_000.75), (100_001.5, 212_345.6))
REG.add("line_substring", _substrings, f"""
    with piece as (select * from (values {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_PIECES))}) p(piece, s, e)),
    cut as (select *, greatest(s, start_m) as b, least(e, start_m + m) as f from piece, route_edges where s < start_m + m and e > start_m),
    spot as (select route_id, piece, b as at_, lat0 + (lat1 - lat0) * (b - start_m) / m as lat, lon0 + (lon1 - lon0) * (b - start_m) / m as lon from cut
             union all select route_id, piece, f, lat0 + (lat1 - lat0) * (f - start_m) / m, lon0 + (lon1 - lon0) * (f - start_m) / m from cut where e <= start_m + m + 1e-6)
    select route_id, piece, count(*)::int as vertex_count, string_agg(printf('%.4f %.4f', lon, lat), ',' order by at_) as line from spot group by 1, 2""")


def _cuts(t: Tables):
    g = F.col("geometry")
    return R.segment_polyline(stg_routes(t)).select(
        "route_id", "ordinal", F.round("start_offset_m", 3).alias("start_offset_m"), F.round("distance_m", 3).alias("distance_m"),
        F.size(g).alias("vertex_count"), F.round(F.element_at(g, 1).latitude, 5).alias("start_latitude"), F.round(F.element_at(g, -1).longitude, 5).alias("end_longitude"),
        F.round("midpoint_latitude", 5).alias("midpoint_latitude"), F.round("midpoint_longitude", 5).alias("midpoint_longitude"))


relation("cut_raw", """
    select route_id, line_m, n, line_m / n as step, unnest(range(n::bigint)) as ordinal
    from (select route_id, any_value(line_m) as line_m, greatest(1, least(round_even(any_value(line_m) / 5000, 0), floor(any_value(line_m) / 1500))) as n from geo_edges group by 1)""")


def _locate(offset: str, tag: str) -> str:
    return f"""(select c.route_id, c.ordinal, arg_max(lat0 + (lat1 - lat0) * least(1, ({offset} - start_m) / m), start_m) as lat_{tag},
        arg_max(lon0 + (lon1 - lon0) * least(1, ({offset} - start_m) / m), start_m) as lon_{tag}
        from cut_raw c join geo_edges e using (route_id) where start_m <= {offset} + 1e-7 group by 1, 2)"""


REG.add("segment_polyline", _cuts, f"""
    select c.route_id, c.ordinal, round(c.ordinal * step, 3) as start_offset_m, round(step, 3) as distance_m,
           (2 + coalesce(inner_, 0))::int as vertex_count, round(lat_a, 5) as start_latitude, round(lon_b, 5) as end_longitude,
           round(lat_m, 5) as midpoint_latitude, round(lon_m, 5) as midpoint_longitude
    from cut_raw c join {_locate("ordinal * step", "a")} using (route_id, ordinal) join {_locate("(ordinal + 1) * step", "b")} using (route_id, ordinal)
    join {_locate("(ordinal + 0.5) * step", "m")} using (route_id, ordinal)
    left join (select c.route_id, c.ordinal, count(*) as inner_ from cut_raw c join geo_edges e using (route_id)
               where start_m > c.ordinal * step + 1e-6 and start_m < (c.ordinal + 1) * step - 1e-6 group by 1, 2) using (route_id, ordinal)""")


def steps(t: Tables):
    return t.route_steps.withColumn("road_class", R.road_class_from_ref(F.col("ref")))


_REF = "case when ref like '%A %' then 'motorway' when ref like '%B %' then 'primary' when ref like '%L %' or ref like '%S %' then 'secondary' when ref like '%K %' then 'tertiary' else 'unknown' end"
REG.add("road_class_from_ref", lambda t: steps(t).select("route_id", "step_no", "road_class"), f"select route_id, step_no, {_REF} as road_class from route_steps")


def attribute_segments(t: Tables):
    cuts = t.route_segments.select("route_id", "ordinal", "start_offset_m", F.lit(6000.0).alias("distance_m"))
    return R.segment_attributes(steps(t), cuts, F.lit(100.0))


relation("step_overlap", f"""
    select g.id, g.route_id, g.ordinal, s.step_no, {_REF} as road_class, s.speed_limit_kmh, s.duration_s, s.distance_m,
           least(s.step_end_m, g.start_offset_m + 6000) - greatest(s.step_start_m, g.start_offset_m) as overlap
    from route_segments g join route_steps s on s.route_id = g.route_id
    where least(s.step_end_m, g.start_offset_m + 6000) > greatest(s.step_start_m, g.start_offset_m)""")
REG.add("interval_overlap_join", lambda t: rounded(interval_join(
    steps(t).drop("distance_m", "duration_s", "ref", "road_class", "speed_limit_kmh"),
    t.route_segments.select("route_id", "ordinal", F.col("start_offset_m").alias("s"), (F.col("start_offset_m") + 6000).alias("e")),
    "route_id", ("step_start_m", "step_end_m"), ("s", "e"), 20_000.0).select("route_id", "ordinal", "step_no", "overlap")),
    "select route_id, ordinal, step_no, overlap from step_overlap")
REG.add("dominant_class", lambda t: rounded(attribute_segments(t)), """
    with per as (select route_id, ordinal, road_class, round(sum(overlap), 6) as m, min(step_no) as first_, arg_min(struct_pack(v := speed_limit_kmh), step_no) as lim from step_overlap group by 1, 2, 3),
    best as (select * from per qualify row_number() over (partition by route_id, ordinal order by m desc, first_) = 1),
    spd as (select route_id, ordinal, sum(overlap * distance_m / duration_s * 3.6) filter (duration_s > 0) / sum(overlap) filter (duration_s > 0) as v from step_overlap group by 1, 2)
    select g.route_id, g.ordinal, g.start_offset_m, 6000::double as distance_m, coalesce(b.road_class, 'unknown') as road_class, b.lim.v as speed_limit_kmh,
           round(coalesce(s.v, 100), 6) as assumed_speed_kmh
    from route_segments g left join best b on b.route_id = g.route_id and b.ordinal = g.ordinal left join spd s on s.route_id = g.route_id and s.ordinal = g.ordinal""")
REG.add("route_list", lambda t: stg_routes(t).select("route_id", "name", "is_demo").orderBy(F.col("is_demo").desc(), "name", "route_id"),
        "select route_id, name, is_demo from stg_route")


def _route_detail(t: Tables):
    nested = segments(t).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("segment_ordinal", "road_class"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x.segment_ordinal.cast("string"), x.road_class)), ",")
    return stg_routes(t).select("route_id", "name").join(nested, "route_id", "left").select("route_id", "name", F.coalesce(text, F.lit("")).alias("segments"))


REG.add("route_detail", _route_detail, """
    select r.route_id, r.name, coalesce(s, '') as segments from stg_route r left join (
        select route_id, string_agg(segment_ordinal || ':' || road_class, ',' order by segment_ordinal) as s from stg_segment group by 1) using (route_id)""")
