"""Queries and oracles: charging sites, infrastructure per state, corridors."""

from __future__ import annotations

import datetime as dt

from strom.functions.geo import duck_utm32
from strom.operators.spatial import distance_join
from strom.plans import corridors, staging, stations
from strom.plans.trips import rounded
from strom.registry.fleet_models import round_all
from strom.registry.oracle import Registry, relation
from strom.sources.driver import REGISTER_NOW, Tables

REG = Registry()
AS_OF = dt.datetime.fromisoformat(REGISTER_NOW)


def stg_stations(t: Tables):
    return staging.charging_stations(t.charging_stations)


def stg_points(t: Tables):
    return staging.charging_points(t.charging_points)


def power(t: Tables):
    return stations.station_power(stg_stations(t), stg_points(t))


def dim_station(t: Tables):
    return stations.dim_charging_station(stg_stations(t), stg_points(t), t.states)


relation("station_power_raw", """
    select *, coalesce(effective_max_power_kw >= 50, false) as is_fast_charger,
           coalesce(effective_max_power_kw >= 150, false) as is_ultra_fast_charger,
           case when effective_max_power_kw >= 150 then 'ultra_fast' when effective_max_power_kw >= 22 then 'fast' else 'normal' end
               as effective_charging_category
    from (select s.station_id, s.external_id, s.bundesland, s.charging_category as declared_charging_category,
                 s.max_power_kw as declared_max_power_kw, s.total_power_kw as declared_total_power_kw,
                 s.charging_points_count as declared_connector_count,
                 coalesce(n, 0) as connector_count, coalesce(rated, 0) as rated_connector_count,
                 coalesce(dc, 0) as dc_connector_count, coalesce(ac, 0) as ac_connector_count,
                 coalesce(fast, 0) as fast_connector_count, coalesce(ultra, 0) as ultra_fast_connector_count,
                 coalesce(slow, 0) as normal_connector_count, top as connector_max_power_kw,
                 total as connector_sum_power_kw, mean as connector_avg_power_kw, coalesce(ccs, false) as has_ccs,
                 coalesce(type2, false) as has_type2, coalesce(chademo, false) as has_chademo, kinds as connector_types,
                 greatest(s.max_power_kw, top) as effective_max_power_kw, coalesce(s.total_power_kw, total) as effective_total_power_kw,
                 case when s.max_power_kw is null and top is null then 'none' when top is null then 'site'
                      when s.max_power_kw is null then 'connectors' else 'both' end as power_basis,
                 abs(s.max_power_kw - top) as power_disagreement_kw,
                 coalesce(n, 0) - s.charging_points_count as connector_count_delta
          from stg_station s left join (
              select station_id, count(*) as n, count(power_kw) as rated, count(*) filter (current_type = 'dc') as dc,
                     count(*) filter (current_type = 'ac') as ac, count(*) filter (power_kw >= 50) as fast,
                     count(*) filter (power_kw >= 150) as ultra, count(*) filter (power_kw < 22) as slow, max(power_kw) as top,
                     sum(power_kw) as total, avg(power_kw) as mean, bool_or(connector_type = 'ccs') as ccs,
                     bool_or(connector_type = 'type2') as type2, bool_or(connector_type = 'chademo') as chademo,
                     string_agg(distinct connector_type, ', ' order by connector_type) as kinds
              from stg_point group by 1) p using (station_id))""")
_KW = ["declared_max_power_kw", "declared_total_power_kw", "effective_max_power_kw", "effective_total_power_kw", "power_disagreement_kw"]
REG.add("station_power", lambda t: rounded(power(t)), round_all(
    "station_power_raw", [*_KW, "connector_max_power_kw", "connector_sum_power_kw", "connector_avg_power_kw"]))

relation("dim_station_raw", """
    select s.* exclude (charging_points_count, max_power_kw, total_power_kw, is_fast_charger), b.label_de as bundesland_label_de,
           s.is_fast_charger as declared_is_fast_charger, p.* exclude (station_id, external_id, bundesland,
               declared_charging_category, connector_max_power_kw, connector_sum_power_kw, connector_avg_power_kw),
           s.charging_category is distinct from p.effective_charging_category as has_category_disagreement
    from stg_station s join station_power_raw p using (station_id) left join states b on b.bundesland = s.bundesland""")
REG.add("dim_charging_station", lambda t: rounded(dim_station(t)), round_all("dim_station_raw", [*_KW, "latitude", "longitude"]))

relation("by_year", """
    select bundesland, commissioned_year, count(*) as n from stg_station
    where bundesland is not null and commissioned_year is not null group by 1, 2""")
REG.add("charging_infrastructure", lambda t: rounded(stations.charging_infrastructure(dim_station(t), t.states, AS_OF)), f"""
    with agg as (
        select bundesland, count(*) as n, count(*) filter (is_fast_charger) as fast, count(*) filter (is_ultra_fast_charger) as ultra,
               count(*) filter (effective_charging_category = 'normal') as slow, count(distinct operator) as ops,
               sum(connector_count)::bigint as pts, sum(fast_connector_count)::bigint as fpts,
               sum(ultra_fast_connector_count)::bigint as upts, sum(ac_connector_count)::bigint as acpts,
               sum(dc_connector_count)::bigint as dcpts,
               sum(coalesce(effective_total_power_kw, effective_max_power_kw)) as kw,
               quantile_cont(effective_max_power_kw, 0.5) as p50, quantile_cont(effective_max_power_kw, 0.9) as p90,
               max(effective_max_power_kw) as top, count(*) filter (power_basis = 'none') as unrated,
               count(*) filter (has_category_disagreement) as disagree, count(commissioned_on) as dated,
               count(*) filter (commissioned_on >= date '{REGISTER_NOW[:10]}' - interval 12 month) as m12,
               count(*) filter (commissioned_on >= date '{REGISTER_NOW[:10]}' - interval 36 month) as m36,
               min(commissioned_on) as first_on, max(commissioned_on) as last_on,
               count(*) filter (data_origin = 'official') as official, max(ingested_at) as newest
        from dim_station_raw where bundesland is not null group by 1),
    years as (select bundesland, '{{' || string_agg('"' || commissioned_year || '": ' || n, ', ' order by commissioned_year) || '}}' as series
              from by_year group by 1),
    peak as (select bundesland, commissioned_year as py, n as pn from by_year
             qualify row_number() over (partition by bundesland order by n desc, commissioned_year desc) = 1),
    base as (
        select b.bundesland, b.label_de as bundesland_label_de, b.area_km2, coalesce(n, 0) as station_count,
               coalesce(fast, 0) as fast_station_count, coalesce(ultra, 0) as ultra_fast_station_count,
               coalesce(slow, 0) as normal_station_count, coalesce(ops, 0) as operator_count,
               coalesce(pts, 0) as charging_point_count, coalesce(fpts, 0) as fast_charging_point_count,
               coalesce(upts, 0) as ultra_fast_charging_point_count, coalesce(acpts, 0) as ac_charging_point_count,
               coalesce(dcpts, 0) as dc_charging_point_count, round(coalesce(kw, 0), 1) as installed_power_kw,
               round(p50, 1) as median_station_power_kw, round(p90, 1) as p90_station_power_kw,
               round(top, 6) as max_station_power_kw, coalesce(unrated, 0) as stations_without_power_count,
               coalesce(disagree, 0) as stations_with_category_disagreement_count,
               round(1000 * coalesce(n, 0) / area_km2, 2) as stations_per_1000_km2,
               round(1000 * coalesce(fast, 0) / area_km2, 2) as fast_stations_per_1000_km2,
               round(1000 * coalesce(pts, 0) / area_km2, 2) as charging_points_per_1000_km2,
               round(1000 * coalesce(kw, 0) / area_km2, 1) as installed_kw_per_1000_km2,
               case when n > 0 then round(100 * fast / n, 1) end as fast_station_share_percent,
               case when pts > 0 then round(100 * fpts / pts, 1) end as fast_charging_point_share_percent,
               case when n > 0 then round(pts / n, 2) end as mean_connectors_per_station,
               coalesce(dated, 0) as stations_with_commissioning_date_count, coalesce(m12, 0) as stations_commissioned_last_12m,
               coalesce(m36, 0) as stations_commissioned_last_36m, first_on as first_commissioned_on,
               last_on as latest_commissioned_on, py as peak_commissioning_year, pn as peak_commissioning_year_station_count,
               coalesce(series, '{{}}') as stations_by_commissioning_year,
               case when dated - m12 > 0 then round(100 * m12 / (dated - m12), 1) end as expansion_rate_12m_percent,
               coalesce(official, 0) as official_station_count, newest as latest_ingested_at
        from states b left join agg using (bundesland) left join years using (bundesland) left join peak using (bundesland))
    select *, round(100 * station_count / (select sum(station_count) from base), 2) as share_of_resolved_stations_percent,
           round(100 * installed_power_kw / (select sum(installed_power_kw) from base), 2) as share_of_resolved_power_percent,
           (rank() over (order by station_count desc))::int as rank_by_station_count,
           (rank() over (order by stations_per_1000_km2 desc))::int as rank_by_station_density,
           (rank() over (order by installed_power_kw desc))::int as rank_by_installed_power,
           (rank() over (order by coalesce(fast_station_share_percent, -1) desc))::int as rank_by_fast_station_share
    from base""")

# ---- corridors
relation("vertex_xy", "select * from " + duck_utm32("route_vertices", "latitude", "longitude", "x", "y"))
relation("route_edges", """
    select *, sum(m) over (partition by route_id) as line_m,
           sum(m) over (partition by route_id order by edge_no) - m as start_m
    from (select route_id, is_demo, ordinal + 1 as edge_no, x as x0, y as y0, latitude as lat0, longitude as lon0,
                 lead(x) over w as x1, lead(y) over w as y1, lead(latitude) over w as lat1, lead(longitude) over w as lon1,
                 sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as m
          from vertex_xy window w as (partition by route_id order by ordinal))
    where x1 is not null""")
relation("station_xy", "select * from " + duck_utm32("stg_station", "latitude", "longitude", "px", "py"))


def nearest_sql(points: str, point_id: str, edges: str, line_id: str, buffer_m: float, condition: str = "true", extra: str = "") -> str:
    """All (point, line) pairs by brute force: every point against every edge."""
    return f"""
    select {point_id}, {line_id}, min(d) as distance_m, arg_min(start_m + t * m, (d, edge_no)) as offset_m, any_value(line_m) as line_m{extra}
    from (select *, sqrt(power(px - x0 - t * (x1 - x0), 2) + power(py - y0 - t * (y1 - y0), 2)) as d
          from (select p.*, e.*, case when m > 0 then greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0))
                       / (power(x1 - x0, 2) + power(y1 - y0, 2)))) else 0::double end as t
                from {points} p, {edges} e where {condition}))
    where d <= {buffer_m} group by {point_id}, {line_id}"""


relation("station_near", nearest_sql("station_xy", "station_id", "route_edges", "route_id", 5000))
relation("corridor_raw", """
    select n.route_id, n.station_id, n.distance_m as distance_to_route_m, n.offset_m as route_offset_m,
           n.line_m as route_geometry_length_m, s.external_id, s.operator, s.city, s.bundesland, s.latitude, s.longitude,
           s.commissioned_on, s.data_origin, s.source_system, p.effective_max_power_kw, p.effective_total_power_kw,
           p.effective_charging_category, p.is_fast_charger, p.is_ultra_fast_charger, p.connector_count,
           p.fast_connector_count, p.ultra_fast_connector_count, p.has_ccs, p.connector_types,
           round(n.distance_m / 1e3, 3) as distance_to_route_km, round(n.offset_m / 1e3, 3) as route_offset_km,
           round(n.line_m / 1e3, 3) as route_geometry_length_km, 5000::double as corridor_buffer_m
    from station_near n join stg_station s using (station_id) left join station_power_raw p using (station_id)
    where n.route_id in (select id from routes where is_demo)""")


def stg_routes(t: Tables):
    return staging.routes(t.routes)


def corridor(t: Tables):
    return corridors.corridor_stations(stg_routes(t), stg_stations(t), power(t))


def coverage(t: Tables):
    return (corridors.corridor_coverage(stg_routes(t), corridor(t)))


REG.add("corridor_stations", lambda t: rounded(corridor(t), 3), round_all(
    "corridor_raw", ["distance_to_route_m", "route_offset_m", "route_geometry_length_m", "latitude", "longitude",
                     "effective_max_power_kw", "effective_total_power_kw"], 3))
REG.add("distance_join", lambda t: rounded(distance_join(
    stg_stations(t), stg_routes(t), ["station_id"], ["route_id"], 5000.0), 3),
    "select route_id, station_id, round(distance_m, 3) as distance_m, round(offset_m, 3) as offset_m, round(line_m, 3) as line_m from station_near")


def gap_sql(stations_relation: str, offset: str, length: str, tag: str, routes: str = "true") -> None:
    relation(f"gaps_{tag}", f"""
        select route_id, {offset} as gap_start, after as gap_end, after - {offset} as gap, 'between' as gap_kind
        from (select *, lead({offset}) over (partition by route_id order by {offset}, station_id) as after from {stations_relation})
        where after is not null
        union all
        select route_id, 0, min({offset}), min({offset}), 'origin' from {stations_relation} group by route_id
        union all
        select route_id, last, {length}, greatest(0, {length} - last), 'destination'
        from (select route_id, max({offset}) as last from {stations_relation} group by 1) join route_length using (route_id)
        union all
        select route_id, 0, {length}, {length}, 'whole_route' from route_length
        where {routes} and route_id not in (select route_id from {stations_relation})""")


relation("route_length", """
    select route_id, any_value(is_demo) as is_demo, any_value(line_m) as line_m, round(any_value(line_m) / 1e3, 3) as line_km
    from route_edges group by 1""")
relation("fast_offsets", "select route_id, station_id, route_offset_km from corridor_raw where is_fast_charger")
gap_sql("fast_offsets", "route_offset_km", "line_km", "fast", "is_demo")
_TEXT = corridors.methodology(5.0, 50.0)
relation("coverage_raw", f"""
    select r.route_id, r.slug as route_slug, r.name as route_name, r.origin_name, r.destination_name,
           r.distance_km as route_distance_km, r.duration_min as route_duration_min, l.line_km as route_geometry_length_km,
           5::double as corridor_buffer_km, 50::double as fast_charger_min_kw, 50::double as target_max_gap_km,
           2::double as target_fast_stations_per_100km,
           coalesce(n, 0) as station_count, coalesce(fast, 0) as fast_station_count, coalesce(ultra, 0) as ultra_fast_station_count,
           coalesce(ccs, 0) as ccs_station_count, coalesce(ops, 0) as operator_count, coalesce(pts, 0) as charging_point_count,
           coalesce(fpts, 0) as fast_charging_point_count, coalesce(upts, 0) as ultra_fast_charging_point_count,
           round(coalesce(kw, 0), 1) as installed_power_kw, round(top, 6) as max_station_power_kw, round(p50, 1) as median_station_power_kw,
           nearest as nearest_station_distance_km, mean_km as mean_station_distance_km,
           round(100 * coalesce(n, 0) / r.distance_km, 2) as stations_per_100km,
           round(100 * coalesce(fast, 0) / r.distance_km, 2) as fast_stations_per_100km,
           round(100 * coalesce(fpts, 0) / r.distance_km, 2) as fast_charging_points_per_100km,
           gaps as gap_count, gap_total as gap_total_km, gap_max as max_gap_km, gap_mean as mean_gap_km, gap_p90 as p90_gap_km,
           above as gaps_above_target_count, round(w.gap_start, 3) as largest_gap_start_km, round(w.gap_end, 3) as largest_gap_end_km,
           round(w.gap, 3) as largest_gap_km, w.gap_kind as largest_gap_kind,
           round(0.6 * 5000 / greatest(gap_max, 50) + 0.4 * least(100, 50 * round(100 * coalesce(fast, 0) / r.distance_km, 2)), 1) as coverage_score,
           '{_TEXT}' as methodology
    from stg_route r join route_length l using (route_id)
    left join (select route_id, count(*) as n, count(*) filter (is_fast_charger) as fast, count(*) filter (is_ultra_fast_charger) as ultra,
                      count(*) filter (has_ccs) as ccs, count(distinct operator) as ops, sum(connector_count)::bigint as pts,
                      sum(fast_connector_count)::bigint as fpts, sum(ultra_fast_connector_count)::bigint as upts,
                      sum(coalesce(effective_total_power_kw, effective_max_power_kw)) as kw, max(effective_max_power_kw) as top,
                      quantile_cont(effective_max_power_kw, 0.5) as p50, round(min(distance_to_route_km), 3) as nearest,
                      round(avg(distance_to_route_km)::decimal(18,9), 3)::double as mean_km from corridor_raw group by 1) c using (route_id)
    left join (select route_id, count(*) as gaps, round(sum(gap), 3) as gap_total, round(max(gap), 3) as gap_max,
                      round(avg(gap)::decimal(18,9), 3)::double as gap_mean, round(quantile_cont(gap, 0.9)::decimal(18,9), 3)::double as gap_p90,
                      count(*) filter (gap > 50) as above from gaps_fast group by 1) g using (route_id)
    left join (select * from gaps_fast qualify row_number() over (partition by route_id order by gap desc, gap_start) = 1) w using (route_id)
    where r.is_demo""")
REG.add("corridor_coverage", lambda t: rounded(coverage(t)), "select * from coverage_raw")


def ranked_gaps(t: Tables, **options):
    return corridors.coverage_query(stg_routes(t), stg_stations(t), **options)


relation("qualifying", """
    select route_id, station_id, offset_m from station_near join stg_station using (station_id) where coalesce(max_power_kw, 0) >= 50""")
gap_sql("qualifying", "offset_m", "line_m", "declared")


def _ranked_sql(top: int, min_gap_km: float) -> str:
    return f"""
    select route_id, r.slug as route_slug, r.name as route_name, 5::double as buffer_km, 50::double as min_power_kw,
           r.distance_km as route_distance_km, l.line_km as route_geometry_length_km, s.n as stations_in_corridor,
           s.fast as fast_stations_in_corridor, coalesce(s.q, 0) as qualifying_stations,
           round(100 * coalesce(s.q, 0) / (r.distance_m / 1e3), 2) as qualifying_stations_per_100km, gaps as gap_count,
           round(gap_max / 1e3, 3) as max_gap_km, round(gap_mean / 1e3, 3) as mean_gap_km, round(gap_total / 1e3, 3) as gap_total_km,
           k::int as rank_in_route, gap_kind, round(gap_start / 1e3, 3) as start_offset_km, round(gap_end / 1e3, 3) as end_offset_km,
           round(gap / 1e3, 3) as gap_km,
           round(0.6 * 5000 / greatest(gap_max / 1e3, 50) + 0.4 * least(100, 50 * 100 * coalesce(s.q, 0) / (r.distance_m / 1e3)), 1) as coverage_score,
           '{_TEXT}' as methodology
    from (select *, row_number() over (partition by route_id order by gap desc, gap_start) as k,
                 count(*) over (partition by route_id) as gaps, max(gap) over (partition by route_id) as gap_max,
                 avg(gap) over (partition by route_id) as gap_mean, sum(gap) over (partition by route_id) as gap_total
          from gaps_declared) join stg_route r using (route_id) join route_length l using (route_id)
    left join (select route_id, count(*) as n, count(*) filter (is_fast_charger) as fast,
                      count(*) filter (coalesce(max_power_kw, 0) >= 50) as q
               from station_near join stg_station using (station_id) group by 1) s using (route_id)
    where k <= {top} and (k = 1 or gap >= {min_gap_km * 1000})"""


REG.add("coverage_query", lambda t: ranked_gaps(t), _ranked_sql(25, 0))
REG.add("coverage_query_geometry", lambda t: ranked_gaps(t, count_all_stations=False, include_geometry=True).select(
    "route_id", "rank_in_route", "gap_kind", "gap_km", "qualifying_stations", "stations_in_corridor", "gap_geometry"), f"""
    with piece as (select route_id, gap_kind, gap, gap_start as s, gap_end as e, row_number() over (partition by route_id order by gap desc, gap_start) as k from gaps_declared),
    cut as (select *, greatest(s, start_m) as b, least(e, start_m + m) as f from piece join route_edges using (route_id) where k <= 25 and least(e, start_m + m) - greatest(s, start_m) > 1e-6),
    spot as (select route_id, k, b as at_, lat0 + (lat1 - lat0) * (b - start_m) / m as lat, lon0 + (lon1 - lon0) * (b - start_m) / m as lon from cut
             union all select route_id, k, f, lat0 + (lat1 - lat0) * (f - start_m) / m, lon0 + (lon1 - lon0) * (f - start_m) / m from cut where e <= start_m + m + 1e-6),
    shape as (select route_id, k, '{{"type": "LineString", "coordinates": [' || string_agg(printf('[%.6f, %.6f]', lon, lat), ', ' order by at_) || ']}}' as line from spot group by 1, 2)
    select route_id, p.k::int as rank_in_route, gap_kind, round(gap / 1e3, 3) as gap_km, coalesce(q, 0) as qualifying_stations, null::bigint as stations_in_corridor, line as gap_geometry
    from piece p left join shape using (route_id, k) left join (select route_id, count(*) as q from qualifying group by 1) using (route_id) where p.k <= 25""")
relation("underserved_ranked", _ranked_sql(25, 30))
REG.add("underserved", lambda t: corridors.underserved(ranked_gaps(t, min_reported_gap_km=30.0), 30.0), """
    select coalesce(any_value(route_slug), route_id) as route_slug, any_value(route_name) as name, max(max_gap_km) as worst_gap_km,
           any_value(coverage_score) as coverage_score, max(max_gap_km) > 30 as is_underserved,
           (count(*) filter (gap_km > 30))::int as segment_count,
           coalesce(string_agg(printf('%.3f-%.3f %s', start_offset_km, end_offset_km, gap_kind), '; ' order by rank_in_route)
               filter (gap_km > 30), '') as segments
    from underserved_ranked group by route_id""")
REG.add("gap_invariant", lambda t: corridors.gap_invariant(coverage(t)), """
    select route_id, gap_count, gap_total_km, route_geometry_length_km,
           round(abs(gap_total_km - route_geometry_length_km), 3) as drift_km,
           abs(gap_total_km - route_geometry_length_km) > 0.01 as is_broken from coverage_raw""")
