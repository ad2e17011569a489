"""Queries and oracles: searches, statistics, fleet analytics, dashboard, data health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strom.functions.lookups import in_germany
from strom.plans import fleet, staging, traffic
from strom.plans import station_queries as sq
from strom.plans.trips import rounded
from strom.registry.fleet_models import models
from strom.registry.oracle import Registry, relation
from strom.registry.stations import stg_points, stg_stations
from strom.sources.driver import FLEET_NOW, TRAFFIC_NOW, Tables

REG = Registry()
NOW = dt.datetime.fromisoformat(FLEET_NOW).replace(tzinfo=dt.UTC)
TRAFFIC_AT = dt.datetime.fromisoformat(TRAFFIC_NOW).replace(tzinfo=dt.UTC)
BOX = (7.0, 48.0, 11.5, 52.0)
_IN_BOX = "longitude between 7.0 and 11.5 and latitude between 48.0 and 52.0"

relation("stg_telemetry_raw", "select * exclude (state), state as vehicle_state from telemetry")


def tele(t: Tables):
    return staging.telemetry(t.telemetry)


def events(t: Tables):
    return staging.traffic_events(t.traffic_events).drop("geometry")


def weather(t: Tables):
    return staging.weather_observations(t.weather_observations)


_SITE = "station_id, operator, city, bundesland, round(max_power_kw, 6) as max_power_kw, charging_category"


def _site(df):
    return rounded(df.select("station_id", "operator", "city", "bundesland", "max_power_kw", "charging_category"))


REG.add("station_filter", lambda t: _site(sq.station_filter(
    stg_stations(t), box=BOX, min_power_kw=20.0, category="fast", commissioned_from=dt.date(2012, 1, 1),
    commissioned_to=dt.date(2023, 12, 31))), f"""
    select {_SITE} from stg_station where {_IN_BOX} and max_power_kw >= 20 and charging_category = 'fast'
    and commissioned_on between date '2012-01-01' and date '2023-12-31'""")
REG.add("text_search", lambda t: _site(sq.station_filter(stg_stations(t), q="mach")),
        f"select {_SITE} from stg_station where lower(operator) like '%mach%' or lower(city) like '%mach%'")
REG.add("bbox_filter", lambda t: _site(sq.station_filter(stg_stations(t), box=BOX)), f"select {_SITE} from stg_station where {_IN_BOX}")
REG.add("germany_bbox", lambda t: stg_stations(t).select(
    "station_id", in_germany(F.col("latitude"), F.col("longitude")).alias("inside")),
    "select station_id, latitude between 47.2 and 55.1 and longitude between 5.8 and 15.1 as inside from stg_station")
REG.add("station_page", lambda t: _site_page(t),
        f"select {_SITE}, (select count(*) from stg_station) as total from stg_station order by max_power_kw desc nulls last, station_id limit 25 offset 50")


def _site_page(t: Tables):
    ordered = sq.strongest_first(stg_stations(t)).select(
        "station_id", "operator", "city", "bundesland", "max_power_kw", "charging_category")
    return rounded(sq.page(ordered, 3, 25))


REG.add("geojson_features", lambda t: rounded(sq.geojson_features(stg_stations(t))), """
    with kept as (select * from stg_station order by max_power_kw desc nulls last, station_id limit 20000)
    select station_id, '{"type":"Feature","id":"' || station_id || '","geometry":{"type":"Point","coordinates":[' ||
           round(longitude, 6)::varchar || ',' || round(latitude, 6)::varchar || ']},"properties":{' ||
           coalesce('"operator":"' || operator || '",', '') || '"city":"' || city || '","charging_category":"' ||
           charging_category || '","is_fast_charger":' || is_fast_charger::varchar || '}}' as feature,
           (select count(*) from stg_station) as total_matching,
           round((select min(longitude) from kept), 6) as west, round((select min(latitude) from kept), 6) as south,
           round((select max(longitude) from kept), 6) as east, round((select max(latitude) from kept), 6) as north,
           (select count(*) from stg_station) > 20000 as truncated from kept""")
REG.add("traffic_features", lambda t: rounded(traffic.geojson_features(staging.traffic_events(t.traffic_events))), """
    with kept as (select *, extent_latitude is not null as is_line, round(longitude, 6)::varchar as lon, round(latitude, 6)::varchar as lat,
                         round(extent_longitude, 6)::varchar as lon1, round(extent_latitude, 6)::varchar as lat1,
                         case severity when 'low' then 1 when 'moderate' then 2 when 'high' then 3 when 'severe' then 4 end as ordinal
                  from stg_traffic order by ordinal desc nulls last, traffic_event_id limit 20000)
    select traffic_event_id, '{"type":"Feature","id":"' || traffic_event_id || '","geometry":{"type":"' ||
           case when is_line then 'LineString","coordinates":[[' || lon || ',' || lat || '],[' || lon1 || ',' || lat1 || ']]' else 'Point","coordinates":[' || lon || ',' || lat || ']' end ||
           '},"properties":{"external_id":' || coalesce('"' || external_id || '"', 'null') || ',"event_type":"' || event_type || '","severity":"' || severity || '","is_blocked":' || is_blocked::varchar ||
           ',"road_name":' || coalesce('"' || road_name || '"', 'null') || ',"direction":' || coalesce('"' || direction || '"', 'null') || ',"title":' || coalesce('"' || title || '"', 'null') ||
           ',"delay_minutes":' || coalesce(delay_minutes::varchar, 'null') || ',"geometry_kind":"' || case when is_line then 'LineString' else 'Point' end || '"}}' as feature,
           (select count(*) from stg_traffic) as total_matching, (select count(*) from stg_traffic) > 20000 as truncated,
           round((select min(least(longitude, coalesce(extent_longitude, longitude))) from kept), 6) as west, round((select min(least(latitude, coalesce(extent_latitude, latitude))) from kept), 6) as south,
           round((select max(greatest(longitude, coalesce(extent_longitude, longitude))) from kept), 6) as east, round((select max(greatest(latitude, coalesce(extent_latitude, latitude))) from kept), 6) as north
    from kept""")
REG.add("stations_with_points", lambda t: _nested(t), """
    select s.station_id, 0::bigint as part, coalesce(n, 0)::int as point_count, coalesce(kinds, '') as points from stg_station s left join (
        select station_id, count(*) as n, string_agg(connector_ordinal || ':' || connector_type, ',' order by connector_ordinal) as kinds
        from stg_point group by 1) using (station_id)""")


def _nested(t: Tables):
    text = F.transform("points", lambda p: F.concat_ws(":", p.connector_ordinal.cast("string"), p.connector_type))
    return sq.stations_with_points(stg_stations(t), stg_points(t)).select(
        "station_id", "part", F.size("points").alias("point_count"), F.array_join(text, ",").alias("points"))


REG.add("statistics_by_state", lambda t: sq.statistics_by_state(stg_stations(t), stg_points(t), t.states), """
    select bundesland, label_de, n as stations, total_kw, coalesce(f, 0) as fast_points
    from (select bundesland, count(*) as n, round(coalesce(sum(coalesce(total_power_kw, max_power_kw)), 0), 1) as total_kw
          from stg_station where bundesland is not null group by 1) join states using (bundesland)
    left join (select bundesland, count(*) as f from stg_point p join stg_station using (station_id) where power_kw >= 50 group by 1) using (bundesland)""")
REG.add("statistics_by_power_class", lambda t: sq.statistics_by_power_class(stg_stations(t)), """
    select c.charging_category, count(s.station_id) as stations from (values ('normal'), ('fast'), ('ultra_fast')) c(charging_category)
    left join stg_station s on s.charging_category = c.charging_category group by 1""")
REG.add("top_operators", lambda t: sq.top_operators(stg_stations(t), 3), """
    select operator, count(*) as stations from stg_station where operator is not null group by 1 order by 2 desc, 1 limit 3""")
REG.add("growth", lambda t: sq.growth(stg_stations(t)), """
    select commissioned_year as year, n as stations, (sum(n) over (order by commissioned_year))::bigint as cumulative
    from (select commissioned_year, count(*) as n from stg_station where commissioned_on is not null group by 1)""")
REG.add("region_comparison", lambda t: rounded(sq.region_comparison(stg_stations(t), stg_points(t), t.states)), """
    with site as (select bundesland, count(*) as n, count(*) filter (is_fast_charger) as fast,
                         count(*) filter (charging_category = 'ultra_fast') as ultra, count(distinct operator) as ops,
                         round(coalesce(sum(coalesce(total_power_kw, max_power_kw)), 0), 1) as kw, max(max_power_kw) as top,
                         round(quantile_cont(max_power_kw, 0.5), 1) as mid from stg_station where bundesland is not null group by 1),
    point as (select bundesland, count(*) as pts, count(*) filter (power_kw >= 50) as fpts
              from stg_point join stg_station using (station_id) where bundesland is not null group by 1),
    totals as (select count(*) as everything, count(bundesland) as resolved from stg_station)
    select bundesland, label_de, area_km2, coalesce(n, 0) as stations, coalesce(fast, 0) as fast_stations,
           coalesce(ultra, 0) as ultra_fast_stations, coalesce(ops, 0) as operators, coalesce(pts, 0) as charging_points,
           coalesce(fpts, 0) as fast_charging_points, coalesce(kw, 0) as installed_power_kw, round(top, 6) as max_power_kw,
           mid as median_station_power_kw, round(1000 * coalesce(n, 0) / area_km2, 2) as stations_per_1000_km2,
           round(1000 * coalesce(fast, 0) / area_km2, 2) as fast_stations_per_1000_km2,
           round(1000 * coalesce(pts, 0) / area_km2, 2) as charging_points_per_1000_km2,
           round(100 * coalesce(n, 0) / resolved, 2) as share_of_resolved_stations_percent,
           everything - resolved as stations_without_bundesland
    from states left join site using (bundesland) left join point using (bundesland), totals""")

# ---- fleet
_LIVE = ["latitude", "longitude", "battery_soc_percent", "battery_temperature_c", "outside_temperature_c", "instantaneous_power_kw"]
relation("newest_sample", "select * from stg_telemetry_raw qualify row_number() over (partition by vehicle_id order by recorded_at desc, telemetry_id) = 1")
_LIVE_SQL = ", ".join(f"round({c}, 6) as {c}" if c in _LIVE else c for c in fleet.LIVE_COLUMNS)
REG.add("live_vehicles", lambda t: rounded(fleet.live_vehicles(tele(t), t.vehicles, models(t), since=NOW, box=BOX)), f"""
    with hit as (select * from stg_telemetry_raw where recorded_at > timestamp '{FLEET_NOW}' and {_IN_BOX}
                 qualify row_number() over (partition by vehicle_id order by recorded_at desc, telemetry_id) = 1
                 order by vehicle_id limit 1000)
    select vehicle_id, {_LIVE_SQL}, coalesce(vehicle_model_code, 'unknown') as model_code
    from hit h left join (select vehicle_id, vehicle_model_id from vehicles) v using (vehicle_id)
    left join dim_vehicle_model using (vehicle_model_id)""")
REG.add("fleet_summary", lambda t: rounded(fleet.fleet_summary(tele(t), t.vehicles, models(t))), """
    select v.id, v.vehicle_id, v.state, v.simulation_run_id, vehicle_model_id, vehicle_model_code, display_name, vehicle_class,
           recorded_at as last_seen_at, round(battery_soc_percent, 6) as battery_soc_percent, round(odometer_m, 6) as odometer_m
    from vehicles v join dim_vehicle_model using (vehicle_model_id) left join newest_sample n on n.vehicle_id = v.vehicle_id""")
REG.add("latest_per_key", lambda t: rounded(fleet.latest_per_key(
    tele(t).select("trip_id", "telemetry_id", "recorded_at", "odometer_m"), "trip_id", "recorded_at", "telemetry_id")), """
    select trip_id, telemetry_id, recorded_at, round(odometer_m, 6) as odometer_m from telemetry where trip_id is not null
    qualify row_number() over (partition by trip_id order by recorded_at desc, telemetry_id) = 1""")
REG.add("vehicle_totals", lambda t: rounded(fleet.vehicle_totals(staging.trips(t.trips)), 4), """
    select vehicle_id as vehicle_uuid, count(*) as trips_total, round(sum(distance_m), 4) + 0 as distance_total_m,
           round(sum(energy_kwh), 4) + 0 as energy_total_kwh from trips group by 1""")
REG.add("last_samples", lambda t: rounded(fleet.last_samples(tele(t), 10).select(
    "vehicle_id", "telemetry_id", "recorded_at", "speed_kmh", "battery_soc_percent", "odometer_m")), """
    select vehicle_id, telemetry_id, recorded_at, speed_kmh, round(battery_soc_percent, 6) as battery_soc_percent, odometer_m
    from telemetry qualify row_number() over (partition by vehicle_id order by recorded_at desc, telemetry_id desc) <= 10""")
REG.add("trip_series", lambda t: rounded(fleet.trip_series(tele(t), max_points=3)), """
    select trip_id, recorded_at, speed_kmh, round(battery_soc_percent, 6) as battery_soc_percent, energy_consumption_kwh_100km,
           round(cumulative_energy_kwh, 6) + 0 as cumulative_energy_kwh, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
           k as position, total, round(greatest(0, (odometer_m - low) / 1e3), 6) as offset_km
    from (select *, row_number() over (partition by trip_id order by recorded_at, telemetry_id) as k,
                 count(*) over (partition by trip_id) as total, min(odometer_m) over (partition by trip_id) as low
          from telemetry where trip_id is not null)
    where k % greatest(1, ceil(total / 3))::bigint = 0 or k = total""")


def _bucket_sql(index: str, labels: dict) -> str:
    def cases(position: int) -> str:
        body = " ".join(
            f"when {i} then {repr(v[position]) if isinstance(v[position], str) else v[position]}"
            for i, v in labels.items() if v[position] is not None
        )
        return f"(case bucket_index {body} end)"

    return f"""
    with rows_ as (select case when vehicle_state = 'driving' and speed_kmh > 0 then ({index})::bigint end as bucket_index,
                          energy_consumption_kwh_100km as kwh, speed_kmh, outside_temperature_c from stg_telemetry_raw),
    grouped as (select bucket_index, count(*) as n, avg(kwh) as mean, quantile_cont(kwh, 0.1) as p10, quantile_cont(kwh, 0.5) as p50,
                       quantile_cont(kwh, 0.9) as p90, avg(speed_kmh) as v, avg(outside_temperature_c) as temp from rows_ group by 1)
    select bucket_index, {cases(0)} as bucket, {cases(1)}::double as lower_bound, {cases(2)}::double as upper_bound, n as sample_count,
           round(mean, 2) as mean_kwh_per_100km, round(p50, 2) as median_kwh_per_100km, round(p10, 2) as p10_kwh_per_100km,
           round(p90, 2) as p90_kwh_per_100km, round(v, 1) as mean_speed_kmh, round(temp, 1) as mean_temperature_c,
           (select round(sum(mean * n) / sum(n), 2) from grouped where bucket_index is not null) as overall_mean_kwh_per_100km,
           (select coalesce(sum(n), 0)::bigint from grouped where bucket_index is null) as excluded_samples
    from grouped where bucket_index is not null"""


def _linear(column: str, bands) -> tuple[str, dict]:
    low, high, count = bands
    index = (f"case when {column} < {low} then 0 when {column} >= {high} then {count + 1} "
             f"else floor({count} * ({column} - ({low})) / ({high} - ({low}))) + 1 end")
    return index, {i: fleet.band_label(bands, "°C" if "temp" in column else "km/h", i) for i in range(count + 2)}


_REFERENCE = "case road_class " + " ".join(f"when '{k}' then {v}" for k, v in fleet.REFERENCE_SPEED_KMH.items()) + " end"
_RATIO = f"speed_kmh / coalesce(nullif(speed_limit_kmh, 0), {_REFERENCE})"
_CONGESTION = f"case when {_RATIO} >= 0.9 then 1 when {_RATIO} >= 0.7 then 2 when {_RATIO} >= 0.5 then 3 when {_RATIO} is not null then 4 end"
REG.add("energy_by_temperature", lambda t: fleet.energy_by_dimension(tele(t), "temperature"), _bucket_sql(*_linear("outside_temperature_c", fleet.TEMPERATURE_BANDS)))
REG.add("energy_by_speed", lambda t: fleet.energy_by_dimension(tele(t), "speed"), _bucket_sql(*_linear("speed_kmh", fleet.SPEED_BANDS)))
REG.add("energy_by_congestion", lambda t: fleet.energy_by_dimension(tele(t), "traffic"),
        _bucket_sql(_CONGESTION, {i: (fleet.CONGESTION_LABELS[i], *fleet.CONGESTION_BOUNDS[i]) for i in fleet.CONGESTION_LABELS}))

REG.add("moving_only", lambda t: fleet.moving_only(tele(t)).select("telemetry_id", "speed_kmh"),
        "select telemetry_id, speed_kmh from telemetry where speed_kmh >= 5")
REG.add("hourly_trend", lambda t: rounded(fleet.hourly_trend(tele(t), NOW, 24 * 10)), f"""
    select date_trunc('hour', recorded_at) as bucket, round(avg(energy_consumption_kwh_100km), 6) as kwh_100km from telemetry
    where speed_kmh >= 5 and recorded_at >= timestamp '{FLEET_NOW}' - interval 240 hour group by 1""")
REG.add("dashboard_summary", lambda t: fleet.dashboard_summary(
    tele(t), stg_stations(t), stg_points(t), events(t), weather(t), t.ingestion_runs, NOW), f"""
    with recent as (select * from telemetry where speed_kmh >= 5 and recorded_at >= timestamp '{FLEET_NOW}' - interval 24 hour),
    hours as (select strftime(date_trunc('hour', recorded_at), '%Y-%m-%d %H') as h, round(avg(energy_consumption_kwh_100km), 3) as v from recent group by 1),
    runs as (select * from ingestion_runs qualify row_number() over (partition by source order by started_at desc) = 1)
    select (select count(distinct vehicle_id) from telemetry where recorded_at >= (select max(recorded_at) - interval 15 minute from telemetry)) as vehicles_active,
           (select count(*) from stg_station) as charging_stations_total,
           (select count(*) from stg_point where power_kw >= 50) as fast_charging_points_total,
           (select count(*) from stg_traffic where coalesce(starts_at <= timestamp '{FLEET_NOW}', true)
                and coalesce(ends_at >= timestamp '{FLEET_NOW}', true)) as traffic_events_active,
           (select round(avg(energy_consumption_kwh_100km), 6) from recent) as avg_consumption_kwh_100km,
           (select string_agg(h || '=' || v, ', ' order by h) from hours) as energy_trend,
           (select string_agg(c || '=' || n, ', ' order by c) from (select charging_category as c, count(*) as n from stg_station group by 1)) as charging_by_category,
           (select string_agg(source || '=' || status, ', ' order by source) from runs) as data_freshness,
           (select string_agg(external_id, ', ' order by external_id) from (select external_id from stg_traffic
                order by coalesce(starts_at, ingested_at) desc, traffic_event_id limit 5)) as recent_traffic,
           (select weather_condition from stg_weather order by observed_at desc, weather_observation_id limit 1) as weather_condition""")

_STATUS = """case when source = 'simulator' then 'simulation' when status = 'failed' then 'failed'
    when provider_mode <> 'live' or status = 'partial' then 'degraded'
    when age > case source when 'register' then 64800 when 'weather' then 180 when 'traffic' then 360 else 129600 end then 'delayed'
    else 'healthy' end"""
def _terms(position: int) -> str:
    return "case source " + " ".join(f"when '{name}' then '{terms[position]}'" for name, terms in fleet.SOURCE_TERMS.items() if terms[position]) + " end"


REG.add("quality_by_source", lambda t: fleet.quality_by_source(t.ingestion_runs, t.telemetry, NOW), f"""
    with rated as (
        select source, pipeline, {_STATUS} as source_status, 'official' as data_origin, started_at as last_run_at, round(age, 3) as age_minutes, rows_received,
               rows_accepted, rows_rejected, rows_duplicate, provider_mode, source_url, error_message
        from (select *, greatest(0, (epoch_us(timestamp '{FLEET_NOW}') - epoch_us(started_at)) / 6e7) as age from ingestion_runs
              where source <> 'simulator' qualify row_number() over (partition by source order by started_at desc) = 1)
        union all select 'simulator', 'simulation', 'simulation', 'simulated', null, null, count(*), count(*), 0, 0, null, null, null from telemetry)
    select * replace (coalesce(source_url, {_terms(2)}) as source_url), case when rows_received > 0 then round(100 * rows_accepted / rows_received, 2) else 0::double end as acceptance_rate,
           {_terms(0)} as licence, {_terms(1)} as attribution from rated""")
REG.add("source_status", lambda t: t.ingestion_runs.select("id", fleet.source_status(
    F.col("source"), F.col("status"), F.col("provider_mode"),
    F.greatest(F.lit(0.0), (F.unix_micros(F.lit(NOW)) - F.unix_micros("started_at")) / 6e7)).alias("source_status")), f"""
    select id, {_STATUS} as source_status from (select *, greatest(0, (epoch_us(timestamp '{FLEET_NOW}') - epoch_us(started_at)) / 6e7) as age from ingestion_runs)""")
REG.add("source_row_counts", lambda t: fleet.source_row_counts({
    "register": t.charging_stations, "weather": t.weather_observations, "traffic": t.traffic_events, "routing": t.routes,
    "simulator": t.telemetry}), """
    select 'register' as source, count(*) as rows from charging_stations union all select 'weather', count(*) from weather_observations
    union all select 'traffic', count(*) from traffic_events union all select 'routing', count(*) from routes
    union all select 'simulator', count(*) from telemetry""")
REG.add("sites_without_ultra_fast_points", lambda t: sq.without_points(stg_stations(t), stg_points(t).where("power_kw >= 150")).select("station_id", "max_power_kw").transform(rounded),
        "select station_id, round(max_power_kw, 6) as max_power_kw from stg_station s where not exists (select 1 from stg_point p where p.station_id = s.station_id and power_kw >= 150)")
REG.add("ingestion_totals", lambda t: fleet.ingestion_totals(t.ingestion_runs),
        "select sum(rows_accepted)::bigint as accepted, sum(rows_rejected)::bigint as rejected from ingestion_runs")
REG.add("rows_since", lambda t: fleet.rows_since(t.telemetry, NOW),
        f"select count(*) as rows from telemetry where ingested_at >= timestamp '{FLEET_NOW}'")
REG.add("observation_filter", lambda t: rounded(fleet.filter_observations(weather(t), point=(50.11, 8.68), radius_km=150.0, at=TRAFFIC_AT).select(
    "weather_observation_id", "observed_at", "temperature_c", "distance_km"), 3), f"""
    select weather_observation_id, observed_at, temperature_c, round(d, 3) as distance_km
    from (select *, 2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(latitude - 50.11) / 2), 2)
                 + cos(radians(50.11)) * cos(radians(latitude)) * power(sin(radians(longitude - 8.68) / 2), 2)))) as d from stg_weather)
    where d <= 150 and observed_at <= timestamp '{TRAFFIC_NOW}'""")
