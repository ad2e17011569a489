"""Queries and oracles: rule engine and table checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strom.operators import checks
from strom.operators import quality as q
from strom.plans import staging
from strom.plans.trips import rounded
from strom.registry.analytics import events, tele, weather
from strom.registry.fleet_models import fct_telemetry, fct_trips
from strom.registry.oracle import Registry, relation
from strom.registry.stations import AS_OF, stg_points, stg_routes, stg_stations
from strom.sources.driver import FLEET_NOW, REGISTER_NOW, TRAFFIC_NOW, Tables

REG = Registry()
FLEET_AT = dt.datetime.fromisoformat(FLEET_NOW).replace(tzinfo=dt.UTC)
TRAFFIC_AT = dt.datetime.fromisoformat(TRAFFIC_NOW).replace(tzinfo=dt.UTC)


def checked_stations(t: Tables):
    # the key is the postal code's site list entry: several sites share one, so duplicates occur
    return q.validate(stg_stations(t).withColumn("seq", F.substring("station_id", 2, 20).cast("bigint")),
                      q.station_rules(), ["postal_code", "operator"], "seq")


def checked_weather(t: Tables):
    rows = weather(t).withColumn("seq", F.col("weather_observation_id"))
    return q.validate(rows, q.weather_rules(TRAFFIC_AT), ["weather_station_id", "observed_at"], "seq")


def checked_traffic(t: Tables):
    rows = events(t).withColumn("seq", F.substring("traffic_event_id", 2, 20).cast("bigint"))
    return q.validate(rows, q.traffic_rules(), ["road_name", "direction", "starts_at"], "seq")


def checked_telemetry(t: Tables):
    return q.validate(tele(t), q.telemetry_rules(FLEET_AT))


_IN_DE = "coalesce(latitude between 47.2 and 55.1 and longitude between 5.8 and 15.1, false)"


def verdict_sql(source: str, rules: list[tuple[str, str]], key: list[str] | None, order: str | None) -> str:
    if key:
        has_key = " and ".join(f"{k} is not null" for k in key)
        dup = f"({has_key} and row_number() over (partition by {', '.join(key)} order by {order}) > 1)"
    else:
        dup = "false"
    names = ", ".join(f"case when {cond} then '{name}' end" for name, cond in rules)
    return f"""
    select *, case when len(fired) = 0 then 'accepted' when len(fired) = 1 and dup then 'duplicate' else 'rejected' end as quality_status,
           array_to_string(fired, '; ') as quality_rules, fired[1] as quality_rule
    from (select *, list_filter([{names}, case when dup then 'no_duplicate_key' end], lambda x: x is not null) as fired
          from (select *, {dup} as dup from {source}))"""


relation("verdict_station", verdict_sql(
    "(select *, substr(station_id, 2)::bigint as seq from stg_station)",
    [("required_field[external_id]", "external_id is null"), ("required_field[operator]", "operator is null"),
     ("required_field[city]", "city is null"), ("within_germany_bbox", f"not {_IN_DE}"),
     ("positive_power[max_power_kw]", "max_power_kw <= 0 or max_power_kw > 1000")],
    ["postal_code", "operator"], "seq"))
relation("verdict_weather", verdict_sql(
    "stg_weather",
    [("required_field[weather_station_id]", "weather_station_id is null"), ("timestamp_present[observed_at]", "observed_at is null"),
     ("timestamp_not_future[observed_at]", f"epoch_us(observed_at) - epoch_us(timestamp '{TRAFFIC_NOW}') > 900000000"),
     ("within_germany_bbox", f"not {_IN_DE}"), ("numeric_range[temperature_c]", "temperature_c not between -50 and 60")],
    ["weather_station_id", "observed_at"], "weather_observation_id"))
relation("verdict_traffic", verdict_sql(
    "(select *, substr(traffic_event_id, 2)::bigint as seq from stg_traffic)",
    [("required_field[external_id]", "external_id is null"), ("required_field[title]", "title is null"),
     ("within_germany_bbox", f"not {_IN_DE}")],
    ["road_name", "direction", "starts_at"], "seq"))
relation("verdict_telemetry", verdict_sql(
    "stg_telemetry_raw",
    [("required_field[vehicle_id]", "vehicle_id is null"),
     ("soc_in_range[battery_soc_percent]", "not coalesce(battery_soc_percent between 0 and 100, false)"),
     ("latitude_in_range[latitude]", "not coalesce(latitude between -90 and 90, false)"),
     ("longitude_in_range[longitude]", "not coalesce(longitude between -180 and 180, false)"),
     ("timestamp_not_future[recorded_at]", f"epoch_us(recorded_at) - epoch_us(timestamp '{FLEET_NOW}') > 120000000"),
     ("numeric_range[speed_kmh]", "not coalesce(speed_kmh between 0 and 400, false)")], None, None))

for _name, _build, _id in (
    ("station", checked_stations, "station_id"), ("weather", checked_weather, "weather_observation_id"),
    ("traffic", checked_traffic, "traffic_event_id"), ("telemetry", checked_telemetry, "telemetry_id"),
):
    REG.add(f"validate_{_name}", lambda t, b=_build, i=_id: b(t).select(i, "quality_status", "quality_rules", "quality_rule"),
            f"select {_id}, quality_status, quality_rules, quality_rule from verdict_{_name}")


def report_sql(verdicts: str) -> str:
    return f"""
    select 'rows_' || quality_status as metric, count(*) as value from {verdicts} group by 1
    union all select 'rows_received', count(*) from {verdicts}
    union all select 'rule:' || rule, count(*) from (select unnest(fired) as rule from {verdicts}) group by 1"""


REG.add("quality_report", lambda t: q.quality_report(checked_stations(t)), report_sql("verdict_station"))
REG.add("merge_reports", lambda t: q.merge_reports(q.quality_report(checked_stations(t)), q.quality_report(checked_traffic(t))),
        f"select metric, sum(value)::bigint as value from ({report_sql('verdict_station')} union all {report_sql('verdict_traffic')}) group by 1")
REG.add("violation_list", lambda t: q.violations(checked_stations(t), "seq").select("seq", "quality_status", "quality_rules"),
        "select seq, quality_status, quality_rules from verdict_station where len(fired) > 0 order by seq limit 5000")
REG.add("duplicate_rank", lambda t: q.mark_duplicates(
    tele(t).select("telemetry_id", "vehicle_id", "road_class", "speed_limit_kmh"), ["vehicle_id", "road_class", "speed_limit_kmh"], "telemetry_id")
    .select("telemetry_id", "is_duplicate"), """
    select telemetry_id, speed_limit_kmh is not null and row_number() over (
        partition by vehicle_id, road_class, speed_limit_kmh order by telemetry_id) > 1 as is_duplicate from telemetry""")
REG.add("monotonic_violations", lambda t: q.monotonic_violations(
    tele(t).select("telemetry_id", "vehicle_id", "ingested_at"), "vehicle_id", "ingested_at", "telemetry_id"), """
    select * from (select telemetry_id, vehicle_id, ingested_at, max(ingested_at) over (
        partition by vehicle_id order by telemetry_id rows between unbounded preceding and 1 preceding) as latest_before from telemetry)
    where ingested_at < latest_before""")

# ---- table checks
REG.add("check_not_null", lambda t: checks.not_null(stg_stations(t), "bundesland").select("station_id"),
        "select station_id from stg_station where bundesland is null")
REG.add("check_unique", lambda t: checks.unique(stg_stations(t), "city"),
        "select city, count(*) as occurrences from stg_station where city is not null group by 1 having count(*) > 1")
REG.add("check_unique_combination", lambda t: checks.unique(events(t), "road_name", "direction", "severity"),
        "select road_name, direction, severity, count(*) as occurrences from stg_traffic group by all having count(*) > 1")
REG.add("check_accepted_values", lambda t: checks.accepted_values(stg_points(t), "connector_type", ["ccs", "type2", "chademo"]),
        "select connector_type, count(*) as occurrences from stg_point where connector_type not in ('ccs', 'type2', 'chademo') group by 1")
REG.add("check_relationships", lambda t: checks.relationships(
    staging.route_segments(t.route_segments), "route_id", stg_routes(t), "route_id").select("route_segment_id", "route_id"),
    "select route_segment_id, route_id from stg_segment where route_id not in (select route_id from stg_route)")
REG.add("check_accepted_range", lambda t: checks.accepted_range(tele(t), "battery_soc_percent", 30, 90).select("telemetry_id"),
        "select telemetry_id from telemetry where battery_soc_percent < 30 or battery_soc_percent > 90")
REG.add("check_expression_is_true", lambda t: checks.expression_is_true(tele(t), "speed_kmh <= speed_limit_kmh").select("telemetry_id"),
        "select telemetry_id from telemetry where not coalesce(speed_kmh <= speed_limit_kmh, false)")
REG.add("check_spine_complete", lambda t: checks.spine_complete(
    stg_stations(t).where("bundesland is not null").groupBy("bundesland").count().drop("count"), t.states, "bundesland"), """
    select bundesland, 'missing_from_mart' as violation, 0 as row_count from states
    where bundesland not in (select bundesland from stg_station where bundesland is not null)""")
REG.add("check_connector_provenance", lambda t: checks.connector_provenance(stg_points(t), stg_stations(t)), """
    select p.station_id, charging_point_id, connector_ordinal, p.source_system as connector_source_system, p.data_origin as connector_data_origin,
           external_id, s.source_system as station_source_system, s.data_origin as station_data_origin
    from stg_point p join stg_station s using (station_id)
    where p.source_system is distinct from s.source_system or p.data_origin is distinct from s.data_origin""")
REG.add("check_coordinates", lambda t: rounded(checks.outside_germany({
    "stg_charging_stations": (stg_stations(t), F.col("station_id"), F.col("external_id")),
    "stg_weather_observations": (weather(t), F.col("weather_observation_id"), F.col("weather_station_id")),
    "stg_traffic_events": (events(t), F.col("traffic_event_id"), F.coalesce("external_id", "title")),
    "stg_telemetry": (tele(t), F.col("telemetry_id"), F.col("vehicle_id"))})), " union all ".join(
    f"select '{m}' as source_model, {i}::varchar as entity_id, {l} as entity_label, round(latitude, 6) as latitude, round(longitude, 6) as longitude from {r} where not {_IN_DE}"
    for m, i, l, r in (
        ("stg_charging_stations", "station_id", "external_id", "stg_station"),
        ("stg_weather_observations", "weather_observation_id", "weather_station_id", "stg_weather"),
        ("stg_traffic_events", "traffic_event_id", "external_id", "stg_traffic"),
        ("stg_telemetry", "telemetry_id", "vehicle_id", "telemetry"))))


def _future(t: Tables):
    facts, trips = fct_telemetry(t), fct_trips(t)
    return checks.in_the_future([
        ("fct_vehicle_telemetry", "recorded_at", facts), ("fct_trips", "started_at", trips), ("fct_trips", "ended_at", trips)], FLEET_AT)


REG.add("check_no_future", _future, " union all ".join(
    f"select '{m}' as source_model, '{c}' as offending_field, vehicle_id as entity_id, trip_id, {c} as offending_timestamp, "
    f"round((epoch_us({c}) - epoch_us(timestamp '{FLEET_NOW}')) / 6e7, 2) as minutes_in_future from {r} "
    f"where {c} > timestamp '{FLEET_NOW}' + interval 2 minute"
    for m, c, r in (("fct_vehicle_telemetry", "recorded_at", "fct_telemetry_raw"), ("fct_trips", "started_at", "fct_trips_raw"),
                    ("fct_trips", "ended_at", "fct_trips_raw"))))
REG.add("check_orphan_segments", lambda t: checks.orphan_segments(staging.route_segments(t.route_segments), stg_routes(t)), """
    select 'missing_parent_route' as violation, route_segment_id, s.route_id, segment_ordinal, start_offset_km, segment_distance_km, null::double as route_distance_km
    from stg_segment s where route_id not in (select route_id from stg_route)
    union all select 'segment_starts_past_route_end', route_segment_id, s.route_id, segment_ordinal, start_offset_km, segment_distance_km, r.distance_km
    from stg_segment s join stg_route r using (route_id) where start_offset_m > r.distance_m * 1.01
    union all select 'segment_overruns_route_end', route_segment_id, s.route_id, segment_ordinal, start_offset_km, segment_distance_km, r.distance_km
    from stg_segment s join stg_route r using (route_id) where start_offset_m + segment_distance_m > r.distance_m * 1.01""")
REG.add("check_positive_power", lambda t: checks.positive_power(stg_points(t), stg_stations(t)), """
    select 'stg_charging_points' as source_model, 'power_kw' as offending_field, charging_point_id as entity_id, station_id, connector_ordinal, power_kw as offending_value
    from stg_point where power_kw <= 0
    union all select 'stg_charging_stations', 'max_power_kw', station_id, station_id, null, max_power_kw from stg_station where max_power_kw <= 0
    union all select 'stg_charging_stations', 'total_power_kw', station_id, station_id, null, total_power_kw from stg_station where total_power_kw <= 0""")
REG.add("check_soc_bounds", lambda t: checks.soc_bounds(fct_telemetry(t), fct_trips(t)), """
    select 'fct_vehicle_telemetry' as source_model, 'battery_soc_percent' as offending_field, vehicle_id as entity_id, trip_id, recorded_at as observed_at, battery_soc_percent as offending_value
    from telemetry where battery_soc_percent is null or battery_soc_percent not between 0 and 100
    union all select 'fct_trips', 'measured_start_soc_percent', vehicle_id, trip_id, started_at, measured_start_soc_percent from fct_trips_raw where measured_start_soc_percent not between 0 and 100
    union all select 'fct_trips', 'measured_end_soc_percent', vehicle_id, trip_id, coalesce(ended_at, started_at), measured_end_soc_percent from fct_trips_raw where measured_end_soc_percent not between 0 and 100""")
REG.add("check_energy_reconciles", lambda t: rounded(checks.energy_reconciles(fct_trips(t))), """
    select trip_id, vehicle_id, telemetry_point_count, anomalous_step_count, round(reported_energy_kwh, 6) as reported_energy_kwh,
           round(measured_energy_kwh, 6) as measured_energy_kwh, energy_divergence_kwh, energy_divergence_percent
    from fct_trips_raw where not is_running and telemetry_point_count > 0 and abs(energy_divergence_kwh) > 0.5
    and (reported_energy_kwh <= 0 or abs(energy_divergence_percent) > 5)""")
REG.add("source_freshness", lambda t: checks.source_freshness({
    "charging_stations": (t.charging_stations, "ingested_at", 7 * 24.0, 35 * 24.0),
    "weather_observations": (t.weather_observations, "observed_at", 2.0, 12.0),
    "traffic_events": (t.traffic_events, "ingested_at", 6.0, 24.0),
    "telemetry": (t.telemetry, "recorded_at", 0.25, 1.0)}, AS_OF.replace(tzinfo=dt.UTC)), " union all ".join(
    f"select '{n}' as table_name, max({c}) as newest_at, round((epoch_us(timestamp '{REGISTER_NOW}') - epoch_us(max({c}))) / 3.6e9, 3) as age_hours, "
    f"case when (epoch_us(timestamp '{REGISTER_NOW}') - epoch_us(max({c}))) / 3.6e9 > {e} then 'error' when (epoch_us(timestamp '{REGISTER_NOW}') - epoch_us(max({c}))) / 3.6e9 > {w} then 'warn' else 'pass' end as status from {n}"
    for n, c, w, e in (("charging_stations", "ingested_at", 168, 840), ("weather_observations", "observed_at", 2, 12),
                       ("traffic_events", "ingested_at", 6, 24), ("telemetry", "recorded_at", 0.25, 1))))
REG.add("load_gate", lambda t: checks.load_gate(t.ingestion_runs, F.lit("sha-7"), 500, 0.1).select("id", "reject_ratio", "verdict"), """
    select id, round(case when rows_received > 0 then rows_rejected / rows_received else 0 end, 6) as reject_ratio,
           case when source_file_sha256 = 'sha-7' then 'skip' when rows_accepted < 500 then 'too_few_rows'
                when rows_received > 0 and rows_rejected / rows_received > 0.1 then 'too_many_rejects' else 'publish' end as verdict from ingestion_runs""")
REG.add("weakest_mode", lambda t: t.ingestion_runs.groupBy("pipeline").agg(checks.weakest_mode("provider_mode").alias("mode")), """
    select pipeline, case max(case provider_mode when 'live' then 1 when 'cache' then 2 else 3 end) when 1 then 'live' when 2 then 'cache' else 'fixture' end as mode
    from ingestion_runs group by 1""")
# a silver table keeps what was accepted, the bronze table everything with its verdict
REG.add("bronze_silver_split", lambda t: checked_stations(t).groupBy("quality_status").agg(
    F.count("*").alias("bronze_rows"), F.count_if(F.col("quality_status") == "accepted").alias("silver_rows")), """
    select quality_status, count(*) as bronze_rows, count(*) filter (quality_status = 'accepted') as silver_rows from verdict_station group by 1""")
