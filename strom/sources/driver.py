"""Domain tables derived from the driver's tables.

One SQL text per table serves both engines: ``spark_sql`` builds the DataFrame, ``duck_ctes``
builds the same relation inside an oracle query. All derivations are integer arithmetic over whole
tables. ``@us``/``@ts``/``@div`` stand for the micros, timestamp and integer-division spellings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.session import configure
from strom.sources import reference

BASE_TABLES = ("events", "customer", "orders", "lineitem", "supplier", "part", "nation")

DAY0_US = 1704067200000000  # 2024-01-01 00:00 UTC
FLEET_NOW = "2024-01-15 00:00:00"
REGISTER_NOW = "2024-06-01 00:00:00"
TRAFFIC_NOW = "1998-08-01 00:00:00"

_STATE_CODES = "BWBYBEBBHBHHHEMVNINWRPSLSNSTSHTH"

_CLASS_BY_MOD = (
    "case {0} when 0 then 'motorway' when 1 then 'motorway' when 2 then 'trunk' when 3 then 'primary' "
    "when 4 then 'secondary' when 5 then 'residential' else 'unknown' end"
)


def _lat(key: str, i: str) -> str:
    return f"(47.8e0 + (({key} * 29) % 50) / 1e1 + ({i}) * 15 / 1e2 + ((({i}) * {key}) % 3) * 5 / 1e2)"


def _lon(key: str, i: str) -> str:
    return f"(6.5e0 + (({key} * 17) % 60) / 1e1 + ({i}) * 2 / 1e1 + ((({i}) * (({key}) + 1)) % 4) * 3 / 1e2)"


def _point_on_edge(fn, j: str) -> str:
    """Coordinate at quarter ``j`` of the 44 quarter-edges of a route line."""
    start, end = fn("route_key", f"({j}) @div 4"), fn("route_key", f"({j}) @div 4 + 1")
    return f"({start} + ({end} - {start}) * (({j}) % 4) / 4e0)"


# Base position of the last vertex falls on edge 11, so the formulas stay defined for i = 0..11.
TABLES: dict[str, str] = {
    "telemetry_base": f"""
        select event_id, user_id, event_type,
               cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k,
               cast(round(value * 100) as bigint) as c,
               (@us(ts) - {DAY0_US}) @div 259200000000 as trip_no,
               (@us(ts) - {DAY0_US}) % 259200000000 as within_us
        from {{events}}""",
    "telemetry": f"""
        select event_id as telemetry_id,
               'V' || cast(user_id as string) as vehicle_id,
               case when event_id % 41 <> 0
                    then 'V' || cast(user_id as string) || '-' || cast(trip_no as string) end as trip_id,
               'R' || cast((user_id + trip_no) % 25 as string) as route_id,
               @ts({DAY0_US} + trip_no * 259200000000 + within_us @div 1440) as recorded_at,
               case when event_id % 211 = 0 then 60.5e0
                    else 47.6e0 + ((user_id * 37 + (within_us @div 3600000000) * 3 + k) % 7200) / 1e3 end as latitude,
               6.2e0 + ((user_id * 53 + (within_us @div 3600000000) * 5 + k) % 8500) / 1e3 as longitude,
               (c % 18000) / 1e2 as speed_kmh,
               ((event_id * 7 + k) % 61 - 30) / 1e1 as acceleration_ms2,
               (k * 36 % 3600) / 1e1 as heading_deg,
               case when event_id % 97 = 0 then null when event_id % 101 = 0 then 104.5e0
                    else 95e0 - (within_us @div 3600000000) - (k % 5) / 1e1 end as battery_soc_percent,
               15e0 + (k % 200) / 1e1 - ((event_id % 7) * 3) as battery_temperature_c,
               ((event_id * 13 + k) % 470) / 1e1 - 12e0 as outside_temperature_c,
               (c % 9000) / 1e2 - 20e0 as instantaneous_power_kw,
               case when event_id % 53 = 0 then null else 10e0 + (k % 25) / 1e0 + (user_id % 10) / 1e1 end
                   as energy_consumption_kwh_100km,
               (within_us @div 1000000) * (15 + user_id % 10) / 8.641e6
                   - case when event_id % 37 = 0 then 0.25e0 else 0e0 end as cumulative_energy_kwh,
               380e0 - (within_us @div 3600000000) * 4 as estimated_range_km,
               {_CLASS_BY_MOD.format("(user_id + within_us @div 3600000000) % 7")} as road_class,
               case when event_id % 5 = 0 then null when event_id % 5 = 1 then 50e0 when event_id % 5 = 2 then 80e0
                    when event_id % 5 = 3 then 100e0 else 130e0 end as speed_limit_kmh,
               user_id * 1e3 + trip_no * 5e4 + (within_us @div 86400000)
                   - case when event_id % 37 = 0 then 1500 else 0 end as odometer_m,
               case event_type when 'error' then 'charging' when 'signup' then 'parked' else 'driving' end as state,
               'simulated' as data_origin,
               @ts({DAY0_US} + trip_no * 259200000000 + within_us @div 1440 + (event_id % 600) * 1000000) as ingested_at
        from {{telemetry_base}}""",
    "vehicles": """
        select 'veh-' || cast(user_id as string) as id, 'V' || cast(user_id as string) as vehicle_id,
               case when user_id % 23 = 0 then null else 'vm-' || cast(user_id % 5 as string) end as vehicle_model_id,
               'run-' || cast(user_id % 3 as string) as simulation_run_id,
               case user_id % 4 when 0 then 'idle' when 1 then 'charging' else 'driving' end as state,
               'simulated' as data_origin
        from {events} group by user_id""",
    "trips": """
        select 'trip-' || trip_id as id, trip_id, replace(min(vehicle_id), 'V', 'veh-') as vehicle_id,
               min(route_id) as route_id, min(recorded_at) as started_at,
               case when count(*) % 5 = 0 then null else max(recorded_at) end as ended_at,
               max(battery_soc_percent) as start_soc_percent, min(battery_soc_percent) as end_soc_percent,
               (max(odometer_m) - min(odometer_m)) * (1e0 + (count(*) % 7) / 1e2) as distance_m,
               (max(cumulative_energy_kwh) - min(cumulative_energy_kwh)) * (1e0 + (count(*) % 7) * 2 / 1e1) as energy_kwh,
               avg(energy_consumption_kwh_100km) as avg_consumption_kwh_100km,
               case when count(*) % 5 = 0 then 'driving' else 'finished' end as state,
               'simulator' as source, trip_id as source_identifier, 'simulated' as data_origin,
               max(ingested_at) as ingested_at
        from {telemetry} where trip_id is not null group by trip_id""",
    "charging_stations": f"""
        select 'S' || cast(c_custkey as string) as id, 'EXT-' || cast(c_custkey as string) as external_id,
               case when c_custkey % 13 = 0 then '  ' else ' ' || c_mktsegment || ' ' end as operator,
               'Strasse ' || cast(c_custkey % 90 as string) as street,
               case when c_custkey % 7 = 0 then '' else cast(c_custkey % 120 as string) end as house_number,
               case when c_custkey % 29 = 0 then ' ' else cast((c_custkey * 31) % 99999 as string) end as postal_code,
               'Ort ' || cast(c_custkey % 40 as string) as city,
               case when c_nationkey % 18 in (3, 16, 17) then null
                    else substr('{_STATE_CODES}', cast((c_nationkey % 18) * 2 + 1 as int), 2) end as bundesland,
               'de ' as country,
               47.3e0 + ((c_custkey * 7919) % 7700) / 1e3 as latitude,
               5.9e0 + ((c_custkey * 4729) % 9100) / 1e3
                   + case when c_custkey % 199 = 0 then 12 else 0 end as longitude,
               case when c_custkey % 19 = 0 then null
                    else date '2009-01-01' + cast((c_custkey * 17) % 5800 as int) end as commissioned_on,
               cast(c_custkey % 8 + 1 as int) as charging_points_count,
               case when c_custkey % 307 = 0 then 0e0 when c_acctbal < 0 then null
                    else (cast(round(c_acctbal * 100) as bigint) % 3500) / 1.01e1 + 3.7e0 end as max_power_kw,
               case when c_custkey % 11 = 0 or c_acctbal < 0 then null
                    else (cast(round(c_acctbal * 100) as bigint) % 3500) / 1.01e1 * (c_custkey % 8 + 1) end as total_power_kw,
               case when c_custkey % 3 = 0 then 'fast' when c_custkey % 3 = 1 then 'normal' else 'ultra_fast' end
                   as charging_category,
               c_acctbal > 5000 as is_fast_charger,
               'register' as source, 'EXT-' || cast(c_custkey as string) as source_identifier,
               'official' as data_origin,
               @ts({DAY0_US} + (c_custkey % 8640000) * 1000000) as ingested_at
        from {{customer}}""",
    "charging_points": f"""
        select 'P' || cast(o_orderkey as string) as id, 'S' || cast(o_custkey as string) as station_id,
               cast(o_orderkey as int) as ordinal,
               case o_orderkey % 6 when 0 then 'ccs' when 1 then 'type2' when 2 then 'chademo' when 3 then 'schuko'
                    when 4 then 'ccs' else 'unknown' end as connector_type,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'dc' else 'ac' end as current_type,
               case when o_orderkey % 17 = 0 then null when o_orderkey % 401 = 0 then 0e0
                    else (cast(round(o_totalprice * 100) as bigint) % 3200) / 1.01e1 + 3.7e0 end as power_kw,
               case when o_orderkey % 4 = 0 then ' ' else 'key' || cast(o_orderkey as string) end as public_key,
               case when o_orderkey % 503 = 0 then 'manual' else 'register' end as source,
               'official' as data_origin
        from {{orders}}""",
    "route_base": """
        select 'R' || cast(n_nationkey as string) as route_id, cast(n_nationkey as bigint) as route_key, true as is_demo
        from {nation}
        union all
        select 'Q' || cast(s_suppkey as string), s_suppkey + 25, false from {supplier}""",
    "routes": f"""
        select route_id as id, case when route_key % 31 = 30 then ' ' else 'slug-' || route_id end as slug,
               ' Route ' || route_id as name, 'Start ' || route_id as origin_name, 'Ziel ' || route_id as destination_name,
               {_lat("route_key", "0")} as origin_latitude, {_lon("route_key", "0")} as origin_longitude,
               {_lat("route_key", "11")} as destination_latitude, {_lon("route_key", "11")} as destination_longitude,
               264e3 + (route_key % 13) * 1e3 as distance_m, 9e3 + (route_key % 17) * 1e2 as duration_s,
               'driving' as routing_profile, is_demo, 'router' as source, 'official' as data_origin, route_key
        from {{route_base}}""",
    "route_vertices": f"""
        select route_id, route_key, is_demo, i as ordinal, {_lat("route_key", "i")} as latitude, {_lon("route_key", "i")} as longitude
        from (select route_id, route_key, is_demo, @explode12 as i from {{route_base}}) v""",
    "route_segments": f"""
        select 'G' || cast(route_key as string) || '-' || cast(j as string) as id,
               case when route_key % 40 = 39 and j = 3 then 'R-gone' else route_id end as route_id,
               cast(j as int) as ordinal,
               {_point_on_edge(_lat, "j")} as lat0, {_point_on_edge(_lon, "j")} as lon0,
               {_point_on_edge(_lat, "j + 1")} as lat1, {_point_on_edge(_lon, "j + 1")} as lon1,
               j * 6e3 + case when route_key % 40 = 38 and j = 43 then 2e4 else 0e0 end as start_offset_m,
               6e3 + ((j * 7 + route_key) % 5) * 50e0 as distance_m,
               {_CLASS_BY_MOD.format("(j @div 3 + route_key) % 7")} as road_class,
               case when (j + route_key) % 6 = 0 then null else 50e0 + ((j + route_key) % 5) * 20 end as speed_limit_kmh,
               case when (j + route_key) % 19 = 0 then null else 45e0 + ((j * 3 + route_key) % 9) * 10 end as assumed_speed_kmh,
               ((j * 13 + route_key * 7) % 121 - 60) / 1e0 as elevation_gain_m,
               case when (j + route_key) % 11 = 0 then null else ((j * 17 + route_key * 5) % 480) / 1e1 - 12 end as temperature_c,
               case (j + route_key) % 6 when 0 then 'low' when 1 then 'moderate' when 2 then 'high' when 3 then 'severe'
                    else null end as traffic_severity,
               case when (j + route_key) % 17 = 0 then null else 11e0 + ((j * 5 + route_key) % 120) / 1e1 end as predicted_kwh_per_100km,
               case when (j + route_key) % 17 = 0 then null else 0.6e0 + ((j * 5 + route_key) % 120) / 2e2 end as predicted_kwh,
               case when (j + route_key) % 17 = 0 then null else 'medium' end as energy_intensity,
               is_demo, route_key
        from (select route_id, route_key, is_demo, @explode44 as j from {{route_base}}) v""",
    "route_steps": """
        select route_id, cast(j as int) as step_no, j * 9200e0 as step_start_m, (j + 1) * 9200e0 as step_end_m, 9200e0 as distance_m,
               case when (j + route_key) % 13 = 0 then 0e0 else 300e0 + ((j * 11 + route_key) % 17) * 25 end as duration_s,
               case (j * 3 + route_key) % 6 when 0 then 'A ' || cast(j % 9 as string) when 1 then 'B 27; A 8' when 2 then 'K 12'
                    when 3 then 'L 4, B 10' when 4 then null else 'S 9' end as ref,
               case when (j + route_key) % 4 = 0 then null else 60e0 + ((j + route_key) % 5) * 10 end as speed_limit_kmh
        from (select route_id, route_key, @explode30 as j from {route_base}) v""",
    "traffic_events": f"""
        select 'T' || cast(o_orderkey as string) as id, 'TX-' || cast(o_orderkey as string) as external_id,
               case o_orderkey % 5 when 0 then 'roadworks' when 1 then 'closure' when 2 then 'accident'
                    when 3 then 'congestion' else 'warning' end as event_type,
               case o_orderpriority when '1-URGENT' then 'severe' when '2-HIGH' then 'high' when '3-MEDIUM' then 'moderate'
                    else 'low' end as severity,
               case when o_orderkey % 9 = 0 then null when o_orderkey % 10 = 0 then '  '
                    else ' a' || cast(o_custkey % 12 + 1 as string) || ' ' end as road_name,
               case when o_orderkey % 6 = 0 then '' else 'Richtung ' || cast(o_orderkey % 4 as string) end as direction,
               'Meldung ' || cast(o_orderkey as string) as title, ' ' as description,
               47.5e0 + ((o_orderkey * 6131) % 7300) / 1e3
                   + case when o_orderkey % 601 = 0 then 9 else 0 end as latitude,
               6.0e0 + ((o_orderkey * 3571) % 9000) / 1e3 as longitude,
               case when o_orderkey % 2 = 1 then 47.5e0 + ((o_orderkey * 6131) % 7300) / 1e3 + 3 / 1e2 end as extent_latitude,
               case when o_orderkey % 2 = 1 then 6.0e0 + ((o_orderkey * 3571) % 9000) / 1e3 + 4 / 1e2 end as extent_longitude,
               case when o_orderkey % 23 = 0 then null else @ts(@us(o_orderdate)) end as starts_at,
               case when o_orderkey % 4 = 0 then null
                    else @ts(@us(o_orderdate) + (o_orderkey % 90) * 86400000000) end as ends_at,
               o_orderstatus = 'F' as is_blocked,
               case when o_orderkey % 3 <> 0 then null
                    else (cast(round(o_totalprice * 100) as bigint) % 600) / 1e1 end as delay_minutes,
               case when o_orderkey % 8 = 0 then 'police' else 'autobahn' end as source, 'official' as data_origin,
               @ts(@us(o_orderdate) + 3600000000) as ingested_at
        from {{orders}}""",
    "weather_stations": """
        select 'W' || cast(s_suppkey as string) as id, cast(10000 + s_suppkey as string) as dwd_station_id,
               'Station ' || cast(s_suppkey as string) as name,
               47.4e0 + ((s_suppkey * 811) % 7500) / 1e3 as latitude, 6.0e0 + ((s_suppkey * 1217) % 8900) / 1e3 as longitude,
               (s_suppkey * 37) % 1500 / 1e0 as elevation_m
        from {supplier}""",
    "weather_observations": f"""
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                   || '-' || cast(l_suppkey as string) as id,
               'W' || cast(l_suppkey as string) as weather_station_id,
               @ts(@us(l_shipdate) + (l_linenumber * 10 + (l_orderkey % 6) * 60) * 60000000) as observed_at,
               47.4e0 + ((l_suppkey * 811) % 7500) / 1e3 as latitude, 6.0e0 + ((l_suppkey * 1217) % 8900) / 1e3 as longitude,
               case when l_partkey % 29 = 0 then -999e0 else l_quantity - 12 end as temperature_c,
               case when l_partkey % 31 = 0 then -999e0 when l_partkey % 3 = 0 then 0e0 else abs(l_discount) * 20 end as precipitation_mm,
               case when l_partkey % 37 = 0 then -999e0 else abs(l_tax) * 300 end as wind_speed_ms,
               abs(l_tax) * 450 as wind_gust_ms,
               case when l_partkey % 41 = 0 then -999e0 else 40e0 + l_partkey % 61 end as humidity_percent,
               990e0 + l_orderkey % 50 as pressure_hpa,
               case l_returnflag when 'A' then 'clear' when 'N' then 'rain' else 'clouds' end as condition,
               'dwd' as source, 'official' as data_origin
        from {{lineitem}}""",
    "ingestion_runs": f"""
        select 'run-' || cast(p_partkey as string) as id,
               case p_partkey % 6 when 0 then 'register' when 1 then 'weather' when 2 then 'traffic' when 3 then 'routing'
                    when 4 then 'geocoder' else 'simulator' end as source,
               case p_partkey % 6 when 0 then 'charging' when 1 then 'weather' when 2 then 'traffic' when 3 then 'routes'
                    when 4 then 'places' else 'simulation' end as pipeline,
               @ts({DAY0_US} + ((p_partkey * 577) % 40000) * 60000000 + p_partkey) as started_at,
               case when p_partkey % 7 = 0 then null
                    else @ts({DAY0_US} + ((p_partkey * 577) % 40000) * 60000000 + p_partkey + p_size * 1000000) end as finished_at,
               case when p_partkey % 7 = 0 then 'running' when p_partkey % 11 = 0 then 'failed'
                    when p_partkey % 13 = 0 then 'partial' else 'succeeded' end as status,
               case p_partkey % 9 when 0 then 'fixture' when 4 then 'cache' else 'live' end as provider_mode,
               cast(case when p_partkey % 17 = 0 then 0 else p_size * 100 end as bigint) as rows_received,
               cast(case when p_partkey % 17 = 0 then 0 else p_size * 100 - p_partkey % 40 end as bigint) as rows_accepted,
               cast(case when p_partkey % 17 = 0 then 0 else p_partkey % 40 end as bigint) as rows_rejected,
               'sha-' || cast(p_partkey % 50 as string) as source_file_sha256,
               cast(case when p_partkey % 17 = 0 then 0 else p_partkey % 5 end as bigint) as rows_duplicate,
               case when p_partkey % 3 = 0 then 'https://data.example/' || cast(p_partkey % 6 as string) end as source_url,
               case when p_partkey % 11 = 0 then 'TimeoutError: no answer' end as error_message
        from {{part}}""",
    # one analysis request per customer: which corridor, which vehicle, with how much charge
    "requests": """
        select c_custkey as request_id, 'R' || cast(c_nationkey as string) as route_id,
               'vm-' || cast(c_custkey % 5 as string) as vehicle_model_id,
               35e0 + (c_custkey * 7) % 66 as start_soc_percent
        from {customer}""",
}

# line geometry lives in the row as an array of vertices; the oracles use the plain coordinates
GEOMETRY = {
    "routes": "transform(sequence(0L, 11L), i -> named_struct('ordinal', cast(i as int), "
    f"'latitude', {_lat('route_key', 'i')}, 'longitude', {_lon('route_key', 'i')}))",
    "route_segments": "array(named_struct('ordinal', 0, 'latitude', lat0, 'longitude', lon0), "
    "named_struct('ordinal', 1, 'latitude', lat1, 'longitude', lon1))",
    "traffic_events": "case when extent_latitude is not null then array("
    "named_struct('ordinal', 0, 'latitude', latitude, 'longitude', longitude), "
    "named_struct('ordinal', 1, 'latitude', extent_latitude, 'longitude', extent_longitude)) end",
}

_SPARK = {
    "@us(": "unix_micros(",
    "@ts(": "timestamp_micros(",
    "@div": "div",
    "@explode12": "explode(sequence(0L, 11L))",
    "@explode44": "explode(sequence(0L, 43L))",
    "@explode30": "explode(sequence(0L, 29L))",
}
_DUCK = {
    "@us(": "epoch_us(",
    "@ts(": "make_timestamp(",
    "@div": "//",
    "@explode12": "unnest(range(12))",
    "@explode44": "unnest(range(44))",
    "@explode30": "unnest(range(30))",
}
_TIME_COLUMNS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def _render(text: str, dialect: dict[str, str]) -> str:
    for token, spelling in dialect.items():
        text = text.replace(token, spelling)
    return text


def references(text: str, names) -> list[str]:
    """The names from ``names`` that occur as words in ``text``, in the order of ``names``."""
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in names if name in words]


class Tables:
    """The domain tables of one data folder, each built lazily from the driver's files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            column = _TIME_COLUMNS.get(name)
            return df.withColumn(column, F.col(column).cast("timestamp")) if column else df
        if name == "vehicle_models":
            return reference.vehicle_models(self.spark)
        if name == "states":
            return reference.states(self.spark)
        if name not in TABLES:
            raise AttributeError(name)
        text = _render(TABLES[name], _SPARK)
        inputs = set(re.findall(r"\{([a-z_]+)\}", text))
        df = self.spark.sql(text, **{key: getattr(self, key) for key in inputs})
        return df.withColumn("geometry", F.expr(GEOMETRY[name])) if name in GEOMETRY else df


def duck_ctes() -> dict[str, str]:
    """Oracle spelling of every derived table, in dependency order."""
    ctes = {
        name: re.sub(r"\{([a-z_]+)\}", r"\1", _render(text, _DUCK)).replace("as string)", "as varchar)")
        for name, text in TABLES.items()
    }
    return {**reference.duck_ctes(), **ctes}
