"""Queries and oracles: text parsing, feed readers, lake writes, upserts.

Source texts are built from the given tables in the sources' own formats, written where a feed is a
file, and parsed back; the oracles know the values the texts were built from.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strom.functions import text_de
from strom.operators import quality as q
from strom.operators import upsert
from strom.operators.buckets import BucketTable
from strom.plans import routes as R
from strom.plans import staging
from strom.plans import trips as trip_plans
from strom.plans.trips import rounded
from strom.registry.fleet_models import models
from strom.registry.oracle import Registry, relation
from strom.registry.quality import checked_stations
from strom.registry.stations import stg_points, stg_stations
from strom.session import checkpoint_root, reuse
from strom.sources import feeds, lake
from strom.sources.driver import TRAFFIC_NOW, Tables

REG = Registry()
AT = dt.datetime.fromisoformat(TRAFFIC_NOW).replace(tzinfo=dt.UTC)


def folder(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/strom-{name}-{uuid.uuid4().hex}"


def cases(column: str, values: list) -> str:
    """SQL case over ``column % n`` listing literal values."""
    body = " ".join(f"when {i} then {'null' if v is None else repr(v) if not isinstance(v, str) else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"case {column} % {len(values)} {body} end"


# ---- numbers and dates
_CENTS = "cast(round(c_acctbal * 100) as bigint)"
_DECIMAL_TEXT = f"""case when c_custkey % 17 = 0 then 'k.A.' when {_CENTS} < 0 then '-' || cast(-{_CENTS} as string)
    when {_CENTS} >= 100000 then cast({_CENTS} div 100000 as string) || '.' || lpad(cast(({_CENTS} div 100) % 1000 as string), 3, '0') || ',' || lpad(cast({_CENTS} % 100 as string), 2, '0')
    when c_custkey % 2 = 0 then cast({_CENTS} div 100 as string) || '.' || lpad(cast({_CENTS} % 100 as string), 2, '0')
    else cast({_CENTS} div 100 as string) || ',' || lpad(cast({_CENTS} % 100 as string), 2, '0') end"""
REG.add("parse_decimal_de", lambda t: t.customer.select("c_custkey", text_de.parse_decimal(F.expr(_DECIMAL_TEXT)).alias("value")),
        "select c_custkey, case when c_custkey % 17 <> 0 and c_acctbal >= 0 then round(c_acctbal * 100) / 100 end as value from customer")
_DMY = "lpad(cast(day(o_orderdate) as string), 2, '0') || '.' || lpad(cast(month(o_orderdate) as string), 2, '0') || '.' || cast(year(o_orderdate) as string)"
REG.add("parse_date_de", lambda t: t.orders.select("o_orderkey", text_de.parse_date(F.expr(
    f"case o_orderkey % 19 when 0 then '31.02.2024' when 1 then '' else {_DMY} end")).alias("value")),
    "select o_orderkey, case when o_orderkey % 19 > 1 then o_orderdate::date end as value from orders")
_STAMP = "cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as string) || lpad(cast(l_linenumber as string), 2, '0')"
REG.add("parse_mess_datum", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text_de.parse_mess_datum(F.expr(
    f"case l_linenumber % 3 when 0 then {_STAMP} || '30' when 1 then ' ' || {_STAMP} else '20240230' end")).alias("value")), """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_linenumber % 3 when 0 then l_shipdate + to_minutes(l_linenumber * 60 + 30)
           when 1 then l_shipdate + to_minutes(l_linenumber * 60) end as value from lineitem""")
REG.add("parse_iso", lambda t: t.orders.select("o_orderkey", text_de.parse_iso(F.expr("""case o_orderkey % 4
    when 0 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") when 1 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    when 2 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") else 'bald' end""")).alias("value")), """
    select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate when 1 then o_orderdate - interval 2 hour when 2 then o_orderdate end as value from orders""")
REG.add("format_de", lambda t: t.customer.select("c_custkey", text_de.format_number(F.col("c_acctbal"), 2).alias("value")),
        "select c_custkey, replace(printf('%.2f', c_acctbal), '.', ',') as value from customer")

# ---- names and codes
_PLUGS = ["AC Steckdose Typ 2", "DC Kupplung Combo", "DC CHAdeMO", "AC Schuko", "AC CEE 5 polig", "TYP-2", "Tesla Supercharger", "k.A. unbekannt", "Unbekannt", "", "Typ 1", "DC CCS2 (Mennekes)"]
_PLUG_KIND = ["type2", "ccs", "chademo", "schuko", "cee", "type2", "tesla", "other", "unknown", "unknown", "other", "ccs"]
_PLUG_CURRENT = ["ac", "dc", "dc", "ac", "ac", "ac", "unknown", "unknown", "unknown", "unknown", "unknown", "dc"]


def _plugs(t: Tables):
    raw = F.expr(cases("o_orderkey", _PLUGS))
    kind = text_de.connector_type(raw)
    return t.orders.select("o_orderkey", kind.alias("connector_type"), text_de.current_type(raw, kind).alias("current_type"))


REG.add("connector_type", _plugs, f"select o_orderkey, {cases('o_orderkey', _PLUG_KIND)} as connector_type, {cases('o_orderkey', _PLUG_CURRENT)} as current_type from orders")
_PLACES = ["Baden-Württemberg", "DE-BW", " bavaria ", "NRW", "Thueringen", "Freie und Hansestadt Hamburg", "Atlantis", "", "Sachsen Anhalt", "de by", "Mecklenburg Vorpommern", None]
_PLACE_CODES = ["BW", "BW", "BY", "NW", "TH", "HH", None, None, "ST", "BY", "MV", None]
REG.add("state_code", lambda t: t.customer.select("c_custkey", text_de.state_code(F.expr(cases("c_custkey", _PLACES))).alias("code")),
        f"select c_custkey, {cases('c_custkey', _PLACE_CODES)} as code from customer")
_TAGS = ["motorway", "motorway_link", " Trunk ", "primary_link", "living_street", "track", "footway", None, "unclassified", "service"]
_TAG_CLASS = ["motorway", "motorway", "trunk", "primary", "residential", "service", "unknown", "unknown", "residential", "service"]
REG.add("road_class_from_osm", lambda t: t.part.select("p_partkey", R.road_class_from_osm(F.expr(cases("p_partkey", _TAGS))).alias("road_class")),
        f"select p_partkey, {cases('p_partkey', _TAG_CLASS)} as road_class from part")
REG.add("synthetic_id", lambda t: t.customer.select("c_custkey", text_de.synthetic_id("c_name", "c_mktsegment", "c_nationkey").alias("id")),
        "select c_custkey, substr(sha256(c_name || chr(0) || c_mktsegment || chr(0) || c_nationkey::varchar), 1, 32) as id from customer")
_KIND_CELLS = ["AC Typ 2; DC Combo", "DC CHAdeMO", "", "AC Typ 2;AC Schuko ;"]
_POWER_CELLS = ["11; 3,7", "50", "22", "11"]


def _explode(t: Tables):
    cells = t.part.select(
        "p_partkey", *(F.expr(cases(f"(p_partkey + {i})", _KIND_CELLS)).alias(f"k{i}") for i in (1, 2)),
        *(F.expr(cases(f"(p_partkey + {i})", _POWER_CELLS)).alias(f"w{i}") for i in (1, 2)), F.lit("pk").alias("y1"), F.lit("").alias("y2"))
    return cells.select("p_partkey", F.posexplode(text_de.connectors([("k1", "w1", "y1"), ("k2", "w2", "y2")])).alias("at", "c")).select(
        "p_partkey", (F.col("at") + 1).alias("ordinal"), "c.connector_type", "c.current_type", "c.power_kw", "c.public_key")


def _cell(i: int) -> str:
    rows = {0: (("type2", "ac", 11.0), ("ccs", "dc", 3.7)), 1: (("chademo", "dc", 50.0),), 2: (("unknown", "unknown", 22.0),), 3: (("type2", "ac", 11.0), ("schuko", "ac", 11.0))}[i]
    return "[" + ", ".join(f"{{'k': '{k}', 'c': '{c}', 'w': {w}::double}}" for k, c, w in rows) + "]"


_LISTS = " ".join(f"when {i} then {_cell(i)}" for i in range(4))
REG.add("explode_connectors", _explode, f"""
    select p_partkey, (generate_subscripts(l, 1))::int as ordinal, unnest(l).k as connector_type, unnest(l).c as current_type, unnest(l).w as power_kw,
           case when generate_subscripts(l, 1) <= n1 then 'pk' end as public_key
    from (select p_partkey, list_concat(a, b) as l, len(a) as n1 from (select p_partkey, case (p_partkey + 1) % 4 {_LISTS} end as a, case (p_partkey + 2) % 4 {_LISTS} end as b from part))""")

# ---- traffic messages: winter dates are one hour, summer dates two hours ahead of UTC
_D1, _D2 = "lpad(cast(o_orderkey % 27 + 1 as string), 2, '0')", "lpad(cast(o_orderkey % 27 + 2 as string), 2, '0')"
_MONTH, _YEAR = "case when o_orderkey % 2 = 0 then '01' else '07' end", "cast(24 + o_orderkey % 5 as string)"
_BODY = f"""case o_orderkey % 5
    when 0 then 'A5: Baustelle' || chr(10) || 'Beginn: ' || {_D1} || '.' || {_MONTH} || '.' || {_YEAR} || ' um 05:30 Uhr' || chr(10) || 'Ende: ' || {_D2} || '.' || {_MONTH} || '.20' || {_YEAR} || ' um 20:00 Uhr'
    when 1 then 'Phase ' || {_D1} || '.' || {_MONTH} || '.' || {_YEAR} || ' 19:30 bis zum ' || {_D2} || '.' || {_MONTH} || '.' || {_YEAR} || ' 05:00 Uhr.'
    when 2 then 'Jeden Montag zwischen dem ' || {_D1} || '.' || {_MONTH} || '.' || {_YEAR} || ' und dem ' || {_D2} || '.' || {_MONTH} || '.' || {_YEAR} || ' gesperrt'
    when 3 then 'Ende: 31.02.26 um 10:00 Uhr' else 'Stau (Ende der Gesamtmassnahme: 30.09.26)' end"""


def _validity(t: Tables):
    starts, ends = text_de.extract_validity(F.col("body"))
    return t.orders.select("o_orderkey", F.expr(_BODY).alias("body")).select("o_orderkey", starts.alias("starts_at"), ends.alias("ends_at"))


def _moment(day: str, hour: str, minute: int) -> str:
    return f"make_timestamp(2024 + o_orderkey % 5, case when o_orderkey % 2 = 0 then 1 else 7 end, {day}, {hour}, {minute}, 0) - to_hours(case when o_orderkey % 2 = 0 then 1 else 2 end)"


_FIRST, _NEXT = "o_orderkey % 27 + 1", "o_orderkey % 27 + 2"
REG.add("extract_validity", _validity, f"""
    select o_orderkey, case o_orderkey % 5 when 0 then {_moment(_FIRST, '5', 30)} when 1 then {_moment(_FIRST, '19', 30)} when 2 then {_moment(_FIRST, '0', 0)} end as starts_at,
           case o_orderkey % 5 when 0 then {_moment(_NEXT, '20', 0)} when 1 then {_moment(_NEXT, '5', 0)} when 2 then {_moment(_NEXT, '0', 0)} end as ends_at from orders""")
_SERVICE, _ABNORMAL = cases("o_orderkey", ["roadworks", "closure", "warning"]), cases("(o_orderkey div 3)", [None, "queuing_traffic", "STATIONARY_TRAFFIC", "", "OTHER"])
_CLOSED = "(o_orderkey div 15) % 2 = 0"


def _severity(t: Tables):
    service, abnormal = F.expr(_SERVICE), F.expr(_ABNORMAL)
    symbols = F.expr(f"case when {_CLOSED} then array('CLOSED', 'LANE') else array('LANE') end")
    display = F.expr("case when (o_orderkey div 30) % 2 = 0 then 'SHORT_TERM_ROADWORKS' else 'ROADWORKS' end")
    return t.orders.select("o_orderkey", text_de.severity(service, display, symbols, abnormal).alias("severity"),
                           text_de.event_type(service, abnormal).alias("event_type"))


REG.add("traffic_severity", _severity, f"""
    select o_orderkey, case when a = 'queuing_traffic' then 'high' when a = 'STATIONARY_TRAFFIC' then 'severe' when s = 'closure' then case when c then 'severe' else 'high' end
           when s = 'roadworks' then case when c then 'high' when short_ then 'low' else 'moderate' end when c then 'high' else 'low' end as severity,
           case when s <> 'warning' then s when a <> '' then 'congestion' else 'warning' end as event_type
    from (select o_orderkey, {_SERVICE} as s, {_ABNORMAL.replace(' div ', ' // ')} as a, {_CLOSED.replace(' div ', ' // ')} as c, (o_orderkey // 30) % 2 = 0 as short_ from orders)""")

# ---- weather values
_W = ("temperature_c", "precipitation_mm", "wind_speed_ms", "humidity_percent")
REG.add("weather_condition", lambda t: staging.weather_observations(t.weather_observations).select(
    "weather_observation_id", text_de.weather_condition(*(F.col(c) for c in _W)).alias("condition")), """
    select weather_observation_id, case when wind_speed_ms >= 17.2 then 'storm' when precipitation_mm >= 0.1 and temperature_c <= 0.5 then 'snow' when precipitation_mm >= 0.1 then 'rain'
           when humidity_percent >= 98 then 'fog' when humidity_percent >= 85 then 'clouds' when coalesce(humidity_percent, temperature_c, precipitation_mm) is not null then 'clear' else 'unknown' end as condition
    from stg_weather""")
_M = "case l_linenumber % 5 when 0 then '   -999' when 1 then ' ' when 2 then 'x' else '  ' || cast(cast(l_quantity * 4 - 50 as int) as string) end"
REG.add("measurement", lambda t: t.lineitem.select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text_de.measurement(F.expr(_M)).alias("value"), text_de.humidity(F.expr(_M)).alias("humidity"),
    text_de.pressure(F.expr(_M)).alias("pressure")), """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, v as value, case when v is not null then greatest(0, least(100, v)) end as humidity, case when v > 0 then v end as pressure
    from (select *, case when l_linenumber % 5 >= 3 then l_quantity * 4 - 50 end as v from lineitem)""")

# ---- files
_ROWS_PER_EDITION = 5_000


def register_files(t: Tables) -> str:
    """Register editions as CSV files: preamble, header, one quoted row per customer; some rows cut short."""
    path = folder(t, "register")
    cell = {
        "Ladeeinrichtungs-ID": "case when c_custkey % 5 = 0 then '' else 'ID' || cast(c_custkey as string) end",
        "Betreiber": """'"' || c_mktsegment || chr(10) || 'GmbH; Co"'""", "Anzahl Ladepunkte": "'2'", "Art der Ladeeinrichtung": "'Normal'",
        "Nennleistung Ladeeinrichtung [kW]": f"case when {_CENTS} >= 0 then cast({_CENTS} div 100 as string) || ',' || lpad(cast({_CENTS} % 100 as string), 2, '0') else '' end",
        "Inbetriebnahmedatum": "lpad(cast(c_custkey % 28 + 1 as string), 2, '0') || '.03.2021'", "Straße": "'Weg'", "Hausnummer": "cast(c_custkey as string)",
        "Postleitzahl": "lpad(cast(c_custkey % 99999 as string), 5, '0')", "Ort": "'Ort'", "Bundesland": f"({cases('c_custkey', [p or '' for p in _PLACES])})",
        "Breitengrad": "'50,' || lpad(cast(c_custkey % 1000 as string), 3, '0')", "Längengrad": "'8,' || lpad(cast(c_custkey % 500 as string), 3, '0')",
        "Steckertypen1": f"""'"' || ({cases('c_custkey', _KIND_CELLS)}) || '"'""", "Nennleistung Stecker1": f"""'"' || ({cases('c_custkey', _POWER_CELLS)}) || '"'""", "Public Key6": "'k'",
    }
    line = " || ';' || ".join(f"({cell.get(c, chr(39) * 2)})" for c in feeds.REGISTER_COLUMNS)
    row = f"case when c_custkey % 97 = 13 then 'ID' || cast(c_custkey as string) || ';nur zwei' else {line} end"
    head = "\n".join(["﻿Ladesäulenregister", "Letzte Aktualisierung vom: 01.09.2026", *["Hinweis;;"] * 8, ";".join(feeds.REGISTER_COLUMNS)])
    editions = t.customer.select((F.floor(F.col("c_custkey") / _ROWS_PER_EDITION)).alias("edition"), "c_custkey", F.expr(row).alias("row")).groupBy("edition").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda r: r.row), "\n").alias("body"))  # bounded rows per file
    editions.select("edition", F.concat(F.lit(head + "\n"), "body", F.lit("\n;;\n")).alias("value")).write.partitionBy("edition").text(path)
    return path


def _register(t: Tables) -> tuple[DataFrame, DataFrame]:
    return feeds.read_register_csv(t.spark, register_files(t))


def _register_stations(t: Tables):
    sites = feeds.register_stations(_register(t)[0])
    kinds = F.array_join(F.transform("points", lambda p: F.concat_ws("/", p.connector_type, p.current_type)), ",")
    return sites.select(
        F.substring("street", 1, 3).alias("street"), F.when(F.col("external_id").startswith("ID"), F.col("external_id")).otherwise(F.length("external_id").cast("string")).alias("external_id"),
        "operator", "postal_code", "bundesland", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"), "commissioned_on", "charging_points_count",
        "max_power_kw", "total_power_kw", kinds.alias("connectors"))


_POINTS = "case c_custkey % 4 when 0 then 'type2/ac,ccs/dc' when 1 then 'chademo/dc' when 2 then 'unknown/unknown' else 'type2/ac,schuko/ac' end"
REG.add("read_register_csv", _register_stations, f"""
    select 'Weg' as street, case when c_custkey % 5 = 0 then '32' else 'ID' || c_custkey end as external_id, c_mktsegment || chr(10) || 'GmbH; Co' as operator,
           lpad((c_custkey % 99999)::varchar, 5, '0') as postal_code, {cases('c_custkey', _PLACE_CODES)} as bundesland, round(50 + (c_custkey % 1000) / 1000, 3) as latitude,
           round(8 + (c_custkey % 500) / 1000, 3) as longitude, make_date(2021, 3, (c_custkey % 28 + 1)::int) as commissioned_on,
           case c_custkey % 4 when 0 then 2 when 3 then 2 else 1 end as charging_points_count, case c_custkey % 4 when 0 then 11 when 1 then 50 when 2 then 22 else 11 end::double as max_power_kw,
           case when c_acctbal >= 0 then round(c_acctbal * 100) / 100 end as total_power_kw, {_POINTS} as connectors from customer where c_custkey % 97 <> 13""")
REG.add("register_skipped_rows", lambda t: _register(t)[1].agg(F.sum("skipped_rows").alias("skipped_rows"), F.sum("rows").alias("rows")),
        "select count(*) filter (c_custkey % 97 = 13) as skipped_rows, count(*) as rows from customer")
REG.add("read_edition_date", lambda t: feeds.read_edition_date(t.spark, register_files(t)).select("edition_date"),
        f"select date '2026-09-01' as edition_date from (select distinct c_custkey // {_ROWS_PER_EDITION} from customer)")


def _lines(t: Tables, lines: DataFrame, name: str, header: str | None = None) -> str:
    """Writes one text column as files, a header line first in each."""
    path = folder(t, name)
    if header is not None:
        body = F.array_join(F.array_sort(F.collect_list("value")), "\n")
        lines = lines.groupBy("part").agg(F.concat(F.lit(header + "\n"), body).alias("value"))
        lines.write.partitionBy("part").text(path)
    else:
        lines.select("value").write.text(path)
    return path


def _product(t: Tables):
    stamp = "date_format(observed_at, 'yyyyMMddHHmm')"
    rows = t.weather_observations.select(
        F.substring("weather_station_id", 2, 9).cast("bigint").alias("station"), F.expr(stamp).alias("stamp"), "temperature_c", "humidity_percent", "id")
    line = F.concat_ws(";", F.lpad(F.col("station").cast("string"), 6, " "), "stamp", F.lit("  3"), F.lpad(F.col("temperature_c").cast("string"), 8, " "),
                       F.lpad(F.col("humidity_percent").cast("string"), 8, " "), F.lit("eor"))
    files = rows.select(F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"), line.alias("value"))
    parsed = feeds.read_weather_product(t.spark, _lines(t, files, "weather", "STATIONS_ID;MESS_DATUM;  QN;TT_10;RF_10;eor"))
    return parsed.select("dwd_station_id", "observed_at", text_de.measurement(F.col("values")["TT_10"]).alias("temperature_c"),
                         text_de.humidity(F.col("values")["RF_10"]).alias("humidity_percent"))


REG.add("read_weather_product", _product, """
    select lpad(substr(weather_station_id, 2), 5, '0') as dwd_station_id, observed_at, case when temperature_c > -999 then temperature_c end as temperature_c,
           case when humidity_percent > -999 then least(100, humidity_percent) end as humidity_percent from weather_observations""")


def _catalogue(t: Tables):
    state = F.expr(cases("s_suppkey", ["Hessen", "Baden-Württemberg", "Sachsen-Anhalt", "Nirgendwo"]))
    n = F.col("s_suppkey").cast("string")
    tail = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.rpad(F.concat(F.lit("Station "), n), 41, " "), F.rpad(state, 41, " "))).otherwise(
        F.concat(F.lit("Ort "), n, F.lit("   "), state))
    line = F.concat(F.lpad(n, 5, "0"), F.lit(" 20010101 20261231 "), F.lpad((F.col("s_suppkey") % 900).cast("string"), 14, " "), F.lit("     50.1234   8.5678 "), tail)
    path = folder(t, "catalogue")
    t.supplier.select(line).write.options(
        sep="\u0001", quote="", encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return feeds.read_station_catalogue(t.spark, path).select("dwd_station_id", "valid_from", "elevation_m", "latitude", "name", "bundesland")


REG.add("read_station_catalogue", _catalogue, """
    select lpad(s_suppkey::varchar, 5, '0') as dwd_station_id, date '2001-01-01' as valid_from, (s_suppkey % 900)::double as elevation_m, 50.1234::double as latitude,
           case when s_suppkey % 2 = 0 then 'Station ' || s_suppkey when s_suppkey % 4 = 3 then '' else 'Ort ' || s_suppkey end as name,
           case s_suppkey % 4 when 0 then 'HE' when 1 then 'BW' when 2 then 'ST' end as bundesland from supplier""")


def _traffic_json(t: Tables) -> DataFrame:
    """Items of all services on seven roads, a thousand orders per document; every 40th has no place."""
    item = F.struct(
        F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("identifier"), F.lit("true").alias("isBlocked"),
        F.expr("case when o_orderkey % 4 = 1 then '49.5,8.25' end").alias("point"), F.lit("SHORT_TERM_ROADWORKS").alias("display_type"),
        F.expr("case when o_orderkey % 9 = 0 then '  ' else ' Titel ' end").alias("title"), F.lit(" A - B").alias("subtitle"),
        F.expr("""case when o_orderkey % 2 = 0 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") end""").alias("startTimestamp"),
        F.expr("case when o_orderkey % 8 = 1 then '-1' else '12' end").alias("delayTimeValue"),
        F.expr("case when o_orderkey % 4 = 0 then named_struct('lat', if(o_orderkey % 40 = 0, 95D, 50.5D), 'long', 9.5D) end").alias("coordinate"),
        F.array(F.lit("Text "), F.lit(None).cast("string"), F.lit("Ende ")).alias("description"), F.expr("case when o_orderkey % 5 = 0 then 'queuing_traffic' end").alias("abnormalTrafficType"),
        F.expr("named_struct('symbols', case when o_orderkey % 6 = 0 then array('CLOSED', null) else array('LANE') end)").alias("impact"),
        F.expr("named_struct('type', 'LineString', 'coordinates', array(array(10.25D, 51.75D), array(200D, 52D), array(11D, 52D)))").alias("geometry"))
    service = F.expr(cases("o_orderkey", list(feeds.TRAFFIC_SERVICES)))
    road = F.concat(F.lit("A"), (F.col("o_orderkey") % 7).cast("string"))
    items = t.orders.select(F.floor(F.col("o_orderkey") / 1000).alias("part"), service.alias("service"), road.alias("road"), item.alias("i"))
    documents = items.groupBy("part", "service", "road").agg(F.collect_list("i").alias("i"))
    value = F.to_json(F.struct(*(F.when(F.col("service") == name, F.col("i")).alias(name) for name in feeds.TRAFFIC_SERVICES)))
    path = folder(t, "traffic")
    documents.select("road", "service", value.alias("value")).repartition("road", "service").write.partitionBy("road", "service").text(path)
    events = feeds.read_traffic_json(t.spark, path, multi_line=False)
    return events.withColumns({"geometry": F.to_json("geometry"), "raw": F.get_json_object("raw", "$.identifier"), "raw_keys": F.array_join(F.json_object_keys("raw"), ",")})


REG.add("read_traffic_json", _traffic_json, f"""
    select 'X' || o_orderkey as external_id, case when s = 'warning' and o_orderkey % 5 = 0 then 'congestion' else s end as event_type,
           case when o_orderkey % 5 = 0 then 'high' when s = 'closure' then 'high' when s = 'roadworks' and o_orderkey % 6 = 0 then 'high' else 'low' end as severity,
           road as road_name, 'A - B' as direction, case when o_orderkey % 9 = 0 then road || ' ' || s else 'Titel' end as title, 'Text ' || chr(10) || 'Ende' as description,
           case o_orderkey % 4 when 0 then 50.5 when 1 then 49.5 else 51.75 end::double as latitude, case o_orderkey % 4 when 0 then 9.5 when 1 then 8.25 else 10.25 end::double as longitude,
           '[{{"latitude":51.75,"longitude":10.25}},{{"latitude":52.0,"longitude":11.0}}]' as geometry,
           case when o_orderkey % 2 = 0 then o_orderdate end as starts_at, null::timestamp as ends_at, o_orderkey % 6 = 0 as is_blocked,
           case when o_orderkey % 8 <> 1 then 12::double end as delay_minutes, 'X' || o_orderkey as raw,
           case when o_orderkey % 5 = 0 then 'abnormalTrafficType,' else '' end || case when o_orderkey % 4 = 0 then 'coordinate,' else '' end
             || 'delayTimeValue,description,display_type,identifier,impact,' || case when o_orderkey % 4 = 1 then 'point,' else '' end
             || case when o_orderkey % 2 = 0 then 'startTimestamp,' else '' end || 'subtitle,title' as raw_keys
    from (select *, {cases('o_orderkey', ['roadworks', 'closure', 'warning'])} as s, 'A' || (o_orderkey % 7) as road from orders) where o_orderkey % 40 <> 0""")


def _route_json(t: Tables):
    steps = t.route_steps.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "ref", "distance_m", "duration_s"))), lambda s: F.struct(
        s.ref.alias("ref"), F.lit("Weg").alias("name"), s.distance_m.alias("distance"), s.duration_s.alias("duration"))).alias("steps"))
    body = t.routes.select(F.col("id").alias("route_id"), "geometry", "distance_m", "duration_s").join(steps, "route_id").select(F.to_json(F.struct(
        "route_id", F.struct(F.transform("geometry", lambda v: F.array(v.longitude, v.latitude)).alias("coordinates")).alias("geometry"),
        F.col("distance_m").alias("distance"), F.col("duration_s").alias("duration"), F.array(F.struct("steps")).alias("legs"))).alias("value"))
    return feeds.read_route_json(t.spark, _lines(t, body, "routes"), multi_line=False)


REG.add("read_route_json", lambda t: rounded(_route_json(t)[1].drop("name")), """
    select route_id, step_no, step_start_m, step_end_m, ref, distance_m, duration_s from route_steps""")
REG.add("read_route_geometry", lambda t: _route_json(t)[0].select("route_id", F.size("geometry").alias("vertices"), F.round(F.col("geometry")[11].latitude, 6).alias("end_latitude"),
                                                                   F.round(F.col("geometry")[0].longitude, 6).alias("start_longitude")),
        "select id as route_id, 12 as vertices, round(destination_latitude, 6) as end_latitude, round(origin_longitude, 6) as start_longitude from routes")


def _places_json(t: Tables):
    place = F.struct(
        F.col("c_custkey").alias("place_id"), F.lit("48.5").alias("lat"), F.lit("x").alias("lon"), F.lit(0.5).alias("importance"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("display_name"), F.create_map(F.lit("state"), F.expr(cases("c_custkey", [p or "" for p in _PLACES]))).alias("address"))
    document = F.to_json(F.create_map(F.concat(F.lit(" Ort "), F.col("c_custkey").cast("string")), F.array(place, place)))
    return feeds.read_places_json(t.spark, _lines(t, t.customer.select(document.alias("value")), "places"))


REG.add("read_places_json", _places_json, f"""
    select 'ort ' || c_custkey as query, p::int as position, c_name as name, c_mktsegment as display_name, 48.5::double as latitude, null::double as longitude, 0.5::double as importance,
           {cases('c_custkey', _PLACE_CODES)} as bundesland from customer, (values (0), (1)) v(p)""")

# ---- lake


def _written(t: Tables) -> str:
    root = folder(t, "lake")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    for day in (dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 1)):  # the first day is written twice
        lake.write_partition(rows, root, "silver", "orders", day)
    lake.write_partition(rows.where("o_orderkey < 0"), root, "silver", "orders", dt.date(2024, 1, 3))
    return root


REG.add("read_lake", lambda t: lake.read_lake(t.spark, _written(t), "silver", "orders", "o_orderkey bigint, o_totalprice double, o_orderpriority string, dt date").groupBy("dt").agg(
    F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys")),
    "select d as dt, count(*) as rows, count(distinct o_orderkey) as keys from orders, (values (date '2024-01-01'), (date '2024-01-02')) v(d) group by 1")


def _lake_sql(t: Tables):
    lake.register_lake_views(t.spark, _written(t), [("silver", "orders")])
    return lake.lake_sql(t.spark, "select o_orderpriority, count(*) as n from silver_orders where o_totalprice >= :least group by 1", {"least": 250_000.0})


REG.add("lake_sql", _lake_sql, "select o_orderpriority, 2 * count(*) as n from orders where o_totalprice >= 250000 group by 1")
REG.add("describe_lake", lambda t: lake.describe_lake(t.spark, _written(t), [("silver", "orders")]).select("zone", "dataset", F.col("dt").cast("string").alias("dt"), "rows"),
        "select 'silver' as zone, 'orders' as dataset, d as dt, count(*) as rows from orders, (values ('2024-01-01'), ('2024-01-02')) v(d) group by 3")
REG.add("raw_manifest", lambda t: lake.raw_manifest(t.spark, register_files(t) + "/*", "register").select("kind", "sha256", "bytes"))
_ROWS_PER_FILE = 2_000


def _order_files(t: Tables) -> str:
    """Orders as text files of a bounded number of lines each."""
    path = folder(t, "raw")
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_custkey").cast("string"))
    files = t.orders.select(F.floor(F.col("o_orderkey") / _ROWS_PER_FILE).alias("file"), "o_orderkey", line.alias("line")).groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda r: r["line"]), "\n").alias("value"))
    files.write.partitionBy("file").text(path)
    return path


relation("raw_file", f"""
    select f as file, sha256(body) as sha256, strlen(body) as bytes from (
        select o_orderkey // {_ROWS_PER_FILE} as f, string_agg(o_orderkey || ';' || o_orderpriority || ';' || o_custkey, chr(10) order by o_orderkey) || chr(10) as body from orders group by 1)""")
REG.add("raw_digests", lambda t: lake.raw_manifest(t.spark, _order_files(t) + "/*", "orders").select("kind", "sha256", "bytes"),
        "select 'orders' as kind, sha256, bytes from raw_file")


def _recorded(t: Tables) -> DataFrame:
    """A run with files and one that failed, appended to the table of runs and read back."""
    path, report = folder(t, "runs"), q.quality_report(checked_stations(t))
    lake.record_run(path, lake.run_record(report, "run-x", "register", "charging", "live", AT, AT, lake.raw_manifest(t.spark, _order_files(t) + "/*", "orders"), "https://data.example/"))
    lake.record_run(path, lake.run_record(report.limit(0), "run-y", "register", "charging", "fixture", AT, AT, error="TimeoutError: no answer"))
    return t.spark.read.parquet(path)


REG.add("run_record", lambda t: _recorded(t).select(
    "id", "source", "status", "rows_received", "rows_accepted", "rows_rejected", "rows_duplicate", "source_file_sha256", "bytes_downloaded", "source_url", "error_message"), """
    with part as (select substr(sha256, 1, 3) as p, sha256(string_agg(sha256, ',' order by sha256)) as s, count(*) as n, min(sha256) as first, sum(bytes) as bytes from raw_file group by 1)
    select 'run-x' as id, 'register' as source, case when count(*) filter (quality_status = 'rejected') > 0 then 'partial' else 'succeeded' end as status, count(*) as rows_received,
           count(*) filter (quality_status = 'accepted') as rows_accepted, count(*) filter (quality_status = 'rejected') as rows_rejected,
           count(*) filter (quality_status = 'duplicate') as rows_duplicate,
           (select case when sum(n) = 1 then min(first) else sha256(string_agg(s, ',' order by p)) end from part) as source_file_sha256, (select sum(bytes)::bigint from part) as bytes_downloaded,
           'https://data.example/' as source_url, null as error_message from verdict_station
    union all select 'run-y', 'register', 'failed', 0, 0, 0, 0, null, null, null, 'TimeoutError: no answer'""")

# ---- upserts: a stored state and an incoming one, both over the whole table


def _states(t: Tables):
    site = stg_stations(t).select("station_id", "operator", "city", "max_power_kw", F.substring("station_id", 2, 20).cast("bigint").alias("n"))
    stored = site.where("n % 10 <> 3").select("station_id", "operator", "city", F.round("max_power_kw", 6).alias("max_power_kw"))
    incoming = site.where("n % 10 <> 7").select(
        "station_id", "operator", F.when(F.col("n") % 3 == 0, F.lit("Neu")).otherwise(F.col("city")).alias("city"),
        F.round(F.when(F.col("n") % 4 == 0, F.lit(None)).otherwise(F.col("max_power_kw")), 6).alias("max_power_kw"))
    return reuse(stored), reuse(incoming)


_N = "substr(station_id, 2)::bigint"
relation("state_pair", f"""
    select station_id, {_N} as n, operator, city, round(max_power_kw, 6) as kw, {_N} % 10 <> 3 as is_stored, {_N} % 10 <> 7 as is_incoming,
           case when {_N} % 3 = 0 then 'Neu' else city end as city2, case when {_N} % 4 <> 0 then round(max_power_kw, 6) end as kw2 from stg_station""")
REG.add("upsert_changed", lambda t: upsert.upsert_changed(*_states(t), "station_id", ["operator", "max_power_kw"])[0], """
    select station_id, operator, case when is_incoming and (not is_stored or kw is distinct from kw2) then city2 else city end as city,
           case when is_incoming and (not is_stored or kw is distinct from kw2) then kw2 else kw end as max_power_kw from state_pair where is_stored or is_incoming""")
REG.add("touched_keys", lambda t: upsert.upsert_changed(*_states(t), "station_id", ["operator", "max_power_kw"])[1], """
    select station_id, case when is_stored then 'updated' else 'inserted' end as action from state_pair where is_incoming and (not is_stored or kw is distinct from kw2)""")
REG.add("upsert_all", lambda t: upsert.upsert_all(*_states(t), "station_id"), """
    select station_id, operator, case when is_incoming then city2 else city end as city, case when is_incoming then kw2 else kw end as max_power_kw from state_pair where is_stored or is_incoming""")


def _children(t: Tables):
    touched = upsert.upsert_changed(*_states(t), "station_id", ["operator", "max_power_kw"])[1]
    points = stg_points(t).select("station_id", "charging_point_id", F.lit("old").alias("version"))
    return upsert.replace_children(points, points.withColumn("version", F.lit("new")), touched, "station_id")


REG.add("replace_children", _children, """
    select p.station_id, charging_point_id, case when is_incoming and (not is_stored or kw is distinct from kw2) then 'new' else 'old' end as version
    from stg_point p left join state_pair using (station_id)""")


# the same changes on tables kept in buckets, each in place and read back
_SITE_FIELDS = "station_id string, operator string, city string, max_power_kw double"


def _bucketed(t: Tables, name: str, rows: DataFrame, schema: str) -> BucketTable:
    table = BucketTable(t.spark, folder(t, name), schema, ["station_id"], buckets=16)
    table.upsert_all(rows)
    return table


def _bucket_upsert(t: Tables) -> DataFrame:
    stored, incoming = _states(t)
    sites = _bucketed(t, "sites", stored, _SITE_FIELDS)
    sites.upsert_changed(incoming, ["operator", "max_power_kw"])
    return sites.read()


def _bucket_upsert_all(t: Tables) -> DataFrame:
    stored, incoming = _states(t)
    sites = _bucketed(t, "sites", stored, _SITE_FIELDS)
    sites.upsert_all(incoming)
    return sites.read()


def _bucket_children(t: Tables) -> DataFrame:
    stored, incoming = _states(t)
    touched = _bucketed(t, "sites", stored, _SITE_FIELDS).upsert_changed(incoming, ["operator", "max_power_kw"])
    points = stg_points(t).select("station_id", "charging_point_id", F.lit("old").alias("version"))
    children = _bucketed(t, "points", points, "station_id string, charging_point_id string, version string")
    children.replace_children(touched, points.withColumn("version", F.lit("new")))
    return children.read()


for _name, _build, _like in (("bucket_upsert", _bucket_upsert, "upsert_changed"), ("bucket_upsert_all", _bucket_upsert_all, "upsert_all"), ("bucket_children", _bucket_children, "replace_children")):
    REG.add(_name, _build)
    REG.oracles[_name] = REG.oracles[_like]


def _closed(t: Tables):
    e = staging.traffic_events(t.traffic_events).select("traffic_event_id", "road_name", "ends_at", F.substring("traffic_event_id", 2, 20).cast("bigint").alias("n"))
    return upsert.close_vanished(e, e.where("n % 3 <> 0"), e.where("road_name <> 'A7'"), "traffic_event_id", "road_name", AT).drop("n")


REG.add("close_vanished", _closed, f"""
    select traffic_event_id, road_name, case when ends_at is null and substr(traffic_event_id, 2)::bigint % 3 = 0 and road_name <> 'A7'
           then timestamp '{TRAFFIC_NOW}' else ends_at end as ends_at from stg_traffic""")


def _incremental(t: Tables):
    """The telemetry fact loaded up to a point, then topped up from the look-back on."""
    def build(rows: DataFrame) -> DataFrame:
        return trip_plans.fct_vehicle_telemetry(rows, t.vehicles, models(t))

    source = staging.telemetry(t.telemetry)
    first = build(source.where("recorded_at < timestamp '2024-01-16 00:00:00'"))
    stale = reuse(first.withColumn("vehicle_state", F.lit("stale")))
    return upsert.incremental_delete_insert(stale, source, "telemetry_id", "recorded_at", 30, build).select("telemetry_id", "recorded_at", "vehicle_state", "road_class_ordinal")


def _by_days(t: Tables):
    """The same top-up of a fact stored by day: only the days from the look-back on are written anew."""
    def build(rows: DataFrame) -> DataFrame:
        fact = trip_plans.fct_vehicle_telemetry(rows, t.vehicles, models(t))
        return fact.select("telemetry_id", "recorded_at", "vehicle_state", "road_class_ordinal")

    source = staging.telemetry(t.telemetry)
    path = folder(t, "fact-by-day")
    upsert.upsert_days(path, source.where("recorded_at < timestamp '2024-01-16 00:00:00'"), "telemetry_id", "recorded_at", 30,
                       lambda rows: build(rows).withColumn("vehicle_state", F.lit("stale")))
    upsert.upsert_days(path, source, "telemetry_id", "recorded_at", 30, build, key_moves=False)
    return t.spark.read.parquet(path).drop("dt")


_TOPPED_UP = """
    select telemetry_id, recorded_at, case when recorded_at >= (select max(recorded_at) - interval 30 minute from telemetry where recorded_at < timestamp '2024-01-16 00:00:00')
           then vehicle_state else 'stale' end as vehicle_state, road_class_ordinal from fct_telemetry_raw"""
REG.add("incremental_delete_insert", _incremental, _TOPPED_UP)
REG.add("upsert_days", _by_days, _TOPPED_UP)
