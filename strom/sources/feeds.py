"""Readers of the raw feeds: charging register, weather products, station catalogue, traffic, routes, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.functions import text_de
from strom.session import cut_lineage
from strom.sources.records import read_records

# fixed values: column names of the register
REGISTER_COLUMNS = (
    "Ladeeinrichtungs-ID", "Betreiber", "Anzeigename (Karte)", "Status", "Art der Ladeeinrichtung", "Anzahl Ladepunkte",
    "Nennleistung Ladeeinrichtung [kW]", "Inbetriebnahmedatum", "Straße", "Hausnummer", "Adresszusatz", "Postleitzahl", "Ort",
    "Kreis/kreisfreie Stadt", "Bundesland", "Breitengrad", "Längengrad",
    *(f"{label}{i}" for i in range(1, 7) for label in ("Steckertypen", "Nennleistung Stecker", "Public Key")),
)
REQUIRED_COLUMNS = (
    "Ladeeinrichtungs-ID", "Betreiber", "Art der Ladeeinrichtung", "Anzahl Ladepunkte", "Nennleistung Ladeeinrichtung [kW]",
    "Straße", "Postleitzahl", "Ort", "Bundesland", "Breitengrad", "Längengrad", "Steckertypen1", "Nennleistung Stecker1",
)
EDITION_PATTERN = r"Letzte\s+Aktualisierung\s+vom:\s*(\d{2})\.(\d{2})\.(\d{4})"
TRAFFIC_SERVICES = ("roadworks", "closure", "warning")
# fixed values: keys of an item that are not kept as raw
TRAFFIC_DROPPED_KEYS = ("footer", "geometry", "icon", "isBlocked", "lorryParkingFeatureIcons", "routeRecommendation")
ROUTE_RESPONSE = (
    "geometry struct<coordinates:array<array<double>>>, distance double, duration double, "
    "legs array<struct<steps:array<struct<ref:string,name:string,distance:double,duration:double>>>>, route_id string"
)
PLACE = (
    "struct<place_id:bigint,osm_type:string,osm_id:bigint,lat:string,lon:string,category:string,type:string,"
    "importance:double,name:string,display_name:string,address:map<string,string>,boundingbox:array<string>>"
)
_FILE, _AT, _BAD = "_file", "_at", "_corrupt_record"


def _register_width(spark: SparkSession, path: str) -> int:
    """Number of cells of the widest header line."""
    value = F.replace(F.col("value"), F.lit("\ufeff"), F.lit(""))
    header = spark.read.text(path).where(F.ltrim(F.replace(value, F.lit('"'), F.lit(""))).startswith(REGISTER_COLUMNS[0]))
    return header.agg(F.max(F.size(F.split("value", ";")))).first()[0] or 1


def read_register_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Register rows by column name, and per file how many rows were too short. As many columns are read as the header has.

    The header is found by its first cell, whatever precedes it; columns are then taken by name, so their
    order may differ between editions. Cells may hold line breaks; an edition is still read by many tasks (``records.read_records``).
    """
    names = [f"c{i}" for i in range(_register_width(spark, path))]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = F.from_csv("record", schema, {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    raw = read_records(spark, path).select(_FILE, _AT, parsed.alias("_c"))
    raw = cut_lineage(raw.select(_FILE, _AT, F.array(*(F.col(f"_c.{n}") for n in names)).alias("cells")))
    first = F.replace(F.coalesce(F.col("cells")[0], F.lit("")), F.lit("﻿"), F.lit(""))
    headers = raw.where(first == REGISTER_COLUMNS[0]).groupBy(_FILE).agg(F.min_by("cells", _AT).alias("header"), F.min(_AT).alias("_header_at"))
    rows = raw.join(headers, _FILE).where(F.col(_AT) > F.col("_header_at"))
    set_cells = F.size(F.filter("header", lambda h: h.isNotNull()))
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    # an empty trailing cell is read as NULL too, so a row counts as short by its last filled column
    last = F.array_max(F.filter(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1)), lambda i: i.isNotNull()))
    rows = rows.where(filled > 0).withColumn("_short", F.coalesce(last, F.lit(0)) < F.least(set_cells, F.lit(17)))
    named = F.map_from_arrays(
        F.transform(F.filter("header", lambda h: h.isNotNull()), lambda h: F.trim(h)), F.slice("cells", 1, set_cells))
    good = rows.where(~F.col("_short")).select(_FILE, _AT, named.alias("_m"))
    columns = good.select(_FILE, *(F.trim(F.try_element_at("_m", F.lit(c))).alias(c) for c in REGISTER_COLUMNS))
    skipped = rows.groupBy(_FILE).agg(F.count_if("_short").alias("skipped_rows"), F.count(F.lit(1)).alias("rows"))
    return columns, skipped


def schema_contract(header: list[str], required=REQUIRED_COLUMNS, known=REGISTER_COLUMNS) -> list[str]:
    """Columns that are new; a missing required one is an error."""
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in header if c not in known]


def read_edition_date(spark: SparkSession, path: str) -> DataFrame:
    """Edition date per file from its preamble."""
    lines = spark.read.text(path).select(F.input_file_name().alias(_FILE), "value")
    hit = lines.where(F.col("value").rlike(EDITION_PATTERN))
    part = [F.regexp_extract("value", EDITION_PATTERN, g).cast("int") for g in (3, 2, 1)]
    return hit.groupBy(_FILE).agg(F.min(F.make_date(*part)).alias("edition_date"))


def register_stations(rows: DataFrame) -> DataFrame:
    """Typed sites with their connectors from register rows."""
    groups = [(f"Steckertypen{i}", f"Nennleistung Stecker{i}", f"Public Key{i}") for i in range(1, 7)]
    made_up = text_de.synthetic_id("Betreiber", "Straße", "Hausnummer", "Postleitzahl", "Breitengrad", "Längengrad")
    points = text_de.connectors(groups)
    power = text_de.parse_decimal(F.col("Nennleistung Ladeeinrichtung [kW]"))
    declared = F.greatest(F.col("Anzahl Ladepunkte").try_cast("int"), F.lit(1))
    return rows.withColumn("points", points).select(
        F.coalesce(F.nullif(F.col("Ladeeinrichtungs-ID"), F.lit("")), made_up).alias("external_id"),
        *(F.nullif(F.col(c), F.lit("")).alias(a) for c, a in (("Betreiber", "operator"), ("Straße", "street"), ("Ort", "city"))),
        F.col("Postleitzahl").alias("postal_code"), text_de.state_code(F.col("Bundesland")).alias("bundesland"),
        text_de.parse_decimal(F.col("Breitengrad")).alias("latitude"), text_de.parse_decimal(F.col("Längengrad")).alias("longitude"),
        text_de.parse_date(F.col("Inbetriebnahmedatum")).alias("commissioned_on"),
        F.when(F.size("points") > 0, F.size("points")).otherwise(F.coalesce(declared, F.lit(1))).alias("charging_points_count"),
        F.array_max(F.transform("points", lambda p: p.power_kw)).alias("max_power_kw"), power.alias("total_power_kw"), "points",
    )


def read_weather_product(spark: SparkSession, path: str) -> DataFrame:
    """Padded ``;`` text with a header per file: station, UTC time, and a map of the measured columns."""
    lines = spark.read.csv(path, sep="\u0001", quote="", schema="line string", encoding="ISO-8859-1").select(
        F.input_file_name().alias(_FILE), F.transform(F.split("line", ";"), lambda c: F.trim(c)).alias("cells"))
    is_header = F.upper(F.col("cells")[0]) == "STATIONS_ID"
    headers = lines.where(is_header).groupBy(_FILE).agg(F.first("cells").alias("header"))
    body = lines.where(~is_header & (F.size("cells") > 2)).join(headers, _FILE).where(F.size("cells") >= F.size("header"))
    values = F.map_filter(
        F.map_from_arrays("header", F.slice("cells", 1, F.size("header"))),
        lambda k, v: ~k.isin("STATIONS_ID", "MESS_DATUM", "eor"))
    return body.select(
        F.lpad(F.col("cells")[0], 5, "0").alias("dwd_station_id"), text_de.parse_mess_datum(F.col("cells")[1]).alias("observed_at"),
        values.alias("values"),
    ).where(F.col("observed_at").isNotNull())


def read_station_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width catalogue: numbers by pattern, name and state by width, or by a known state name."""
    lines = spark.read.csv(path, sep="\u0001", quote="", schema="line string", encoding="ISO-8859-1",
                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    pattern = r"^\s*(\d+)\s+(\d{8})\s+(\d{8})\s+(-?\d+)\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s(.*)$"
    hit = lines.where(F.col("line").rlike(pattern))

    def group(n: int):
        return F.regexp_extract("line", pattern, n)

    tail, states = group(7), "|".join(names[0] for names in text_de.STATE_SPELLINGS.values())
    wide = F.length(tail) > 41
    by_name = r"^\s*(.*?)\s+(" + states + r")\b.*$"
    name = F.when(wide, F.trim(F.substring(tail, 1, 41))).otherwise(F.regexp_extract(tail, by_name, 1))
    state = F.when(wide, F.trim(F.substring(tail, 42, 41))).otherwise(F.regexp_extract(tail, by_name, 2))
    return hit.select(
        F.lpad(group(1), 5, "0").alias("dwd_station_id"), F.try_to_date(group(2), "yyyyMMdd").alias("valid_from"),
        F.try_to_date(group(3), "yyyyMMdd").alias("valid_to"), group(4).cast("double").alias("elevation_m"),
        group(5).cast("double").alias("latitude"), group(6).cast("double").alias("longitude"),
        name.alias("name"), text_de.state_code(state).alias("bundesland"),
    )


def _kind_at(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _text_at(value: Column, path: str) -> Column:
    """Stripped text of a variant; null if it is empty or no text."""
    text = F.btrim(F.try_variant_get(value, path, "string"), F.lit(" \t\r\n"))
    return F.when(_kind_at(value, path) == "STRING", F.nullif(text, F.lit("")))


def _number_at(value: Column, path: str) -> Column:
    """Number of a variant, also one written as text."""
    return F.when(_kind_at(value, path) != "BOOLEAN", F.try_variant_get(value, path, "double"))


def _texts_at(value: Column, path: str) -> Column:
    """The texts of an array, whatever else is in it."""
    parts = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(parts, lambda part: F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string")))
    return F.filter(texts, lambda text: text.isNotNull())


def _place(latitude: Column, longitude: Column) -> Column:
    """A place if both numbers are there, whose members are null where they are out of range."""
    valid = latitude.between(-90, 90) & longitude.between(-180, 180)
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(F.when(valid, latitude).alias("latitude"), F.when(valid, longitude).alias("longitude")))


def read_traffic_json(spark: SparkSession, path: str, service: str | None = None, road: str | None = None, multi_line: bool = True) -> DataFrame:
    """Typed events from ``{service: [item, ...]}`` documents, with the line's geometry and the item's other keys as JSON text in ``raw``.

    Documents lie in folders ``road=.../service=...``, or belong to the ``road`` and ``service`` given. Each is one file, or one line
    with ``multi_line=False``. Items are read as variants, so keys of an unexpected type cost that key only. A document without its service has
    no items, one whose service is no list is an error; items that are no objects or have no place on earth are dropped. The place is the
    coordinate, else the point text, else the first vertex of the line.
    """
    documents = spark.read.text(path, wholetext=multi_line)
    which = F.lit(service) if service else F.col("service")
    where = F.nullif(F.trim(F.lit(road) if road else F.col("road").cast("string") if "road" in documents.columns else F.lit(None).cast("string")), F.lit(""))
    documents = documents.where(F.trim("value") != "").select(which.alias("service"), where.alias("road"), F.parse_json("value").alias("document"))
    lists = [F.when(F.col("service") == name, F.variant_get("document", f"$.{name}", "array<variant>")) for name in TRAFFIC_SERVICES]
    items = documents.select("service", "road", F.explode(F.coalesce(*lists)).alias("item")).where(F.schema_of_variant("item").startswith("OBJECT"))

    item = F.col("item")
    vertices = F.when(_text_at(item, "$.geometry.type") == "LineString", F.try_variant_get(item, "$.geometry.coordinates", "array<variant>"))
    vertices = F.transform(F.coalesce(vertices, F.array().cast("array<variant>")), lambda v: _place(_number_at(v, "$[1]"), _number_at(v, "$[0]")))
    items = items.select(
        "service", "road", "item", F.filter(vertices, lambda v: v["latitude"].isNotNull()).alias("geometry"), _texts_at(item, "$.impact.symbols").alias("symbols"),
        F.nullif(F.btrim(F.array_join(_texts_at(item, "$.description"), "\n"), F.lit(" \t\r\n")), F.lit("")).alias("description"),
        F.split(_text_at(item, "$.point"), ",").alias("point"), _text_at(item, "$.abnormalTrafficType").alias("abnormal"))
    point = [F.trim(F.get("point", F.lit(i))).try_cast("double") for i in (0, 1)]
    place = F.coalesce(_place(_number_at(item, "$.coordinate.lat"), _number_at(item, "$.coordinate.long")), _place(*point), F.get("geometry", F.lit(0)))
    items = items.withColumn("place", place).where("place.latitude is not null")

    starts, ends = text_de.extract_validity(F.coalesce("description", F.lit("")))
    delay = _number_at(item, "$.delayTimeValue")
    kept = F.map_filter(F.variant_get(item, "$", "map<string,variant>"), lambda key, _: ~key.isin(*TRAFFIC_DROPPED_KEYS))
    return items.select(
        _text_at(item, "$.identifier").alias("external_id"), text_de.event_type(F.col("service"), F.col("abnormal")).alias("event_type"),
        text_de.severity(F.col("service"), _text_at(item, "$.display_type"), F.col("symbols"), F.col("abnormal")).alias("severity"),
        F.col("road").alias("road_name"), _text_at(item, "$.subtitle").alias("direction"),
        F.coalesce(_text_at(item, "$.title"), F.concat_ws(" ", "road", "service")).alias("title"), "description",
        "place.latitude", "place.longitude", "geometry", F.coalesce(text_de.parse_iso(_text_at(item, "$.startTimestamp")), starts).alias("starts_at"), ends.alias("ends_at"),
        F.array_contains("symbols", text_de.CLOSED_SYMBOL).alias("is_blocked"), F.when(delay >= 0, delay).alias("delay_minutes"), F.to_json(kept).alias("raw"),
    )


def read_route_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Routes with (latitude, longitude) geometry, and their steps as offset ranges."""
    responses = spark.read.schema(ROUTE_RESPONSE).json(path, multiLine=multi_line)
    geometry = F.transform("geometry.coordinates", lambda c, i: F.struct(
        i.cast("int").alias("ordinal"), c[1].alias("latitude"), c[0].alias("longitude")))
    routes = responses.select("route_id", geometry.alias("geometry"), F.col("distance").alias("distance_m"), F.col("duration").alias("duration_s"))
    steps = responses.select("route_id", F.posexplode(F.flatten(F.transform("legs", lambda leg: leg.steps))).alias("step_no", "s"))
    along = W.partitionBy("route_id").orderBy("step_no").rowsBetween(W.unboundedPreceding, W.currentRow)  # one response row
    end = F.sum("s.distance").over(along)
    return routes, steps.select(
        "route_id", "step_no", (end - F.col("s.distance")).alias("step_start_m"), end.alias("step_end_m"), F.col("s.ref").alias("ref"),
        F.col("s.name").alias("name"), F.col("s.distance").alias("distance_m"), F.col("s.duration").alias("duration_s"))


def read_places_json(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder hits by normalised query, best first; ``{query: [place, ...]}`` documents, one per line."""
    text = spark.read.text(path, wholetext=False)
    hits = text.select(F.explode(F.from_json("value", f"map<string,array<{PLACE}>>")).alias("query", "places"))
    return hits.select(F.lower(F.trim("query")).alias("query"), F.posexplode("places").alias("position", "p")).select(
        "query", "position", F.col("p.name").alias("name"), F.col("p.display_name").alias("display_name"),
        F.col("p.lat").try_cast("double").alias("latitude"), F.col("p.lon").try_cast("double").alias("longitude"),
        F.col("p.importance").alias("importance"), text_de.state_code(F.try_element_at("p.address", F.lit("state"))).alias("bundesland"),
    )
