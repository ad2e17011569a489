"""Parsing of German source texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of the sources
CONNECTOR_UNKNOWN = ("unknown", "unbekannt", "keineangabe", "na", "none", "null", "sonstige", "sonstiges")
CONNECTOR_WORDS = (
    (("chademo",), "chademo"), (("combo", "ccs"), "ccs"), (("tesla", "supercharger"), "tesla"),
    (("schuko", "haushalt", "typf"), "schuko"), (("cee", "kraftstrom", "starkstrom"), "cee"),
    (("typ2", "type2", "mennekes"), "type2"),
)
STATE_SPELLINGS = {
    "BW": ("Baden-Württemberg", "Baden-Wurttemberg", "BaWü"), "BY": ("Bayern", "Freistaat Bayern", "Bavaria", "Bay"),
    "BE": ("Berlin",), "BB": ("Brandenburg",), "HB": ("Bremen", "Freie Hansestadt Bremen"),
    "HH": ("Hamburg", "Freie und Hansestadt Hamburg"), "HE": ("Hessen", "Hesse"),
    "MV": ("Mecklenburg-Vorpommern", "MeckPomm"), "NI": ("Niedersachsen", "Lower Saxony", "NDS"),
    "NW": ("Nordrhein-Westfalen", "NRW", "North Rhine-Westphalia"), "RP": ("Rheinland-Pfalz", "Rhineland-Palatinate"),
    "SL": ("Saarland",), "SN": ("Sachsen", "Freistaat Sachsen", "Saxony"), "ST": ("Sachsen-Anhalt", "Saxony-Anhalt"),
    "SH": ("Schleswig-Holstein",), "TH": ("Thüringen", "Freistaat Thüringen", "Thuringia"),
}
CONGESTION_SEVERITY = {"STATIONARY_TRAFFIC": "severe", "QUEUING_TRAFFIC": "high", "SLOW_TRAFFIC": "moderate"}
CLOSED_SYMBOL = "CLOSED"
SHORT_TERM_ROADWORKS = "SHORT_TERM_ROADWORKS"
_DATE = r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})"
_CLOCK = r"(?:\s*um\s*(\d{1,2}):(\d{2})\s*Uhr)?"
BEGIN_PATTERN = r"Beginn:\s*" + _DATE + _CLOCK
END_PATTERN = r"Ende:\s*" + _DATE + _CLOCK
INTERVAL_PATTERN = _DATE + r"\s+(\d{1,2}):(\d{2})\s+bis\s+zum\s+" + _DATE + r"\s+(\d{1,2}):(\d{2})\s*Uhr"
RANGE_PATTERN = r"zwischen\s+dem\s+" + _DATE + r"\s+und\s+dem\s+" + _DATE
CENTURY_PIVOT = 80
SNOW_C, WET_MM, STORM_MS, FOG_PERCENT, CLOUD_PERCENT = 0.5, 0.1, 17.2, 98.0, 85.0
MISSING = -999.0


def parse_decimal(text: Column) -> Column:
    """Decimal comma; dots are thousands separators only next to a comma. Bad or negative text is NULL."""
    german = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), ",", ".")
    value = F.when(F.contains(text, F.lit(",")), german).otherwise(text).try_cast("double")
    return F.when(value >= 0, value)


def parse_date(text: Column) -> Column:
    return F.try_to_date(text, "dd.MM.yyyy")


def parse_mess_datum(text: Column) -> Column:
    """UTC stamp of twelve (to the minute) or ten (to the hour) digits."""
    stamp = F.trim(text)
    padded = F.when(F.length(stamp) == 12, stamp).when(F.length(stamp) == 10, F.concat(stamp, F.lit("00")))
    return F.try_to_timestamp(padded, F.lit("yyyyMMddHHmm"))


def parse_iso(text: Column) -> Column:
    """ISO-8601; without a zone it is UTC."""
    return text.try_cast("timestamp")


def _squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def connector_type(text: Column) -> Column:
    key = _squash(text)
    out = F.when(F.coalesce(key, F.lit("")).isin("", *CONNECTOR_UNKNOWN), "unknown")
    for words, kind in CONNECTOR_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | key.contains(word)
        out = out.when(hit, kind)
    return out.otherwise("other")


def current_type(text: Column, connector: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return (
        F.when(upper.startswith("DC") | upper.contains(" DC "), "dc").when(upper.startswith("AC") | upper.contains(" AC "), "ac")
        .when(connector.isin("ccs", "chademo"), "dc").when(connector.isin("type2", "schuko", "cee"), "ac").otherwise("unknown")
    )


def place_key(text: Column) -> Column:
    """Lower case, umlauts written out, letters and digits only."""
    folded = F.lower(F.trim(text))
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        folded = F.replace(folded, F.lit(umlaut), F.lit(plain))
    return _squash(folded)


def _state_table() -> dict[str, str]:
    def fold(name: str) -> str:
        name = name.strip().lower()
        for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            name = name.replace(umlaut, plain)
        return "".join(c for c in name if c.isalnum())

    return {fold(name): code for code, names in STATE_SPELLINGS.items() for name in (code, *names)}


def state_code(text: Column) -> Column:
    """Two-letter state for a name in any known spelling; a ``DE-`` prefix is tolerated."""
    table = F.create_map(*(F.lit(part) for item in _state_table().items() for part in item))
    key = place_key(text)
    stripped = F.when(key.startswith("de"), key.substr(F.lit(3), F.length(key)))
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, stripped))


def synthetic_id(*columns: str) -> Column:
    """32 hexadecimal digits over the NUL-joined parts."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def split_multi(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _pick(values: Column, position: Column) -> Column:
    """Value at the position; a single value stands for every position."""
    return F.when(F.size(values) == 1, values[0]).otherwise(F.get(values, position))


def connectors(groups: list[tuple[str, str, str]]) -> Column:
    """Array of connectors from (type, power, key) column groups whose cells may hold several values."""
    def expand(kind: str, power: str, key: str) -> Column:
        kinds, powers, keys = (split_multi(F.col(c)) for c in (kind, power, key))
        count = F.greatest(F.size(kinds), F.size(powers))
        positions = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            raw = _pick(kinds, i)
            connector = connector_type(raw)
            return F.struct(
                connector.alias("connector_type"), current_type(raw, connector).alias("current_type"),
                parse_decimal(_pick(powers, i)).alias("power_kw"), _pick(keys, i).alias("public_key"),
            )

        return F.transform(positions, one)

    per_group = [expand(*group) for group in groups]
    return F.flatten(F.array(*per_group))


# ---- traffic messages


def _berlin(day: Column, month: Column, year: Column, hour: Column, minute: Column) -> Column:
    """Civil time in Berlin to UTC; impossible dates are NULL, a missing clock time is midnight."""
    number = year.try_cast("int")
    full = F.when(number >= 100, number).when(number < CENTURY_PIVOT, number + 2000).otherwise(number + 1900)
    text = F.format_string(
        "%04d-%02d-%02d %02d:%02d", full, month.try_cast("int"), day.try_cast("int"),
        F.coalesce(F.nullif(hour, F.lit("")).try_cast("int"), F.lit(0)), F.coalesce(F.nullif(minute, F.lit("")).try_cast("int"), F.lit(0)),
    )
    local = F.when(full.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))
    return F.to_utc_timestamp(local, "Europe/Berlin")


def _all_matches(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Moments of every match of a pattern; ``groups`` name day, month, year and optionally hour, minute."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def moment(match: Column) -> Column:
        parts = [F.regexp_extract(match, pattern, g) for g in groups] + [F.lit("")] * (5 - len(groups))
        return _berlin(*parts)

    return F.transform(whole, moment)


def extract_validity(text: Column) -> tuple[Column, Column]:
    """Earliest start and latest end stated in a message, in UTC."""
    def labelled(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 0) != ""
        parts = [F.regexp_extract(text, pattern, g) for g in (1, 2, 3, 4, 5)]
        return F.array(F.when(found, _berlin(*parts)))

    starts = F.concat(labelled(BEGIN_PATTERN), _all_matches(text, INTERVAL_PATTERN, (1, 2, 3, 4, 5)), _all_matches(text, RANGE_PATTERN, (1, 2, 3)))
    ends = F.concat(labelled(END_PATTERN), _all_matches(text, INTERVAL_PATTERN, (6, 7, 8, 9, 10)), _all_matches(text, RANGE_PATTERN, (4, 5, 6)))
    return F.array_min(starts), F.array_max(ends)


def severity(service: Column, display_type: Column, symbols: Column, abnormal: Column) -> Column:
    blocked = F.coalesce(F.array_contains(symbols, CLOSED_SYMBOL), F.lit(False))
    kind = F.upper(F.trim(abnormal))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, level in CONGESTION_SEVERITY.items():
        out = out.when(kind == name, level)
    return (
        out.when((service == "closure") & blocked, "severe").when(service == "closure", "high")
        .when((service == "roadworks") & blocked, "high").when((service == "roadworks") & (display_type == SHORT_TERM_ROADWORKS), "low")
        .when(service == "roadworks", "moderate").when(blocked, "high").otherwise("low")
    )


def event_type(service: Column, abnormal: Column) -> Column:
    return (
        F.when(service.isin("roadworks", "closure"), service)
        .when(F.coalesce(abnormal, F.lit("")) != "", "congestion").otherwise("warning")
    )


def event_coordinate(item: str = "") -> tuple[Column, Column]:
    """Latitude and longitude: coordinate object, else the ``lat,lon`` text, else the first line vertex."""
    def c(name: str) -> Column:
        return F.col(f"{item}.{name}" if item else name)

    parts = F.split(c("point"), ",")
    first = F.get(c("geometry.coordinates"), F.lit(0))
    lat = F.coalesce(c("coordinate.lat"), F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.get(first, F.lit(1)))
    lon = F.coalesce(c("coordinate.long"), F.trim(F.get(parts, F.lit(1))).try_cast("double"), F.get(first, F.lit(0)))
    return lat, lon


# ---- weather


def measurement(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(value > MISSING, value)


def humidity(text: Column) -> Column:
    value = measurement(text)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def pressure(text: Column) -> Column:
    value = measurement(text)
    return F.when(value > 0, value)


def weather_condition(temperature: Column, precipitation: Column, wind: Column, moisture: Column) -> Column:
    wet = precipitation >= WET_MM
    return (
        F.when(wind >= STORM_MS, "storm").when(wet & (temperature <= SNOW_C), "snow").when(wet, "rain")
        .when(moisture >= FOG_PERCENT, "fog").when(moisture >= CLOUD_PERCENT, "clouds").when(moisture.isNotNull(), "clear")
        .when(temperature.isNotNull() | precipitation.isNotNull(), "clear").otherwise("unknown")
    )


def format_number(value: Column, digits: int = 1) -> Column:
    """Fixed digits with a decimal comma."""
    return F.replace(F.format_string(f"%.{digits}f", value), F.lit("."), F.lit(","))
