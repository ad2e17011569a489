"""Enumeration rules and small numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ordinals and factors
ROAD_CLASS_ORDINAL = {
    "motorway": 6, "trunk": 5, "primary": 4, "secondary": 3, "tertiary": 2, "residential": 1, "service": 1, "unknown": 0,
}
SEVERITY_ORDINAL = {"low": 1, "moderate": 2, "high": 3, "severe": 4}
SEVERITY_DELAY_FACTOR = {"low": 1.0, "moderate": 1.15, "high": 1.4, "severe": 2.0}
GERMANY_BBOX = {"south": 47.2, "north": 55.1, "west": 5.8, "east": 15.1}
INTENSITY_LIMITS = ((0.95, "low"), (1.10, "medium"), (1.30, "high"))
CATEGORY_LIMITS = ((22.0, "normal"), (150.0, "fast"))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``table`` at ``key``; ``default`` for anything else, NULL included."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def ladder(value: Column, limits, last: str) -> Column:
    """Label of the first limit the value stays below, else ``last``; NULL stays NULL."""
    out = None
    for limit, label in limits:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return F.when(value.isNotNull(), out.otherwise(last))


def road_class_ordinal(road_class: Column) -> Column:
    return lookup(road_class, ROAD_CLASS_ORDINAL, 0)


def severity_ordinal(severity: Column) -> Column:
    return lookup(severity, SEVERITY_ORDINAL)


def severity_name(ordinal: Column) -> Column:
    return lookup(ordinal, {n: name for name, n in SEVERITY_ORDINAL.items()})


def severity_delay_factor(severity: Column) -> Column:
    return lookup(severity, SEVERITY_DELAY_FACTOR, 1.0)


def charging_category(power_kw: Column) -> Column:
    """An unrated site counts as ``normal``."""
    return F.coalesce(ladder(power_kw, CATEGORY_LIMITS, "ultra_fast"), F.lit("normal"))


def energy_intensity(actual: Column, nominal: Column) -> Column:
    return ladder(F.when(nominal > 0, actual / nominal), INTENSITY_LIMITS, "critical")


def in_germany(latitude: Column, longitude: Column) -> Column:
    """False, never NULL, for a missing coordinate."""
    box = GERMANY_BBOX
    inside = latitude.between(box["south"], box["north"]) & longitude.between(box["west"], box["east"])
    return F.coalesce(inside, F.lit(False))


def round_decimal(value: Column, digits: int) -> Column:
    """Half-away-from-zero on the decimal reading of a double, so 0.98545 from a division rounds up."""
    return F.round(F.round(value, 9), digits)


def km(metres: Column, digits: int = 3) -> Column:
    return F.round(metres / 1000.0, digits)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole`` rounded, NULL unless the whole is positive."""
    return F.round(F.when(whole > 0, part * 100.0 / whole), digits)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def over_limit(speed: Column, limit: Column) -> Column:
    return speed > limit + 5.0
