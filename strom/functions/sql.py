"""The column rules as SQL functions, for use inside ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strom.functions.energy import HVAC_CURVE_SIMPLE
from strom.functions.lookups import GERMANY_BBOX, ROAD_CLASS_ORDINAL, SEVERITY_DELAY_FACTOR, SEVERITY_ORDINAL


def _case(argument: str, table: dict, default: str) -> str:
    body = " ".join(f"when '{key}' then {value}" for key, value in table.items())
    return f"case {argument} {body} else {default} end"


def _curve(x: str, curve) -> str:
    out = f"case when {x} <= {curve[0][0]}D then {curve[0][1]}D"
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out += f" when {x} < {x1}D then {y0}D + ({x} - ({x0}D)) / ({x1}D - ({x0}D)) * ({y1}D - ({y0}D))"
    return out + f" when {x} is not null then {curve[-1][1]}D end"


_BOX = GERMANY_BBOX
DEFINITIONS = {
    "energy_intensity(actual double, nominal double) returns string":
        "case when nominal > 0 and actual is not null then case when actual / nominal < 0.95D then 'low' when actual / nominal < 1.10D then 'medium' "
        "when actual / nominal < 1.30D then 'high' else 'critical' end end",
    "charging_category(power_kw double) returns string":
        "case when power_kw >= 150D then 'ultra_fast' when power_kw >= 22D then 'fast' else 'normal' end",
    "road_class_ordinal(road_class string) returns int": _case("road_class", ROAD_CLASS_ORDINAL, "0"),
    "severity_ordinal(severity string) returns int": _case("severity", SEVERITY_ORDINAL, "null"),
    "severity_delay_factor(severity string) returns double":
        _case("severity", {k: f"{v}D" for k, v in SEVERITY_DELAY_FACTOR.items()}, "1.0D"),
    "in_germany(latitude double, longitude double) returns boolean":
        f"coalesce(latitude between {_BOX['south']}D and {_BOX['north']}D and longitude between {_BOX['west']}D and {_BOX['east']}D, false)",
    "meters_to_km(metres double) returns double": "round(metres / 1000D, 3)",
    "hvac_load_kw(temperature_c double) returns double": _curve("temperature_c", HVAC_CURVE_SIMPLE),
    "null_if_missing(value double) returns double": "nullif(value, -999D)",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Creates the temporary functions; names of what is available afterwards."""
    for signature, body in DEFINITIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [signature.split("(")[0] for signature in DEFINITIONS]
