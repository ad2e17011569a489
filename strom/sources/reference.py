"""Fixed reference rows: vehicle profiles and federal states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: generic vehicle profiles
# id, code, display name, class, battery kWh, usable kWh, kWh/100km, DC kW, AC kW, kg, cd, m2, rolling resistance
VEHICLE_MODELS = (
    ("vm-0", "compact_ev", "Kompaktklasse EV", "compact", 58.0, 54.0, 15.5, 120.0, 11.0, 1700.0, 0.27, 2.20, 0.010),
    ("vm-1", "sedan_ev", "Limousine EV", "sedan", 77.0, 74.0, 16.5, 205.0, 11.0, 2100.0, 0.23, 2.30, 0.010),
    ("vm-2", "performance_ev", "Performance EV", "performance", 93.0, 84.0, 20.0, 270.0, 11.0, 2200.0, 0.25, 2.35, 0.011),
    ("vm-3", "suv_ev", "SUV EV", "suv", 84.0, 78.0, 19.5, 175.0, 11.0, 2400.0, 0.29, 2.65, 0.011),
    ("vm-4", "van_ev", "Transporter EV", "van", 64.0, 60.0, 23.0, 110.0, 11.0, 2500.0, 0.33, 3.30, 0.012),
)
VEHICLE_MODEL_COLUMNS = (
    "id", "code", "display_name", "vehicle_class", "battery_capacity_kwh", "usable_capacity_kwh",
    "nominal_consumption_kwh_100km", "max_dc_power_kw", "max_ac_power_kw", "mass_kg", "drag_coefficient",
    "frontal_area_m2", "rolling_resistance",
)

# fixed values: federal states with area in km2
STATES = (
    ("BW", "Baden-Württemberg", 35748.0), ("BY", "Bayern", 70542.0), ("BE", "Berlin", 891.0),
    ("BB", "Brandenburg", 29654.0), ("HB", "Bremen", 420.0), ("HH", "Hamburg", 755.0), ("HE", "Hessen", 21116.0),
    ("MV", "Mecklenburg-Vorpommern", 23295.0), ("NI", "Niedersachsen", 47710.0), ("NW", "Nordrhein-Westfalen", 34112.0),
    ("RP", "Rheinland-Pfalz", 19858.0), ("SL", "Saarland", 2571.0), ("SN", "Sachsen", 18450.0),
    ("ST", "Sachsen-Anhalt", 20459.0), ("SH", "Schleswig-Holstein", 15804.0), ("TH", "Thüringen", 16202.0),
)
STATE_COLUMNS = ("bundesland", "label_de", "area_km2")


def vehicle_models(spark: SparkSession) -> DataFrame:
    """Five generic profiles; a fixed handful of rows, safe to broadcast."""
    types = ["string"] * 4 + ["double"] * 9
    schema = ", ".join(f"{c} {t}" for c, t in zip(VEHICLE_MODEL_COLUMNS, types))
    return spark.createDataFrame(list(VEHICLE_MODELS), schema).selectExpr("*", "true as is_generic")


def states(spark: SparkSession) -> DataFrame:
    """Sixteen federal states; a fixed handful of rows, safe to broadcast."""
    return spark.createDataFrame(list(STATES), "bundesland string, label_de string, area_km2 double")


def _values(rows, columns) -> str:
    def literal(value):
        return f"'{value}'" if isinstance(value, str) else f"cast({value} as double)"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) t({', '.join(columns)})"


def duck_ctes() -> dict[str, str]:
    return {
        "vehicle_models": "select *, true as is_generic from (" + _values(VEHICLE_MODELS, VEHICLE_MODEL_COLUMNS) + ") m",
        "states": _values(STATES, STATE_COLUMNS),
    }
