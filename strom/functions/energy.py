"""Road-load energy, climate and charging curves as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: physical constants and curves
GRAVITY = 9.80665
AIR_DENSITY = 1.225
AIR_DENSITY_TEMPERATURE_C = 15.0
KELVIN = 273.15
DRIVETRAIN_EFFICIENCY = 0.9
REGEN_EFFICIENCY = 0.65
REGEN_FLOOR_W = -50_000.0
ROTATING_MASS = 1.05
AUXILIARY_KW = 0.35
COLD_BATTERY_REFERENCE_C = 15.0
COLD_BATTERY_PER_KELVIN = 0.008
JOULES_PER_KWH = 3_600_000.0
HVAC_CURVE = (
    (-20.0, 4.5), (-10.0, 3.5), (0.0, 2.2), (10.0, 0.9), (20.0, 0.0), (25.0, 0.5), (30.0, 1.2), (35.0, 2.0), (45.0, 3.2),
)
HVAC_CURVE_SIMPLE = ((-10.0, 3.5), (20.0, 0.0), (35.0, 2.0))
SOC_TAPER = ((0.0, 1.0), (50.0, 1.0), (80.0, 0.55), (100.0, 0.18))
TEMPERATURE_DERATE = (
    (-20.0, 0.15), (-10.0, 0.25), (0.0, 0.5), (10.0, 1.0), (45.0, 1.0), (50.0, 0.7), (55.0, 0.4), (60.0, 0.25),
)
MIN_CHARGING_KW = 1.0
CHARGE_STEP_PERCENT = 0.25
MAX_CHARGE_STEPS = 400


def piecewise_linear(curve: Sequence[tuple[float, float]], x: Column) -> Column:
    """Clamped linear interpolation through the breakpoints; NULL in, NULL out."""
    out = F.when(x <= curve[0][0], F.lit(curve[0][1]))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out = out.when(x < x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(curve[-1][1])))


def hvac_kw_sql(temperature_c: Column) -> Column:
    """Three-anchor climate load used for attribution in the marts."""
    return piecewise_linear(HVAC_CURVE_SIMPLE, temperature_c)


def hvac_kw_physics(temperature_c: Column) -> Column:
    """Nine-anchor climate load used by the road-load model."""
    return piecewise_linear(HVAC_CURVE, temperature_c)


def cold_factor(battery_temperature_c: Column) -> Column:
    deficit = F.greatest(F.lit(0.0), F.lit(COLD_BATTERY_REFERENCE_C) - battery_temperature_c)
    return F.lit(1.0) + deficit * COLD_BATTERY_PER_KELVIN


def headwind_ms(wind_speed_ms: Column, wind_direction_deg: Column, heading_deg: Column) -> Column:
    return wind_speed_ms * F.cos(F.radians(wind_direction_deg - heading_deg))


@dataclass(frozen=True)
class Drive:
    """Columns the road-load model reads. Vehicle columns carry the profile of the row's vehicle."""

    distance_km: Column
    speed_kmh: Column
    duration_s: Column
    gradient_percent: Column
    temperature_c: Column
    battery_temperature_c: Column
    headwind_ms: Column
    acceleration_ms2: Column
    mass_kg: Column
    drag_area_m2: Column
    rolling_resistance: Column

    @classmethod
    def of(cls, **overrides: Column) -> Drive:
        """Columns named like the fields, the given ones replaced."""
        names = cls.__dataclass_fields__
        columns = {name: overrides.get(name, F.col(name)) for name in names}
        return cls(**columns)


ENERGY_FIELDS = (
    "kwh", "rolling_kwh", "aero_kwh", "gradient_kwh", "inertia_kwh", "auxiliary_kwh", "hvac_kwh", "regen_kwh",
)


def _wheel_watts(d: Drive) -> dict[str, Column]:
    speed = d.speed_kmh / 3.6
    slope = F.atan(d.gradient_percent / 100.0)
    kelvin = F.lit(KELVIN) + d.temperature_c
    density = F.when(
        kelvin > 0, F.lit(AIR_DENSITY * (KELVIN + AIR_DENSITY_TEMPERATURE_C)) / kelvin
    ).otherwise(F.lit(AIR_DENSITY))
    air_speed = speed + d.headwind_ms
    return {
        "rolling": d.rolling_resistance * d.mass_kg * GRAVITY * F.cos(slope) * speed,
        "aero": density * 0.5 * d.drag_area_m2 * air_speed * F.abs(air_speed) * speed,
        "gradient": d.mass_kg * GRAVITY * F.sin(slope) * speed,
        "inertia": d.mass_kg * d.acceleration_ms2 * ROTATING_MASS * speed,
    }


def battery_watts(wheel_w: Column, battery_temperature_c: Column) -> Column:
    """Drawn through the drivetrain, or recovered down to the regeneration floor."""
    cold = cold_factor(battery_temperature_c)
    recovered = F.greatest(wheel_w * REGEN_EFFICIENCY / cold, F.lit(REGEN_FLOOR_W))
    return F.when(wheel_w >= 0, wheel_w / DRIVETRAIN_EFFICIENCY * cold).otherwise(recovered)


def with_segment_energy(df, d: Drive | None = None, prefix: str = ""):
    """Adds the energy balance of each row: total, four traction parts, auxiliary, climate, regeneration.

    Staged projections keep every intermediate a plain column, so the whole balance stays in one
    generated stage without repeating sub-expressions.
    """
    d = d or Drive.of()
    watts = _wheel_watts(d)
    moving = (d.duration_s > 0) & (d.speed_kmh > 0)
    parts = tuple(watts)
    zero = F.lit(0.0)
    df = df.withColumns({f"_{p}_w": F.when(moving, watts[p]).otherwise(zero) for p in parts})
    df = df.withColumns({
        "_wheel_w": sum((F.col(f"_{p}_w") for p in parts[1:]), F.col(f"_{parts[0]}_w")),
        "_hours": F.greatest(d.duration_s, zero) / 3600.0,
    })
    df = df.withColumns({
        "_to_kwh": F.when(
            F.col("_wheel_w") != 0,
            battery_watts(F.col("_wheel_w"), d.battery_temperature_c) / F.col("_wheel_w")
            * F.greatest(d.duration_s, zero) / JOULES_PER_KWH,
        ).otherwise(zero),
        "_aux": F.col("_hours") * AUXILIARY_KW,
        "_hvac": hvac_kw_physics(d.temperature_c) * F.col("_hours"),
    })
    df = df.withColumns({f"_{p}": F.col(f"_{p}_w") * F.col("_to_kwh") for p in parts})
    df = df.withColumns({
        "_raw": sum((F.col(f"_{p}") for p in parts[1:]), F.col(f"_{parts[0]}")) + F.col("_aux") + F.col("_hvac"),
        "_negative": sum((F.least(F.col(f"_{p}"), zero) for p in parts[1:]), F.least(F.col(f"_{parts[0]}"), zero)),
    })
    # a net credit is not allowed: negative parts are shrunk until the total is exactly zero
    scale = F.when(
        (F.col("_raw") < 0) & (F.col("_negative") < 0), (F.col("_negative") - F.col("_raw")) / F.col("_negative")
    ).otherwise(F.lit(1.0))
    df = df.withColumn("_scale", scale)
    df = df.withColumns({
        f"{prefix}{p}_kwh": F.when(F.col(f"_{p}") < 0, F.col(f"_{p}") * F.col("_scale")).otherwise(F.col(f"_{p}"))
        for p in parts
    })
    traction = sum((F.col(f"{prefix}{p}_kwh") for p in parts[1:]), F.col(f"{prefix}{parts[0]}_kwh"))
    df = df.withColumns({
        f"{prefix}kwh": F.greatest(F.col("_raw"), zero),
        f"{prefix}auxiliary_kwh": F.col("_aux"),
        f"{prefix}hvac_kwh": F.col("_hvac"),
        f"{prefix}regen_kwh": F.least(zero, traction),
    })
    return df.drop(
        *(f"_{p}_w" for p in parts), *(f"_{p}" for p in parts),
        "_wheel_w", "_hours", "_to_kwh", "_aux", "_hvac", "_raw", "_negative", "_scale",
    )


def instantaneous_power_kw(d: Drive) -> Column:
    """Signed battery power plus auxiliaries."""
    watts = _wheel_watts(d)
    wheel = watts["rolling"] + watts["aero"] + watts["gradient"] + watts["inertia"]
    idle = hvac_kw_physics(d.temperature_c) + AUXILIARY_KW
    drawn = battery_watts(wheel, d.battery_temperature_c) / 1000.0
    return F.when(d.speed_kmh > 0, drawn + idle).otherwise(idle)


def consumption_kwh_per_100km(kwh: Column, distance_km: Column) -> Column:
    return F.when(distance_km > 0, kwh / distance_km * 100.0).when(distance_km == 0, F.lit(0.0))


def charging_power_kw(max_dc_kw: Column, soc: Column, battery_temperature_c: Column) -> Column:
    power = max_dc_kw * piecewise_linear(SOC_TAPER, soc) * piecewise_linear(TEMPERATURE_DERATE, battery_temperature_c)
    return F.when(soc >= 100.0, F.lit(0.0)).otherwise(power)


def charge_time_minutes(
    max_dc_kw: Column, usable_kwh: Column, soc_from: Column, soc_to: Column, station_kw: Column,
    battery_temperature_c: Column,
) -> Column:
    """Midpoint sum over equal steps of at most a quarter percent, never more than 400 of them."""
    width = soc_to - soc_from
    steps = F.greatest(F.lit(1), F.ceil(width / CHARGE_STEP_PERCENT).cast("int"))
    step = width / steps

    def add(total: Column, index: Column) -> Column:
        middle = soc_from + (index + 0.5) * step
        vehicle = F.greatest(charging_power_kw(max_dc_kw, middle, battery_temperature_c), F.lit(MIN_CHARGING_KW))
        return total + usable_kwh * step / 100.0 / F.least(station_kw, vehicle) * 60.0

    total = F.aggregate(F.sequence(F.lit(0), steps - 1), F.lit(0.0), add)
    return F.when(width <= 0, F.lit(0.0)).otherwise(total)


@F.pandas_udf(DoubleType())
def charge_time_batch(
    max_dc_kw: pd.Series, usable_kwh: pd.Series, soc_from: pd.Series, soc_to: pd.Series, station_kw: pd.Series,
    battery_temperature_c: pd.Series,
) -> pd.Series:
    """``charge_time_minutes`` for whole Arrow batches.

    Higher-order functions run interpreted, some hundred steps a row; where a plan evaluates many stops
    the same sum over a steps axis in numpy is two orders of magnitude faster.
    """
    start, width = soc_from.to_numpy(), (soc_to - soc_from).to_numpy()
    steps = np.maximum(1, np.ceil(width / CHARGE_STEP_PERCENT)).astype(int)
    index = np.arange(steps.max() if len(steps) else 0)
    step = (width / steps)[:, None]
    middle = start[:, None] + (index + 0.5) * step
    derate = np.interp(battery_temperature_c.to_numpy(), *zip(*TEMPERATURE_DERATE))
    vehicle = np.interp(middle, *zip(*SOC_TAPER)) * (max_dc_kw.to_numpy() * derate)[:, None]
    vehicle = np.maximum(np.where(middle >= 100.0, 0.0, vehicle), MIN_CHARGING_KW)
    minutes = usable_kwh.to_numpy()[:, None] * step / 100.0 / np.minimum(station_kw.to_numpy()[:, None], vehicle) * 60.0
    total = np.where(index < steps[:, None], minutes, 0.0).sum(axis=1)
    return pd.Series(np.where(width <= 0, 0.0, total))
