"""Known values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strom.functions import energy, geo, lookups, text_de
from strom.sources import reference


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_utm_on_the_central_meridian(spark):
    df = spark.createDataFrame([(45.0, 9.0), (0.0, 9.0), (48.1386, 11.5736)], "lat double, lon double")
    rows = geo.with_utm32(df, "lat", "lon", "x", "y").collect()
    # the GRS80 meridian arc to 45 degrees is 4 984 944.378 m
    assert rows[0].x == pytest.approx(500_000.0, abs=1e-6) and rows[0].y == pytest.approx(4_984_944.378 * 0.9996, abs=0.005)
    assert rows[1].y == pytest.approx(0.0, abs=1e-6)
    assert 691_000 < rows[2].x < 692_500 and 5_334_000 < rows[2].y < 5_336_000


def test_haversine_of_missing_coordinates_is_null(spark):
    null = F.lit(None).cast("double")
    row = one(spark, geo.haversine_m(F.lit(50.0), F.lit(8.0), F.lit(51.0), F.lit(8.0)).alias("d"), geo.haversine_m(null, null, F.lit(1.0), F.lit(1.0)).alias("n"))
    assert row.d == pytest.approx(111_195.08, abs=1.0) and row.n is None


def test_charging_a_sedan_from_10_to_80_percent(spark):
    sedan = next(m for m in reference.VEHICLE_MODELS if m[1] == "sedan_ev")
    arguments = [F.lit(v) for v in (sedan[7], sedan[5], 10.0, 80.0, 1000.0, 20.0)]
    row = one(spark, energy.charge_time_minutes(*arguments).alias("m"), energy.charge_time_batch(*arguments).alias("b"))
    assert sedan[5] * 0.7 == pytest.approx(51.80)
    assert row.m == pytest.approx(17.30, abs=0.005)
    assert row.b == pytest.approx(row.m, rel=1e-12)


def test_batch_and_column_charge_time_agree(spark):
    df = spark.range(300).select(
        (F.col("id") % 101).cast("double").alias("a"), (F.col("id") * 7 % 101).cast("double").alias("b"),
        (F.col("id") % 13 * 25.0 + 3.7).alias("kw"), (F.col("id") % 70 - 15.0).alias("t"))
    common = (F.lit(175.0), F.lit(78.0), F.col("a"), F.col("b"), F.col("kw"), F.col("t"))
    rows = df.select(energy.charge_time_minutes(*common).alias("x"), energy.charge_time_batch(*common).alias("y")).collect()
    assert all(r.x == pytest.approx(r.y, rel=1e-9, abs=1e-9) for r in rows)


def test_energy_parts_add_up_and_never_go_negative(spark):
    df = spark.range(400).select(
        (F.col("id") % 20 * 10.0).alias("speed_kmh"), F.lit(60.0).alias("duration_s"), (F.col("id") % 20 / 6.0).alias("distance_km"),
        (F.col("id") % 31 - 15.0).alias("gradient_percent"), (F.col("id") % 60 - 20.0).alias("temperature_c"),
        (F.col("id") % 50 - 10.0).alias("battery_temperature_c"), (F.col("id") % 11 - 5.0).alias("headwind_ms"),
        (F.col("id") % 7 - 3.0).alias("acceleration_ms2"), F.lit(2000.0).alias("mass_kg"), F.lit(0.6).alias("drag_area_m2"),
        F.lit(0.01).alias("rolling_resistance"))
    for r in energy.with_segment_energy(df).collect():
        parts = r.rolling_kwh + r.aero_kwh + r.gradient_kwh + r.inertia_kwh
        assert r.kwh >= 0 and r.kwh == pytest.approx(parts + r.auxiliary_kwh + r.hvac_kwh, abs=1e-9)
        assert r.regen_kwh <= 0


def test_two_climate_curves_differ(spark):
    row = one(spark, energy.hvac_kw_sql(F.lit(0.0)).alias("a"), energy.hvac_kw_physics(F.lit(0.0)).alias("b"), energy.hvac_kw_sql(F.lit(-30.0)).alias("c"))
    assert row.a == pytest.approx(3.5 * 20 / 30) and row.b == pytest.approx(2.2) and row.c == 3.5


def test_unknown_power_is_normal(spark):
    null = F.lit(None).cast("double")
    row = one(spark, lookups.charging_category(null).alias("a"), lookups.energy_intensity(F.lit(20.0), F.lit(0.0)).alias("b"), lookups.in_germany(null, null).alias("c"))
    assert (row.a, row.b, row.c) == ("normal", None, False)


def test_german_texts(spark):
    starts, ends = text_de.extract_validity(F.lit("Beginn: 26.04.26 um 05:00 Uhr\nEnde: 30.09.26 um 20:00 Uhr\n(Ende der Gesamtmaßnahme: 30.10.26)"))
    row = one(spark, text_de.parse_decimal(F.lit("1.234,5")).alias("a"), text_de.parse_decimal(F.lit("1.5")).alias("b"),
              text_de.parse_decimal(F.lit("-3")).alias("c"), text_de.state_code(F.lit(" DE-BW ")).alias("d"), starts.alias("s"), ends.alias("e"))
    assert (row.a, row.b, row.c, row.d) == (1234.5, 1.5, None, "BW")
    assert row.s == dt.datetime(2026, 4, 26, 3, 0) and row.e == dt.datetime(2026, 9, 30, 18, 0)
