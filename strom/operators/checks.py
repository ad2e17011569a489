"""Table checks. Each returns the violating rows, so an empty result means the check passed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.functions.lookups import in_germany, seconds_between
from strom.operators.sizes import join_to_dimension


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once; NULLs in a combination collide."""
    rows = df if len(columns) > 1 else df.where(F.col(columns[0]).isNotNull())
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def accepted_range(
    df: DataFrame, column: str, minimum: float | None = None, maximum: float | None = None, inclusive: bool = True
) -> DataFrame:
    if minimum is None and maximum is None:
        raise ValueError("give a minimum or a maximum")
    value, outside = F.col(column), F.lit(False)
    if minimum is not None:
        outside = outside | (value < minimum if inclusive else value <= minimum)
    if maximum is not None:
        outside = outside | (value > maximum if inclusive else value >= maximum)
    return df.where(outside)


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    """An unknown outcome counts as a failure."""
    return df.where(~F.coalesce(F.expr(expression), F.lit(False)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spine_complete(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys missing from, unexpected in, or repeated in ``actual``."""
    def tagged(df: DataFrame, label: str, count: Column) -> DataFrame:
        return df.select(key, F.lit(label).alias("violation"), count.cast("int").alias("row_count"))

    return _union([
        tagged(expected.join(actual, key, "left_anti"), "missing_from_mart", F.lit(0)),
        tagged(actual.join(expected, key, "left_anti"), "not_in_reference", F.lit(1)),
        tagged(unique(actual, key), "duplicated_in_mart", F.col("occurrences")),
    ])


def connector_provenance(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Connectors whose source or origin differs from their site's."""
    parent = stations.select(
        "station_id", "external_id", F.col("source_system").alias("station_source_system"),
        F.col("data_origin").alias("station_data_origin"),
    )
    child = points.select(
        "charging_point_id", "station_id", "connector_ordinal", F.col("source_system").alias("connector_source_system"),
        F.col("data_origin").alias("connector_data_origin"),
    )
    same = F.col("connector_source_system").eqNullSafe(F.col("station_source_system")) & F.col(
        "connector_data_origin"
    ).eqNullSafe(F.col("station_data_origin"))
    return join_to_dimension(child, parent, ["station_id"], "inner", 200_000, F.col("charging_point_id")).where(~same)


def outside_germany(sources: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """``sources``: model name to (rows, id column, label column)."""
    return _union([
        df.where(~in_germany(F.col("latitude"), F.col("longitude"))).select(
            F.lit(name).alias("source_model"), identifier.cast("string").alias("entity_id"),
            label.cast("string").alias("entity_label"), "latitude", "longitude",
        )
        for name, (df, identifier, label) in sources.items()
    ])


def in_the_future(sources: Sequence[tuple[str, str, DataFrame]], as_of: datetime, tolerance_minutes: float = 2.0) -> DataFrame:
    """``sources``: (model, timestamp column, rows with vehicle_id and trip_id)."""
    now = F.lit(as_of)
    parts = []
    for model, column, df in sources:
        ahead = seconds_between(now, F.col(column)) / 60.0
        parts.append(df.where(ahead > tolerance_minutes).select(
            F.lit(model).alias("source_model"), F.lit(column).alias("offending_field"), F.col("vehicle_id").alias("entity_id"),
            "trip_id", F.col(column).alias("offending_timestamp"), F.round(ahead, 2).alias("minutes_in_future"),
        ))
    return _union(parts)


def orphan_segments(segments: DataFrame, routes: DataFrame, slack: float = 1.01) -> DataFrame:
    """Segments without a route, starting behind its end, or overrunning it."""
    parent = routes.select(
        "route_id", F.col("distance_m").alias("_route_m"), F.col("distance_km").alias("route_distance_km"),
        F.lit(True).alias("_known"),
    )
    end = F.col("_route_m") * slack
    kinds = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "missing_parent_route"),
        F.when(F.col("start_offset_m") > end, "segment_starts_past_route_end"),
        F.when(F.col("start_offset_m") + F.col("segment_distance_m") > end, "segment_overruns_route_end"),
    ))
    return segments.join(parent, "route_id", "left").select(
        F.explode(kinds).alias("violation"), "route_segment_id", "route_id", "segment_ordinal", "start_offset_km",
        "segment_distance_km", "route_distance_km",
    )


def positive_power(points: DataFrame, stations: DataFrame) -> DataFrame:
    def offending(df: DataFrame, model: str, field: str, entity: str, ordinal: Column) -> DataFrame:
        return df.where(F.col(field) <= 0).select(
            F.lit(model).alias("source_model"), F.lit(field).alias("offending_field"), F.col(entity).alias("entity_id"),
            "station_id", ordinal.alias("connector_ordinal"), F.col(field).alias("offending_value"),
        )

    none = F.lit(None).cast("int")
    return _union([
        offending(points, "stg_charging_points", "power_kw", "charging_point_id", F.col("connector_ordinal")),
        offending(stations, "stg_charging_stations", "max_power_kw", "station_id", none),
        offending(stations, "stg_charging_stations", "total_power_kw", "station_id", none),
    ])


def soc_bounds(telemetry: DataFrame, trips: DataFrame) -> DataFrame:
    """A telemetry row without a state of charge is a violation, a trip end only if out of bounds."""
    def offending(df: DataFrame, model: str, field: str, at: Column, condition: Column) -> DataFrame:
        return df.where(condition).select(
            F.lit(model).alias("source_model"), F.lit(field).alias("offending_field"), F.col("vehicle_id").alias("entity_id"),
            "trip_id", at.alias("observed_at"), F.col(field).alias("offending_value"),
        )

    def outside(field: str) -> Column:
        return ~F.col(field).between(0.0, 100.0)

    soc, start, end = "battery_soc_percent", "measured_start_soc_percent", "measured_end_soc_percent"
    return _union([
        offending(telemetry, "fct_vehicle_telemetry", soc, F.col("recorded_at"), F.coalesce(outside(soc), F.lit(True))),
        offending(trips, "fct_trips", start, F.col("started_at"), outside(start)),
        offending(trips, "fct_trips", end, F.coalesce("ended_at", "started_at"), outside(end)),
    ])


def energy_reconciles(trips: DataFrame, tolerance_kwh: float = 0.5, tolerance_percent: float = 5.0) -> DataFrame:
    """Finished trips whose two energy accounts differ by both tolerances."""
    relative = (F.col("reported_energy_kwh") <= 0) | (F.abs("energy_divergence_percent") > tolerance_percent)
    finished = ~F.col("is_running") & (F.col("telemetry_point_count") > 0) & F.col("measured_energy_kwh").isNotNull()
    return trips.where(finished & (F.abs("energy_divergence_kwh") > tolerance_kwh) & relative).select(
        "trip_id", "vehicle_id", "telemetry_point_count", "anomalous_step_count", "reported_energy_kwh",
        "measured_energy_kwh", "energy_divergence_kwh", "energy_divergence_percent",
    )


def source_freshness(tables: dict[str, tuple[DataFrame, str, float, float]], as_of: datetime) -> DataFrame:
    """``tables``: name to (rows, timestamp column, warn after hours, error after hours). Empty counts as stale."""
    parts = []
    for name, (df, column, warn, error) in tables.items():
        newest = df.agg(F.max(column).alias("newest_at"))
        age = seconds_between(F.col("newest_at"), F.lit(as_of)) / 3600.0
        status = F.when(age.isNull() | (age > error), "error").when(age > warn, "warn").otherwise("pass")
        parts.append(newest.select(F.lit(name).alias("table_name"), "newest_at", F.round(age, 3).alias("age_hours"), status.alias("status")))
    return _union(parts)


def load_gate(
    runs: DataFrame, previous_sha: Column, min_accepted: int, max_reject_ratio: float
) -> DataFrame:
    """Whether a run's rows may be published: unchanged files are skipped, thin or dirty runs held back."""
    ratio = F.when(F.col("rows_received") > 0, F.col("rows_rejected") / F.col("rows_received")).otherwise(F.lit(0.0))
    verdict = (
        F.when(F.col("source_file_sha256").eqNullSafe(previous_sha), "skip")
        .when(F.col("rows_accepted") < min_accepted, "too_few_rows")
        .when(ratio > max_reject_ratio, "too_many_rejects").otherwise("publish")
    )
    return runs.withColumns({"reject_ratio": F.round(ratio, 6), "verdict": verdict})


# fixed value: order of provider modes, the last is the weakest
MODE_RANK = ("live", "cache", "fixture")


def weakest_mode(mode: str) -> Column:
    rank = F.array_position(F.array(*(F.lit(m) for m in MODE_RANK)), F.col(mode))
    return F.max_by(F.col(mode), rank)


def stored_mode(mode: Column) -> Column:
    """Mode of a row that was read from storage: it is no longer live, and test data stays test data."""
    return F.when(mode == "fixture", "fixture").otherwise("cache")
