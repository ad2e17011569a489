"""Searches and statistics over charging sites."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.operators.quantiles import exact_percentiles
from strom.operators.sliced import with_history
from strom.plans.stations import count_where

CATEGORIES = ("normal", "fast", "ultra_fast")  # fixed values


def bbox(latitude: Column, longitude: Column, west: float, south: float, east: float, north: float) -> Column:
    if west >= east or south >= north:
        raise ValueError("a bounding box is given as west, south, east, north")
    return longitude.between(west, east) & latitude.between(south, north)


def contains_text(term: str, *columns: str) -> Column:
    """Case-insensitive substring match in any column; wildcard characters in the term are literal."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.col(column).ilike(f"%{escaped}%"), F.lit(False))
    return found


def station_filter(
    stations: DataFrame, *, box: tuple[float, float, float, float] | None = None, state: str | None = None,
    operator: str | None = None, min_power_kw: float | None = None, fast_only: bool = False,
    category: str | None = None, commissioned_from: date | None = None, commissioned_to: date | None = None,
    q: str | None = None,
) -> DataFrame:
    """All given conditions must hold; a condition not given does not filter."""
    conditions = [
        bbox(F.col("latitude"), F.col("longitude"), *box) if box else None,
        F.col("bundesland") == state if state else None,
        F.col("operator") == operator if operator else None,
        F.col("max_power_kw") >= min_power_kw if min_power_kw is not None else None,
        F.col("is_fast_charger") if fast_only else None,
        F.col("charging_category") == category if category else None,
        F.col("commissioned_on") >= F.lit(commissioned_from) if commissioned_from else None,
        F.col("commissioned_on") <= F.lit(commissioned_to) if commissioned_to else None,
        contains_text(q, "operator", "city") if q else None,
    ]
    for condition in conditions:
        if condition is not None:
            stations = stations.where(condition)
    return stations


def strongest_first(stations: DataFrame) -> DataFrame:
    return stations.orderBy(F.col("max_power_kw").desc_nulls_last(), F.col("station_id").asc())


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered relation, with the total number of matches on every row."""
    total = ordered.agg(F.count(F.lit(1))).scalar()
    return ordered.offset((number - 1) * size).limit(size).withColumn("total", total)


def geojson_features(stations: DataFrame, cap: int = 20_000) -> DataFrame:
    """The strongest ``cap`` sites as features, with total, truncation flag and extent of what is returned."""
    kept = strongest_first(stations).limit(cap)
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("station_id").alias("id"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.round("longitude", 6), F.round("latitude", 6)).alias("coordinates"),
        ).alias("geometry"),
        F.struct("operator", "city", "charging_category", "is_fast_charger").alias("properties"),
    ))
    extent = kept.agg(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude"))
    west, south, east, north = (extent.select(c).scalar() for c in extent.columns)
    total = stations.agg(F.count(F.lit(1))).scalar()
    return kept.select("station_id", feature.alias("feature")).withColumns({
        "total_matching": total, "west": west, "south": south, "east": east, "north": north,
    }).withColumn("truncated", F.col("total_matching") > cap)


def without_points(stations: DataFrame, points: DataFrame) -> DataFrame:
    """Sites that none of ``points`` belongs to, sites without an id included."""
    return stations.join(points.select("station_id"), "station_id", "left_anti")


def stations_with_points(stations: DataFrame, points: DataFrame, per_row: int = 1000) -> DataFrame:
    """Sites with their connectors nested in ordinal order, at most ``per_row`` of them in one row.

    A site with more goes on in further rows (``part`` 1, 2, ...), so no row or task grows with one site.
    """
    numbered = with_history(
        points.select("station_id", "connector_ordinal", "connector_type", "current_type", "power_kw"), ["station_id"],
        "connector_ordinal", [], 1_000_000.0, number="_n")
    nested = numbered.groupBy("station_id", F.floor((F.col("_n") - 1) / per_row).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("connector_ordinal", "connector_type", "current_type", "power_kw"))).alias("points")
    )
    return stations.join(nested, "station_id", "left").withColumns({
        "part": F.coalesce("part", F.lit(0)), "points": F.coalesce("points", F.array().cast(nested.schema["points"].dataType)),
    })


def connectors_by_state(sites: DataFrame, points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Connectors and fast connectors per state, summed up per site before the join."""
    per_site = points.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("_points"), count_where(F.col("power_kw") >= cfg.fast_kw).alias("_fast"))
    return per_site.join(sites.select("station_id", "bundesland"), "station_id").groupBy("bundesland").agg(
        F.sum("_points").alias("charging_points"), F.sum("_fast").alias("fast_charging_points"))


def statistics_by_state(stations: DataFrame, points: DataFrame, states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    sites = stations.where(F.col("bundesland").isNotNull())
    power = F.coalesce("total_power_kw", "max_power_kw")
    by_state = sites.groupBy("bundesland").agg(
        F.count(F.lit(1)).alias("stations"), F.round(F.coalesce(F.sum(power), F.lit(0.0)), 1).alias("total_kw")
    )
    fast = connectors_by_state(sites, points, cfg).select("bundesland", F.nullif("fast_charging_points", F.lit(0)).alias("fast_points"))
    labels = F.broadcast(states.select("bundesland", "label_de"))  # 16 fixed rows
    return by_state.join(labels, "bundesland").join(fast, "bundesland", "left").withColumn(
        "fast_points", F.coalesce("fast_points", F.lit(0))
    )


def statistics_by_power_class(stations: DataFrame) -> DataFrame:
    """Every class is listed, empty ones with zero."""
    counted = stations.groupBy("charging_category").agg(F.count(F.lit(1)).alias("stations"))
    spine = counted.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "charging_category string")
    return spine.join(counted, "charging_category", "left").withColumn("stations", F.coalesce("stations", F.lit(0)))


def top_operators(stations: DataFrame, top: int = 20) -> DataFrame:
    counted = stations.where(F.col("operator").isNotNull()).groupBy("operator").agg(F.count(F.lit(1)).alias("stations"))
    return counted.orderBy(F.col("stations").desc(), F.col("operator")).limit(top)


def growth(stations: DataFrame) -> DataFrame:
    """Sites per commissioning year with the running total; one row per calendar year."""
    yearly = (
        stations.where(F.col("commissioned_on").isNotNull()).groupBy(F.col("commissioned_year").alias("year"))
        .agg(F.count(F.lit(1)).alias("stations"))
    )
    running = W.orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow)
    return yearly.withColumn("cumulative", F.sum("stations").over(running))


def region_comparison(stations: DataFrame, points: DataFrame, states: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All sixteen states at two grains - sites and connectors - with densities and the unresolved count."""
    sites = stations.where(F.col("bundesland").isNotNull())
    per_site = sites.groupBy("bundesland").agg(
        F.count(F.lit(1)).alias("stations"), F.count_if("is_fast_charger").alias("fast_stations"),
        count_where(F.col("charging_category") == "ultra_fast").alias("ultra_fast_stations"),
        F.count_distinct("operator").alias("operators"),
        F.round(F.coalesce(F.sum(F.coalesce("total_power_kw", "max_power_kw")), F.lit(0.0)), 1).alias("installed_power_kw"),
        F.max("max_power_kw").alias("max_power_kw"),
    )
    median = exact_percentiles(sites, ["bundesland"], F.col("max_power_kw"), {"_median": 0.5}, few_groups=True)
    per_point = connectors_by_state(sites, points, cfg)
    zeros = ("stations", "fast_stations", "ultra_fast_stations", "operators", "charging_points", "fast_charging_points")
    resolved = stations.agg(F.count("bundesland")).scalar()
    total = stations.agg(F.count(F.lit(1))).scalar()

    def density(column: str) -> Column:
        return F.round(F.col(column) * 1000.0 / F.col("area_km2"), 2)

    return (
        states.join(per_site, "bundesland", "left").join(median, "bundesland", "left").join(per_point, "bundesland", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})
        .withColumns({
            "installed_power_kw": F.coalesce("installed_power_kw", F.lit(0.0)),
            "median_station_power_kw": F.round("_median", 1),
            "stations_per_1000_km2": density("stations"),
            "fast_stations_per_1000_km2": density("fast_stations"),
            "charging_points_per_1000_km2": density("charging_points"),
            "_resolved": resolved, "_total": total,
        })
        .withColumns({
            "share_of_resolved_stations_percent": F.coalesce(
                F.round(F.when(F.col("_resolved") > 0, F.col("stations") * 100.0 / F.col("_resolved")), 2), F.lit(0.0)
            ),
            "stations_without_bundesland": F.col("_total") - F.col("_resolved"),
        })
        .drop("_median", "_resolved", "_total")
    )
