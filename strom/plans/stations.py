"""Charging-site models: reconciled power, site dimension, per-state infrastructure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.lookups import charging_category, share_percent
from strom.operators.quantiles import exact_percentiles
from strom.session import cut_lineage


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def distinct_text(column: str) -> Column:
    """Distinct values in order, comma separated. For columns with a bounded set of values."""
    joined = F.array_join(F.array_sort(F.collect_set(column)), ", ")
    return F.nullif(joined, F.lit(""))


def connector_rollup(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per site: connector counts by class, power figures, plug flags."""
    power = F.col("power_kw")
    return points.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("connector_count"),
        F.count(power).alias("rated_connector_count"),
        count_where(F.col("current_type") == "dc").alias("dc_connector_count"),
        count_where(F.col("current_type") == "ac").alias("ac_connector_count"),
        count_where(power >= cfg.fast_kw).alias("fast_connector_count"),
        count_where(power >= cfg.ultra_fast_kw).alias("ultra_fast_connector_count"),
        count_where(power < cfg.normal_below_kw).alias("normal_connector_count"),
        F.max(power).alias("connector_max_power_kw"),
        F.sum(power).alias("connector_sum_power_kw"),
        F.avg(power).alias("connector_avg_power_kw"),
        *(F.bool_or(F.col("connector_type") == kind).alias(f"has_{kind}") for kind in ("ccs", "type2", "chademo")),
        distinct_text("connector_type").alias("connector_types"),
    )


def station_power(stations: DataFrame, points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Reconciles the power a site declares with the power its connectors add up to."""
    counts = [c for c in connector_rollup(points, cfg).columns if c.endswith("_count")]
    site = stations.select(
        "station_id", "external_id", "bundesland", F.col("charging_category").alias("declared_charging_category"),
        F.col("max_power_kw").alias("declared_max_power_kw"), F.col("total_power_kw").alias("declared_total_power_kw"),
        F.col("charging_points_count").alias("declared_connector_count"),
    )
    declared, measured = F.col("declared_max_power_kw"), F.col("connector_max_power_kw")
    joined = site.join(connector_rollup(points, cfg), "station_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
        | {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_ccs", "has_type2", "has_chademo")}
    )
    strongest = F.col("effective_max_power_kw")
    return joined.withColumns({
        "effective_max_power_kw": F.greatest(declared, measured),
        "effective_total_power_kw": F.coalesce("declared_total_power_kw", "connector_sum_power_kw"),
        "power_basis": F.when(declared.isNotNull() & measured.isNotNull(), "both")
        .when(measured.isNotNull(), "connectors").when(declared.isNotNull(), "site").otherwise("none"),
        "power_disagreement_kw": F.abs(declared - measured),
        "connector_count_delta": F.col("connector_count") - F.col("declared_connector_count"),
    }).withColumns({
        "effective_charging_category": charging_category(strongest),
        "is_fast_charger": F.coalesce(strongest >= cfg.fast_kw, F.lit(False)),
        "is_ultra_fast_charger": F.coalesce(strongest >= cfg.ultra_fast_kw, F.lit(False)),
    })


def dim_charging_station(
    stations: DataFrame, points: DataFrame, states: DataFrame, cfg: Config = DEFAULT
) -> DataFrame:
    """Site dimension: cleaned site, reconciled power, state label, category disagreement."""
    site = stations.withColumnsRenamed({
        "charging_points_count": "declared_connector_count", "max_power_kw": "declared_max_power_kw",
        "total_power_kw": "declared_total_power_kw", "is_fast_charger": "declared_is_fast_charger",
    })
    power = station_power(stations, points, cfg).drop(
        "external_id", "bundesland", "declared_charging_category", "declared_max_power_kw", "declared_total_power_kw",
        "declared_connector_count", "connector_max_power_kw", "connector_sum_power_kw", "connector_avg_power_kw",
    )
    label = F.broadcast(states.select("bundesland", F.col("label_de").alias("bundesland_label_de")))  # 16 fixed rows
    return site.join(power, "station_id", "left").join(label, "bundesland", "left").withColumn(
        "has_category_disagreement", ~F.col("charging_category").eqNullSafe(F.col("effective_charging_category"))
    )


def months_before(as_of: datetime, months: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -months)


def commissioning_by_year(stations: DataFrame) -> DataFrame:
    return (
        stations.where(F.col("bundesland").isNotNull() & F.col("commissioned_year").isNotNull())
        .groupBy("bundesland", "commissioned_year").agg(F.count(F.lit(1)).alias("station_count"))
    )


def charging_infrastructure(
    dim_station: DataFrame, states: DataFrame, as_of: datetime, cfg: Config = DEFAULT
) -> DataFrame:
    """Per-state infrastructure report. All sixteen states appear, empty ones with zeros."""
    sites = cut_lineage(dim_station.where(F.col("bundesland").isNotNull()))
    dated = F.col("commissioned_on")
    counted = {
        "station_count": F.count(F.lit(1)),
        "fast_station_count": F.count_if("is_fast_charger"),
        "ultra_fast_station_count": F.count_if("is_ultra_fast_charger"),
        "normal_station_count": count_where(F.col("effective_charging_category") == "normal"),
        "operator_count": F.count_distinct("operator"),
        "charging_point_count": F.sum("connector_count"),
        "fast_charging_point_count": F.sum("fast_connector_count"),
        "ultra_fast_charging_point_count": F.sum("ultra_fast_connector_count"),
        "ac_charging_point_count": F.sum("ac_connector_count"),
        "dc_charging_point_count": F.sum("dc_connector_count"),
        "stations_without_power_count": count_where(F.col("power_basis") == "none"),
        "stations_with_category_disagreement_count": F.count_if("has_category_disagreement"),
        "stations_with_commissioning_date_count": F.count(dated),
        "stations_commissioned_last_12m": count_where(dated >= months_before(as_of, 12)),
        "stations_commissioned_last_36m": count_where(dated >= months_before(as_of, 36)),
        "official_station_count": count_where(F.col("data_origin") == "official"),
    }
    rollup = sites.groupBy("bundesland").agg(
        *(c.alias(n) for n, c in counted.items()),
        F.sum(F.coalesce("effective_total_power_kw", "effective_max_power_kw")).alias("_power_kw"),
        F.max("effective_max_power_kw").alias("max_station_power_kw"),
        F.min(dated).alias("first_commissioned_on"), F.max(dated).alias("latest_commissioned_on"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )
    middle = exact_percentiles(
        sites, ["bundesland"], F.col("effective_max_power_kw"), {"_p50": 0.5, "_p90": 0.9}, few_groups=True
    )
    by_year = commissioning_by_year(sites)
    series = by_year.groupBy("bundesland").agg(
        F.array_sort(F.collect_list(F.struct("commissioned_year", "station_count"))).alias("_years"),
        F.max(F.struct("station_count", "commissioned_year")).alias("_peak"),
    )
    years = F.array_join(
        F.transform("_years", lambda y: F.format_string('"%d": %d', y.commissioned_year, y.station_count)), ", "
    )
    density, power = 1000.0, F.coalesce("_power_kw", F.lit(0.0))
    older = F.col("stations_with_commissioning_date_count") - F.col("stations_commissioned_last_12m")
    spine = states.select("bundesland", F.col("label_de").alias("bundesland_label_de"), "area_km2")
    report = (
        spine.join(rollup, "bundesland", "left").join(middle, "bundesland", "left").join(series, "bundesland", "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counted})
        .withColumns({
            "installed_power_kw": F.round(power, 1),
            "median_station_power_kw": F.round("_p50", 1),
            "p90_station_power_kw": F.round("_p90", 1),
            "stations_per_1000_km2": F.round(F.col("station_count") * density / F.col("area_km2"), 2),
            "fast_stations_per_1000_km2": F.round(F.col("fast_station_count") * density / F.col("area_km2"), 2),
            "charging_points_per_1000_km2": F.round(F.col("charging_point_count") * density / F.col("area_km2"), 2),
            "installed_kw_per_1000_km2": F.round(power * density / F.col("area_km2"), 1),
            "fast_station_share_percent": share_percent(F.col("fast_station_count"), F.col("station_count")),
            "fast_charging_point_share_percent": share_percent(
                F.col("fast_charging_point_count"), F.col("charging_point_count")
            ),
            "mean_connectors_per_station": F.round(
                F.when(F.col("station_count") > 0, F.col("charging_point_count") / F.col("station_count")), 2
            ),
            "peak_commissioning_year": F.col("_peak.commissioned_year"),
            "peak_commissioning_year_station_count": F.col("_peak.station_count"),
            "stations_by_commissioning_year": F.concat(F.lit("{"), F.coalesce(years, F.lit("")), F.lit("}")),
            "expansion_rate_12m_percent": share_percent(F.col("stations_commissioned_last_12m"), older),
        })
    )
    return with_ranks(report).drop("_power_kw", "_p50", "_p90", "_years", "_peak")


def with_ranks(report: DataFrame) -> DataFrame:
    """Shares of the total and four competition ranks over the sixteen state rows."""
    everything = W.partitionBy()
    ranks = {
        "rank_by_station_count": F.col("station_count"),
        "rank_by_station_density": F.col("stations_per_1000_km2"),
        "rank_by_installed_power": F.col("installed_power_kw"),
        "rank_by_fast_station_share": F.coalesce("fast_station_share_percent", F.lit(-1.0)),
    }
    return report.withColumns({
        "share_of_resolved_stations_percent": share_percent(
            F.col("station_count"), F.sum("station_count").over(everything), 2
        ),
        "share_of_resolved_power_percent": share_percent(
            F.col("installed_power_kw"), F.sum("installed_power_kw").over(everything), 2
        ),
        **{name: F.rank().over(W.orderBy(column.desc())) for name, column in ranks.items()},
    })
