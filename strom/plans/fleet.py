"""Fleet analytics over telemetry: live state, series, consumption buckets, dashboard, data health."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.lookups import lookup
from strom.operators.quantiles import exact_percentiles
from strom.operators.sizes import salted_join
from strom.operators.sliced import with_history
from strom.plans.station_queries import bbox
from strom.plans.stations import count_where

# fixed values: bucket edges and reference speeds of the consumption analysis
TEMPERATURE_BANDS = (-15.0, 40.0, 11)
SPEED_BANDS = (0.0, 200.0, 10)
CONGESTION_EDGES = ((0.9, 1), (0.7, 2), (0.5, 3))
CONGESTION_LABELS = {1: "low", 2: "moderate", 3: "high", 4: "severe"}
CONGESTION_BOUNDS = {1: (0.9, None), 2: (0.7, 0.9), 3: (0.5, 0.7), 4: (0.0, 0.5)}
REFERENCE_SPEED_KMH = {
    "motorway": 130.0, "trunk": 100.0, "primary": 100.0, "secondary": 80.0, "tertiary": 70.0, "residential": 50.0,
    "service": 30.0,
}
# fixed values: hours until a source counts as delayed; the simulator is not an external source
SOURCE_MAX_AGE_MINUTES = {
    "register": 45 * 24 * 60.0, "weather": 180.0, "traffic": 360.0, "routing": 90 * 24 * 60.0, "geocoder": 90 * 24 * 60.0,
}
# fixed values: licence, attribution and address each source's publisher states
SOURCE_TERMS = {
    "register": ("CC BY 4.0", "Ladesäulenregister der Bundesnetzagentur", "https://www.bundesnetzagentur.de/DE/Fachthemen/ElektrizitaetundGas/E-Mobilitaet/Ladesaeulenkarte/start.html"),
    "weather": ("CC BY 4.0", "Quelle: Deutscher Wetterdienst", "https://opendata.dwd.de/"),
    "traffic": (None, "Daten: Autobahn GmbH des Bundes", "https://verkehr.autobahn.de/o/autobahn/"),
    "routing": ("ODbL 1.0", "© OpenStreetMap-Mitwirkende", "https://router.project-osrm.org/"),
    "geocoder": ("ODbL 1.0", "© OpenStreetMap-Mitwirkende", "https://www.openstreetmap.org/copyright"),
    "simulator": ("Apache-2.0", "Simuliert - keine Messdaten", None),
}
STATUS_ORDER = {"failed": 0, "degraded": 1, "delayed": 2, "healthy": 3, "simulation": 4}
LIVE_COLUMNS = (
    "trip_id", "route_id", "recorded_at", "latitude", "longitude", "heading_deg", "speed_kmh", "battery_soc_percent",
    "battery_temperature_c", "outside_temperature_c", "instantaneous_power_kw", "energy_consumption_kwh_100km",
    "estimated_range_km", "road_class", "vehicle_state",
)


def latest_per_key(df: DataFrame, key: str, ts: str, sequence: str) -> DataFrame:
    """Newest row per key, the first seen winning a tie; rows without a key are skipped.

    Only the extremes are shuffled: a struct maximum combines on the map side.
    """
    others = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(F.col(ts), -F.col(sequence)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def live_vehicles(
    telemetry: DataFrame, vehicles: DataFrame, models: DataFrame, *, since: datetime | None = None,
    box: tuple[float, float, float, float] | None = None, vehicle_ids: Sequence[str] | None = None, cap: int = 1000,
) -> DataFrame:
    """Newest matching sample per vehicle; filters apply before the newest is picked.

    At most ``cap`` vehicles in the order of their ids, 1000 being the most that may be asked for; more is an error.
    """
    if not 1 <= cap <= 1000:
        raise ValueError("cap must be between 1 and 1000")
    rows = telemetry
    if since is not None:
        rows = rows.where(F.col("recorded_at") > F.lit(since))
    if box is not None:
        rows = rows.where(bbox(F.col("latitude"), F.col("longitude"), *box))
    if vehicle_ids:
        rows = rows.where(F.col("vehicle_id").isin(*vehicle_ids))
    newest = latest_per_key(rows.select("vehicle_id", "telemetry_id", *LIVE_COLUMNS), "vehicle_id", "recorded_at", "telemetry_id")
    code = vehicles.select("vehicle_id", "vehicle_model_id").join(
        F.broadcast(models.select("vehicle_model_id", "vehicle_model_code")), "vehicle_model_id", "left"
    ).select("vehicle_id", "vehicle_model_code")
    top = newest.drop("telemetry_id").orderBy("vehicle_id").limit(cap)
    return top.join(code, "vehicle_id", "left").withColumn(
        "model_code", F.coalesce("vehicle_model_code", F.lit("unknown"))
    ).drop("vehicle_model_code")


def fleet_summary(telemetry: DataFrame, vehicles: DataFrame, models: DataFrame) -> DataFrame:
    """Vehicles with their profile and newest sample, most recently seen first."""
    newest = latest_per_key(
        telemetry.select("vehicle_id", "telemetry_id", "recorded_at", "battery_soc_percent", "odometer_m"),
        "vehicle_id", "recorded_at", "telemetry_id",
    ).select("vehicle_id", F.col("recorded_at").alias("last_seen_at"), "battery_soc_percent", "odometer_m")
    profile = models.select("vehicle_model_id", "vehicle_model_code", "display_name", "vehicle_class")
    return (
        vehicles.select("id", "vehicle_id", "state", "simulation_run_id", "vehicle_model_id")
        .join(F.broadcast(profile), "vehicle_model_id").join(newest, "vehicle_id", "left")
        .orderBy(F.col("last_seen_at").desc_nulls_last(), "vehicle_id")
    )


def vehicle_totals(trips: DataFrame) -> DataFrame:
    return trips.groupBy("vehicle_uuid").agg(
        F.count(F.lit(1)).alias("trips_total"),
        F.coalesce(F.sum("reported_distance_m"), F.lit(0.0)).alias("distance_total_m"),
        F.coalesce(F.sum("reported_energy_kwh"), F.lit(0.0)).alias("energy_total_kwh"),
    )


def last_samples(telemetry: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` samples of every vehicle, to be read oldest first."""
    newest = W.partitionBy("vehicle_id").orderBy(F.col("recorded_at").desc(), F.col("telemetry_id").desc())
    kept = telemetry.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")
    return kept.orderBy("vehicle_id", "recorded_at", "telemetry_id")


def trip_series(telemetry: DataFrame, max_points: int = 2000, cfg: Config = DEFAULT) -> DataFrame:
    """Every trip thinned evenly to about ``max_points`` samples, its last sample always kept."""
    rows = telemetry.where(F.col("trip_id").isNotNull()).select(
        "trip_id", "telemetry_id", "recorded_at", "odometer_m", "speed_kmh", "battery_soc_percent",
        "energy_consumption_kwh_100km", "cumulative_energy_kwh", "latitude", "longitude",
    )
    placed = with_history(rows, ["trip_id"], "recorded_at", ["telemetry_id"], cfg.slice_seconds, number="position")
    whole = rows.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("total"), F.min("odometer_m").alias("_start_m")
    )
    stride = F.greatest(F.lit(1), F.ceil(F.col("total") / max_points))
    return (
        salted_join(placed, whole, ["trip_id"], F.col("telemetry_id"), cfg.salt_buckets)
        .where((F.col("position") % stride == 0) | (F.col("position") == F.col("total")))
        .withColumn("offset_km", F.greatest(F.lit(0.0), (F.col("odometer_m") - F.col("_start_m")) / 1000.0))
        .drop("_start_m", "odometer_m", "telemetry_id")
    )


# ---- consumption by one explanatory dimension


def usable() -> Column:
    return (F.col("vehicle_state") == "driving") & (F.col("speed_kmh") > 0)


def congestion_class(speed: Column, limit: Column, road_class: Column) -> Column:
    """1 free flow to 4 severe, from achieved over reference speed; NULL without a reference."""
    reference = F.coalesce(F.nullif(limit, F.lit(0.0)), lookup(road_class, REFERENCE_SPEED_KMH))
    out = None
    for edge, index in CONGESTION_EDGES:
        hit = speed / reference >= edge
        out = F.when(hit, index) if out is None else out.when(hit, index)
    return F.when(reference.isNotNull(), out.otherwise(4)).cast("bigint")


def band_label(bands: tuple[float, float, int], unit: str, index: int) -> tuple[str, float | None, float | None]:
    low, high, count = bands
    width = (high - low) / count
    if index <= 0:
        return f"< {low:g} {unit}", None, low
    if index > count:
        return f">= {high:g} {unit}", high, None
    start = low + (index - 1) * width
    return f"{start:g} to {start + width:g} {unit}", start, start + width


def _dimension(name: str) -> tuple[Column, dict[int, tuple[str, float | None, float | None]]]:
    if name == "traffic":
        index = congestion_class(F.col("speed_kmh"), F.col("speed_limit_kmh"), F.col("road_class"))
        return index, {i: (CONGESTION_LABELS[i], *CONGESTION_BOUNDS[i]) for i in CONGESTION_LABELS}
    bands, unit, column = {
        "temperature": (TEMPERATURE_BANDS, "°C", "outside_temperature_c"),
        "speed": (SPEED_BANDS, "km/h", "speed_kmh"),
    }[name]
    low, high, count = bands
    index = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(count))
    return index, {i: band_label(bands, unit, i) for i in range(count + 2)}


def energy_by_dimension(telemetry: DataFrame, dimension: str, since: datetime | None = None) -> DataFrame:
    """Consumption per bucket of temperature, speed or derived congestion, with the samples left out."""
    index, labels = _dimension(dimension)
    rows = telemetry if since is None else telemetry.where(F.col("recorded_at") >= F.lit(since))
    rows = rows.select(
        F.when(usable(), index).alias("bucket_index"), F.col("energy_consumption_kwh_100km").alias("_kwh"),
        "speed_kmh", "outside_temperature_c",
    )
    grouped = rows.groupBy("bucket_index").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("_kwh").alias("_mean"),
        F.round(F.avg("speed_kmh"), 1).alias("mean_speed_kmh"),
        F.round(F.avg("outside_temperature_c"), 1).alias("mean_temperature_c"),
    )
    inside = rows.where(F.col("bucket_index").isNotNull())
    spread = exact_percentiles(
        inside, ["bucket_index"], F.col("_kwh"), {"_p10": 0.1, "_p50": 0.5, "_p90": 0.9}, few_groups=True
    )
    kept = F.col("bucket_index").isNotNull()
    overall = grouped.where(kept).agg(
        F.round(F.sum(F.col("_mean") * F.col("sample_count")) / F.sum("sample_count"), 2)
    ).scalar()
    excluded = grouped.agg(F.coalesce(F.sum(F.when(~kept, F.col("sample_count"))), F.lit(0))).scalar()
    label = {i: text for i, (text, _, _) in labels.items()}
    lower = {i: low for i, (_, low, _) in labels.items() if low is not None}
    upper = {i: high for i, (_, _, high) in labels.items() if high is not None}
    key = F.col("bucket_index").cast("int")
    return (
        grouped.where(kept).join(spread, "bucket_index", "left")
        .select(
            "bucket_index", lookup(key, label).alias("bucket"), lookup(key, lower).alias("lower_bound"),
            lookup(key, upper).alias("upper_bound"), "sample_count",
            F.round("_mean", 2).alias("mean_kwh_per_100km"), F.round("_p50", 2).alias("median_kwh_per_100km"),
            F.round("_p10", 2).alias("p10_kwh_per_100km"), F.round("_p90", 2).alias("p90_kwh_per_100km"),
            "mean_speed_kmh", "mean_temperature_c",
        )
        .withColumns({"overall_mean_kwh_per_100km": overall, "excluded_samples": excluded})
    )


# ---- dashboard and data health


def moving_only(telemetry: DataFrame, min_kmh: float = 5.0) -> DataFrame:
    return telemetry.where(F.col("speed_kmh") >= min_kmh)


def hourly_trend(telemetry: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    recent = moving_only(telemetry).where(F.col("recorded_at") >= F.lit(as_of - timedelta(hours=hours)))
    return recent.groupBy(F.date_trunc("hour", "recorded_at").alias("bucket")).agg(
        F.avg("energy_consumption_kwh_100km").alias("kwh_100km")
    )


def newest_traffic(events: DataFrame, top: int = 5) -> DataFrame:
    at = F.coalesce("starts_at", "ingested_at")
    return events.withColumn("sort_at", at).orderBy(F.col("sort_at").desc(), "traffic_event_id").limit(top)


def latest_weather(observations: DataFrame) -> DataFrame:
    return observations.orderBy(F.col("observed_at").desc(), "weather_observation_id").limit(1)


def active_at(starts: Column, ends: Column, as_of: datetime) -> Column:
    """No start means in force already, no end means still open."""
    now = F.lit(as_of)
    return (starts.isNull() | (starts <= now)) & (ends.isNull() | (ends >= now))


def dashboard_summary(
    telemetry: DataFrame, stations: DataFrame, points: DataFrame, events: DataFrame, observations: DataFrame,
    runs: DataFrame, as_of: datetime, cfg: Config = DEFAULT,
) -> DataFrame:
    """One row of headline figures. Activity is measured back from the newest sample, not the clock."""
    newest = telemetry.agg((F.max("recorded_at") - F.expr("interval 15 minutes")).alias("t")).scalar()
    recent = moving_only(telemetry).where(F.col("recorded_at") >= F.lit(as_of - timedelta(hours=24)))
    def listed(rows: DataFrame, *parts: str) -> Column:
        """Short report lists only: 24 hours, 3 classes, one entry per source, 5 events."""
        text = rows.select(F.concat_ws("=", *(F.col(p).cast("string") for p in parts)).alias("_t"))
        return text.agg(F.array_join(F.array_sort(F.collect_list("_t")), ", ")).scalar()

    trend = hourly_trend(telemetry, as_of).select(
        F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), F.round("kwh_100km", 3).alias("kwh_100km")
    )
    by_category = stations.groupBy("charging_category").agg(F.count(F.lit(1)).alias("n"))
    weather = latest_weather(observations).select(F.struct("weather_condition", "temperature_c"))
    one = telemetry.sparkSession.range(1)
    return one.select(
        telemetry.where(F.col("recorded_at") >= newest).agg(F.count_distinct("vehicle_id")).scalar().alias("vehicles_active"),
        stations.agg(F.count(F.lit(1))).scalar().alias("charging_stations_total"),
        points.agg(count_where(F.col("power_kw") >= cfg.fast_kw)).scalar().alias("fast_charging_points_total"),
        events.agg(count_where(active_at(F.col("starts_at"), F.col("ends_at"), as_of))).scalar().alias("traffic_events_active"),
        F.round(recent.agg(F.avg("energy_consumption_kwh_100km")).scalar(), 6).alias("avg_consumption_kwh_100km"),
        listed(trend, "bucket", "kwh_100km").alias("energy_trend"),
        listed(by_category, "charging_category", "n").alias("charging_by_category"),
        listed(latest_runs(runs), "source", "status").alias("data_freshness"),
        listed(newest_traffic(events), "external_id").alias("recent_traffic"),
        weather.scalar().getField("weather_condition").alias("weather_condition"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run per source."""
    others = [c for c in runs.columns if c != "source"]
    return runs.groupBy("source").agg(F.max_by(F.struct(*others), "started_at").alias("_r")).select("source", "_r.*")


def source_status(source: Column, status: Column, mode: Column, age_minutes: Column) -> Column:
    limit = lookup(source, SOURCE_MAX_AGE_MINUTES)
    return (
        F.when(source == "simulator", "simulation").when(status == "failed", "failed")
        .when(mode.isNotNull() & (mode != "live"), "degraded").when(status == "partial", "degraded")
        .when(age_minutes > limit, "delayed").otherwise("healthy")
    )


def _term(source: Column, position: int) -> Column:
    return lookup(source, {name: terms[position] for name, terms in SOURCE_TERMS.items() if terms[position]})


def quality_by_source(runs: DataFrame, simulated: DataFrame, as_of: datetime) -> DataFrame:
    """Newest run of every source with its status, age, acceptance and the publisher's terms; the worst status first.

    The simulator reads nothing in, so its row counts the rows of ``simulated``, all accepted, and has no run, age or mode; runs under its name are not looked at.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of)) - F.unix_micros("started_at")) / 6e7)
    graded = latest_runs(runs.where("source <> 'simulator'")).withColumn("_age", age).select(
        "source", "pipeline", source_status(F.col("source"), F.col("status"), F.col("provider_mode"), F.col("_age")).alias("source_status"),
        F.lit("official").alias("data_origin"), F.col("started_at").alias("last_run_at"), F.round("_age", 3).alias("age_minutes"),
        "rows_received", "rows_accepted", "rows_rejected", "rows_duplicate", "provider_mode", "source_url", "error_message")
    simulator = simulated.agg(F.count(F.lit(1)).alias("rows_received")).select(
        F.lit("simulator").alias("source"), F.lit("simulation").alias("pipeline"), F.lit("simulation").alias("source_status"), F.lit("simulated").alias("data_origin"),
        "rows_received", F.col("rows_received").alias("rows_accepted"), F.lit(0).cast("bigint").alias("rows_rejected"), F.lit(0).cast("bigint").alias("rows_duplicate"))
    rate = F.when(F.col("rows_received") > 0, F.col("rows_accepted") * 100.0 / F.col("rows_received"))
    return graded.unionByName(simulator, allowMissingColumns=True).withColumns({
        "acceptance_rate": F.round(F.coalesce(rate, F.lit(0.0)), 2), "licence": _term(F.col("source"), 0), "attribution": _term(F.col("source"), 1),
        "source_url": F.coalesce("source_url", _term(F.col("source"), 2)),
    }).orderBy(lookup(F.col("source_status"), STATUS_ORDER), "source")


def source_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for source, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(source).alias("source"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


def ingestion_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.coalesce(F.sum("rows_accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("rejected"),
    )


def rows_since(telemetry: DataFrame, since: datetime) -> DataFrame:
    return telemetry.where(F.col("ingested_at") >= F.lit(since)).agg(F.count(F.lit(1)).alias("rows"))


def filter_observations(
    observations: DataFrame, *, box: tuple[float, float, float, float] | None = None,
    point: tuple[float, float] | None = None, radius_km: float = 50.0, at: datetime | None = None,
) -> DataFrame:
    """Readings newest first, inside a box or around a point; only a point search carries a distance."""
    from strom.functions.geo import haversine_m

    if box is not None and point is not None:
        raise ValueError("give either a box or a point")
    out = observations.withColumn("distance_km", F.lit(None).cast("double"))
    if box is not None:
        out = out.where(bbox(F.col("latitude"), F.col("longitude"), *box))
    if point is not None:
        metres = haversine_m(F.lit(point[0]), F.lit(point[1]), F.col("latitude"), F.col("longitude"))
        out = out.withColumn("distance_km", metres / 1000.0).where(F.col("distance_km") <= radius_km)
    if at is not None:
        out = out.where(F.col("observed_at") <= F.lit(at))
    return out.orderBy(F.col("observed_at").desc(), "weather_observation_id")
