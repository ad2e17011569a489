"""Routes: measured lines, equal-length segments, step attributes, the route and route-energy marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import energy, geo, lookups
from strom.functions.lookups import km, round_decimal, share_percent
from strom.operators.lines import line_substring, on_edge
from strom.operators.nearest import interval_join
from strom.operators.spatial import line_edges
from strom.plans.corridors import route_lengths
from strom.plans.stations import count_where

TARGET_SEGMENT_M, MIN_SEGMENT_M = 5_000.0, 1_500.0  # fixed values
# fixed values: first letter of a road reference
REF_CLASS = {"A": "motorway", "B": "primary", "L": "secondary", "S": "secondary", "K": "tertiary"}
OSM_CLASS = {
    "motorway": "motorway", "trunk": "trunk", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary",
    "residential": "residential", "living_street": "residential", "unclassified": "residential", "service": "service",
    "track": "service",
}


def geodesic_edges(routes: DataFrame) -> DataFrame:
    """Edges of each route line with great-circle length, running offset and total length."""
    vertices = routes.select("route_id", F.posexplode("geometry").alias("_at", "_v")).select(
        "route_id", (F.col("_at") + 1).alias("edge_no"), F.col("_v.latitude").alias("lat0"), F.col("_v.longitude").alias("lon0"),
    )
    along = W.partitionBy("route_id").orderBy("edge_no")  # a line is one row of its table, so this is bounded
    edges = vertices.withColumns({"lat1": F.lead("lat0").over(along), "lon1": F.lead("lon0").over(along)})
    edges = edges.withColumn("edge_m", geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    return edges.withColumns({
        "line_m": F.sum("edge_m").over(W.partitionBy("route_id")),
        "edge_start_m": F.sum("edge_m").over(so_far) - F.col("edge_m"),
    }).where(F.col("lat1").isNotNull())


def point_at_offset(routes: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets`` (route_id, offset_m) located on their line, clamped to its ends."""
    edges = geodesic_edges(routes)
    at = F.greatest(F.lit(0.0), F.least(F.col("offset_m"), F.col("line_m")))
    last = F.col("edge_start_m") + F.col("edge_m") >= F.col("line_m") - 1e-6
    hit = (at >= F.col("edge_start_m")) & ((at < F.col("edge_start_m") + F.col("edge_m")) | last)
    lat, lon = on_edge(at)
    return offsets.join(edges, "route_id").where(hit).select(*offsets.columns, lat.alias("latitude"), lon.alias("longitude"))


def densify(routes: DataFrame, max_m: float) -> DataFrame:
    """Vertices so that no leg is longer than ``max_m``: (route_id, edge_no, step, latitude, longitude)."""
    edges = geodesic_edges(routes).withColumn("_steps", F.greatest(F.lit(1), F.ceil(F.col("edge_m") / max_m)).cast("int"))
    # each edge yields its start and its inner points; the last edge of a line also yields its end
    is_last = F.col("edge_start_m") + F.col("edge_m") >= F.col("line_m") - 1e-6
    upto = F.when(is_last, F.col("_steps")).otherwise(F.col("_steps") - 1)
    points = edges.withColumn("step", F.explode(F.sequence(F.lit(0), upto)))
    t = F.col("step") / F.col("_steps")
    return points.select(
        "route_id", "edge_no", "step",
        (F.col("lat0") + (F.col("lat1") - F.col("lat0")) * t).alias("latitude"),
        (F.col("lon0") + (F.col("lon1") - F.col("lon0")) * t).alias("longitude"),
    )


def sample_vertices(routes: DataFrame, n: int) -> DataFrame:
    """Every k-th vertex and the last, one per coordinate rounded to three decimals, at most about ``n`` per line."""
    stride = F.greatest(F.lit(1), F.floor(F.size("geometry") / n)).cast("int")
    last = F.size("geometry") - 1
    vertices = routes.select("route_id", stride.alias("_k"), last.alias("_last"), F.posexplode("geometry").alias("position", "v"))
    kept = vertices.where((F.col("position") % F.col("_k") == 0) | (F.col("position") == F.col("_last")))
    keys = [F.round("v.latitude", 3).alias("latitude"), F.round("v.longitude", 3).alias("longitude")]
    return kept.select("route_id", "position", *keys).groupBy("route_id", "latitude", "longitude").agg(
        F.min("position").alias("position")
    )


def extent(lines: DataFrame, pad_deg: float = 0.0) -> DataFrame:
    """Padded bounding box per route over its vertices."""
    v = lines.select("route_id", F.explode("geometry").alias("v"))
    return v.groupBy("route_id").agg(
        (F.min("v.longitude") - pad_deg).alias("west"), (F.min("v.latitude") - pad_deg).alias("south"),
        (F.max("v.longitude") + pad_deg).alias("east"), (F.max("v.latitude") + pad_deg).alias("north"),
    )


def segment_polyline(routes: DataFrame, target_m: float = TARGET_SEGMENT_M, min_m: float = MIN_SEGMENT_M) -> DataFrame:
    """Equal-length pieces of every line with their vertices and midpoint.

    Cut points, inner vertices and midpoints are all produced per edge and regrouped by
    (route, piece), so no line is ever compared with its own pieces.
    """
    count = F.greatest(F.lit(1), F.least(F.bround(F.col("line_m") / target_m), F.floor(F.col("line_m") / min_m))).cast("int")
    edges = geodesic_edges(routes).where(F.col("line_m") > 0).withColumn("n", count).withColumn("piece_m", F.col("line_m") / F.col("n"))
    end_m = F.col("edge_start_m") + F.col("edge_m")
    first, final = F.col("edge_no") == 1, end_m >= F.col("line_m") - 1e-6

    def numbers(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    cuts = numbers(F.floor(F.col("edge_start_m") / F.col("piece_m")) + 1, F.least(F.floor(end_m / F.col("piece_m")), F.col("n") - 1))
    at = F.col("k") * F.col("piece_m")
    lat, lon = on_edge(at)
    cut = edges.withColumn("k", F.explode(cuts)).select("route_id", "n", "piece_m", "k", lat.alias("lat"), lon.alias("lon"), at.alias("at"))
    ends = edges.where(first).select("route_id", "n", "piece_m", F.lit(0).cast("bigint").alias("k"), F.col("lat0").alias("lat"),
                                     F.col("lon0").alias("lon"), F.lit(0.0).alias("at")).unionByName(
        edges.where(final).select("route_id", "n", "piece_m", F.col("n").cast("bigint").alias("k"), F.col("lat1").alias("lat"),
                                  F.col("lon1").alias("lon"), F.col("line_m").alias("at")))
    boundary = cut.unionByName(ends)
    sides = F.array_compact(F.array(F.when(F.col("k") < F.col("n"), F.col("k")), F.when(F.col("k") > 0, F.col("k") - 1)))
    corners = boundary.select("route_id", "n", "piece_m", F.explode(sides).alias("ordinal"), "at", "lat", "lon")
    slot = F.floor(F.col("edge_start_m") / F.col("piece_m"))
    inner = edges.where(~first & (F.abs(F.col("edge_start_m") - F.bround(F.col("edge_start_m") / F.col("piece_m")) * F.col("piece_m")) > 1e-6)).select(
        "route_id", "n", "piece_m", slot.alias("ordinal"), F.col("edge_start_m").alias("at"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))
    pieces = corners.unionByName(inner).groupBy("route_id", "ordinal").agg(
        F.first("piece_m").alias("distance_m"),
        F.array_sort(F.collect_list(F.struct("at", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))).alias("geometry"),
    )
    half = F.col("piece_m") / 2
    middles = numbers(F.ceil((F.col("edge_start_m") - half) / F.col("piece_m")), F.least(F.ceil((end_m - half) / F.col("piece_m")) - 1, F.col("n") - 1))
    middle_lat, middle_lon = on_edge((F.col("ordinal") + 0.5) * F.col("piece_m"))
    midpoints = edges.withColumn("ordinal", F.explode(middles)).select(
        "route_id", "ordinal", middle_lat.alias("midpoint_latitude"), middle_lon.alias("midpoint_longitude"))
    return pieces.join(midpoints, ["route_id", "ordinal"], "left").withColumn("start_offset_m", F.col("ordinal") * F.col("distance_m"))


# ---- attributes from the routing steps


def road_class_from_ref(ref: Column) -> Column:
    """Highest class among the listed road numbers; unknown without one."""
    letters = F.transform(F.split(ref, "[;,]"), lambda part: F.upper(F.substring(F.trim(part), 1, 1)))
    classes = F.transform(letters, lambda c: lookups.lookup(c, REF_CLASS, "unknown"))
    ranked = F.transform(classes, lambda c: F.struct(lookups.road_class_ordinal(c).alias("rank"), c.alias("road_class")))
    return F.coalesce(F.array_max(ranked).getField("road_class"), F.lit("unknown"))


def road_class_from_osm(tag: Column) -> Column:
    return lookups.lookup(F.regexp_replace(F.lower(F.trim(tag)), "_link$", ""), OSM_CLASS, "unknown")


def segment_attributes(steps: DataFrame, segments: DataFrame, fallback_speed: Column | None = None) -> DataFrame:
    """Dominant road class, its limit, and overlap-weighted speed of every segment.

    Ties go to the class whose first overlapping step comes first. ``steps`` holds (route_id, step_no,
    step_start_m, step_end_m, road_class, speed_limit_kmh, distance_m, duration_s).
    """
    overlaps = interval_join(
        steps, segments.select("route_id", "ordinal", F.col("start_offset_m").alias("_s"),
                               (F.col("start_offset_m") + F.col("distance_m")).alias("_e")),
        "route_id", ("step_start_m", "step_end_m"), ("_s", "_e"), 4 * TARGET_SEGMENT_M,
    )
    moving = F.col("duration_s") > 0
    speed = F.when(moving, F.col("overlap") * F.col("distance_m") / F.col("duration_s") * 3.6)
    per_class = overlaps.groupBy("route_id", "ordinal", "road_class").agg(
        F.sum("overlap").alias("_m"), F.min("step_no").alias("_first"),
        F.min_by("speed_limit_kmh", "step_no").alias("_limit"), F.sum(speed).alias("_v"),
        F.sum(F.when(moving, F.col("overlap"))).alias("_covered"),
    )
    best = F.max(F.struct(F.round("_m", 6).alias("m"), (-F.col("_first")).alias("first"), "road_class", F.col("_limit").alias("limit")))
    merged = per_class.groupBy("route_id", "ordinal").agg(best.alias("_best"), F.sum("_v").alias("_v"), F.sum("_covered").alias("_covered"))
    fallback = fallback_speed if fallback_speed is not None else F.lit(None).cast("double")
    return segments.join(merged, ["route_id", "ordinal"], "left").withColumns({
        "road_class": F.coalesce("_best.road_class", F.lit("unknown")),
        "speed_limit_kmh": F.col("_best.limit"),
        "assumed_speed_kmh": F.coalesce(F.col("_v") / F.nullif("_covered", F.lit(0.0)), fallback),
    }).drop("_best", "_v", "_covered")


# ---- marts


def dim_route(routes: DataFrame, segments: DataFrame) -> DataFrame:
    """Route dimension: metric length, class shares, mean speeds, segmentation coverage."""
    length = F.col("segment_distance_m")

    def metres(*classes: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("road_class").isin(*classes), length)), F.lit(0.0))

    rollup = segments.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum(length).alias("_m"),
        F.min("segment_ordinal").alias("first_segment_ordinal"), F.max("segment_ordinal").alias("last_segment_ordinal"),
        metres("motorway").alias("_motorway"), metres("trunk", "primary").alias("_main"),
        metres("secondary", "tertiary", "residential", "service").alias("_minor"),
        F.avg("speed_limit_kmh").alias("_limit"), F.avg("assumed_speed_kmh").alias("_speed"),
        F.sum("elevation_gain_m").alias("elevation_gain_m"), F.count("predicted_kwh").alias("analysed_segment_count"),
        F.count("traffic_severity").alias("segments_with_traffic_count"),
    )
    counts = ("segment_count", "analysed_segment_count", "segments_with_traffic_count")
    lengths = route_lengths(routes).select("route_id", km(F.col("geometry_length_m")).alias("geometry_length_km"))
    hours = F.when(F.col("duration_s") > 0, F.col("duration_s") / 3600.0)
    return (
        routes.drop("geometry").withColumnsRenamed({"slug": "route_slug", "name": "route_name"})
        .join(lengths, "route_id", "left").join(rollup, "route_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
        .withColumns({
            "free_flow_avg_speed_kmh": F.round(F.col("distance_m") / 1000.0 / hours, 1),
            "segments_distance_km": km(F.col("_m")),
            "motorway_distance_share_percent": share_percent(F.col("_motorway"), F.col("_m")),
            "trunk_primary_distance_share_percent": share_percent(F.col("_main"), F.col("_m")),
            "minor_road_distance_share_percent": share_percent(F.col("_minor"), F.col("_m")),
            "mean_speed_limit_kmh": round_decimal(F.col("_limit"), 1),
            "mean_assumed_speed_kmh": round_decimal(F.col("_speed"), 1),
            "segmentation_coverage_percent": share_percent(F.col("_m"), F.col("distance_m")),
        })
        .drop("_m", "_motorway", "_main", "_minor", "_limit", "_speed")
    )


def mart_route_energy(segments: DataFrame, routes: DataFrame, models: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Climate and traffic shares of each segment's predicted energy, with the route totals alongside."""
    yardstick = models.where(F.col("vehicle_model_code") == cfg.reference_vehicle)
    nominal = yardstick.select("nominal_consumption_kwh_100km").scalar()
    usable = yardstick.select("usable_capacity_kwh").scalar()
    head = routes.select("route_id", F.col("slug").alias("route_slug"), F.col("name").alias("route_name"),
                         "origin_name", "destination_name", F.col("is_demo").alias("route_is_demo"))
    predicted, per_100 = F.col("predicted_kwh"), F.col("predicted_kwh_per_100km")
    hours = F.when(F.col("assumed_speed_kmh") > 0, F.col("segment_distance_km") / F.col("assumed_speed_kmh"))
    base = segments.drop("geometry").join(head, "route_id").withColumns({
        "reference_vehicle_code": F.lit(cfg.reference_vehicle), "reference_nominal_kwh_100km": nominal,
        "reference_usable_capacity_kwh": usable, "_hours": hours,
        "hvac_load_kw": energy.hvac_kw_sql(F.col("temperature_c")),
        "traffic_delay_factor": lookups.severity_delay_factor(F.col("traffic_severity")),
    })
    reference = F.col("reference_nominal_kwh_100km")
    auxiliary = (F.col("hvac_load_kw") + energy.AUXILIARY_KW) * F.col("_hours")
    enriched = base.withColumns({
        "end_offset_km": F.round(F.col("start_offset_km") + F.col("segment_distance_km"), 3),
        "road_class_ordinal": lookups.road_class_ordinal(F.col("road_class")),
        "is_motorway": F.col("road_class") == "motorway",
        "gradient_percent": share_percent(F.col("elevation_gain_m"), F.col("segment_distance_m"), 3),
        "traffic_severity_ordinal": lookups.severity_ordinal(F.col("traffic_severity")),
        "energy_intensity_vs_reference": lookups.energy_intensity(per_100, reference),
        "consumption_ratio_to_reference": round_decimal(F.when(reference > 0, per_100 / reference), 4),
        "hvac_energy_kwh": round_decimal(F.col("hvac_load_kw") * F.col("_hours"), 4),
        "auxiliary_energy_kwh": round_decimal(auxiliary, 4),
        "traffic_extra_auxiliary_kwh": round_decimal(auxiliary * (F.col("traffic_delay_factor") - 1.0), 4),
        "free_flow_minutes": round_decimal(F.col("_hours") * 60.0, 2),
        "delayed_minutes": round_decimal(F.col("_hours") * F.col("traffic_delay_factor") * 60.0, 2),
    })
    hvac, extra = F.col("hvac_energy_kwh"), F.col("traffic_extra_auxiliary_kwh")
    attributed = enriched.withColumns({
        "weather_penalty_percent": round_decimal(F.when(predicted - hvac > 0, hvac * 100.0 / (predicted - hvac)), 2),
        "traffic_penalty_percent": round_decimal(F.when(predicted > 0, extra * 100.0 / predicted), 2),
        "traffic_delay_minutes": F.round(F.col("delayed_minutes") - F.col("free_flow_minutes"), 2),
    })
    intensity = F.col("energy_intensity_vs_reference")
    totals = attributed.groupBy("route_id").agg(
        F.sum("predicted_kwh").alias("_kwh"), F.sum("segment_distance_km").alias("_km"),
        F.count(F.lit(1)).alias("route_segment_count"), F.count("predicted_kwh").alias("route_analysed_segment_count"),
        *(count_where(intensity == level).alias(f"route_{level}_intensity_segment_count") for level in ("low", "medium", "high", "critical")),
        F.sum("hvac_energy_kwh").alias("_hvac"), F.sum("traffic_extra_auxiliary_kwh").alias("_extra"),
        F.sum("traffic_delay_minutes").alias("_delay"), F.max("predicted_kwh_per_100km").alias("route_max_segment_kwh_per_100km"),
        F.sum(per_100 * F.col("segment_distance_km")).alias("_weighted"),
    ).withColumns({
        "route_predicted_kwh": round_decimal(F.col("_kwh"), 3),
        "route_segments_distance_km": round_decimal(F.col("_km"), 3),
        "route_kwh_per_100km": round_decimal(F.when(F.col("_km") > 0, F.col("_weighted") / F.col("_km")), 3),
        "route_critical_intensity_share_percent": share_percent(F.col("route_critical_intensity_segment_count"), F.col("route_segment_count")),
        "route_hvac_energy_kwh": round_decimal(F.col("_hvac"), 3),
        "route_traffic_extra_auxiliary_kwh": round_decimal(F.col("_extra"), 3),
        "route_traffic_delay_minutes": round_decimal(F.col("_delay"), 2),
        "route_weather_penalty_percent": round_decimal(
            F.when((F.col("_kwh") > 0) & (F.col("_kwh") - F.col("_hvac") > 0), F.col("_hvac") * 100.0 / (F.col("_kwh") - F.col("_hvac"))), 2),
        "route_traffic_penalty_percent": round_decimal(F.when(F.col("_kwh") > 0, F.col("_extra") * 100.0 / F.col("_kwh")), 2),
        "_battery_kwh": F.col("_kwh"),
    }).drop("_kwh", "_km", "_hvac", "_extra", "_delay", "_weighted")
    return attributed.join(totals, "route_id").withColumn(
        "route_reference_battery_required_percent", share_percent(F.col("_battery_kwh"), F.col("reference_usable_capacity_kwh"))
    ).drop("_hours", "_battery_kwh", "start_offset_m", "segment_distance_m")
