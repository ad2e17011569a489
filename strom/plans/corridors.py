"""Charging sites along corridors and the gaps between them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.lookups import km, round_decimal
from strom.operators.lines import geojson_line, line_substring
from strom.operators.quantiles import exact_percentiles
from strom.operators.sliced import with_history
from strom.operators.spatial import distance_join, line_edges
from strom.operators.tiles import Hits, along_lines, one_row_each
from strom.plans.stations import count_where
from strom.session import cut_lineage

_GAP_SLICE_M = 25_000.0
SCORE_GAP_WEIGHT = 0.6  # fixed value


def route_lengths(routes: DataFrame) -> DataFrame:
    """Length of each route line in the metric grid."""
    return line_edges(routes, ["route_id"]).groupBy("route_id").agg(F.first("line_m").alias("geometry_length_m"))


def corridor_stations(
    routes: DataFrame, stations: DataFrame, power: DataFrame, cfg: Config = DEFAULT
) -> DataFrame:
    """Sites within the buffer of a demo corridor, with distance to it and offset along it."""
    near = distance_join(
        stations, routes.where("is_demo"), ["station_id"], ["route_id"], cfg.corridor_buffer_m, cfg
    )
    site = stations.select(
        "station_id", "external_id", "operator", "city", "bundesland", "latitude", "longitude", "commissioned_on",
        "data_origin", "source_system",
    )
    profile = power.select(
        "station_id", "effective_max_power_kw", "effective_total_power_kw", "effective_charging_category",
        "is_fast_charger", "is_ultra_fast_charger", "connector_count", "fast_connector_count",
        "ultra_fast_connector_count", "has_ccs", "connector_types",
    )
    return near.join(site, "station_id").join(profile, "station_id", "left").withColumns({
        "distance_to_route_km": km(F.col("distance_m")),
        "route_offset_km": km(F.col("offset_m")),
        "route_geometry_length_km": km(F.col("line_m")),
        "corridor_buffer_m": F.lit(cfg.corridor_buffer_m),
    }).withColumnsRenamed({
        "distance_m": "distance_to_route_m", "offset_m": "route_offset_m", "line_m": "route_geometry_length_m",
    })


def gaps_along(positions: DataFrame, routes: DataFrame, offset: str, length: str, slice_width: float) -> DataFrame:
    """Tiles every route into the stretches without a site.

    ``positions`` holds (route_id, station_id, offset), ``routes`` (route_id, length). Kinds:
    ``origin``, ``between``, ``destination``, and ``whole_route`` where no site qualifies.
    """
    stepped = with_history(positions, ["route_id"], offset, ["station_id"], slice_width, lag=[offset])
    between = stepped.where(F.col(f"prev_{offset}").isNotNull()).select(
        "route_id", F.col(f"prev_{offset}").alias("gap_start"), F.col(offset).alias("gap_end"),
        F.lit("between").alias("gap_kind"),
    )
    ends = positions.groupBy("route_id").agg(F.min(offset).alias("_first"), F.max(offset).alias("_last"))
    return _with_gap(between.unionByName(_outer_gaps(ends, routes, length)))


# chooses among the sites of a corridor, by offset and lateral distance in metres, power and id
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[int]]


def picked_sites(pick: Pick) -> Callable[[Hits], list[tuple]]:
    """Sites that ``pick`` chooses, with their segment, offset along the corridor and lateral distance."""
    def rows(hits: Hits) -> list[tuple]:
        with np.errstate(divide="ignore", invalid="ignore"):
            offset = hits.edge_of("start_offset_m") + hits.offset() / hits.edge_of("line_m") * hits.edge_of("segment_distance_m")
        power, station, segment = hits.of("max_power_kw"), hits.of("station_id"), hits.edge_of("route_segment_id")
        return [(station[i], float(power[i]), segment[i], None if np.isnan(offset[i]) else float(offset[i]), float(hits.distance[i]))
                for i in pick(offset, hits.distance, np.where(np.isnan(power), np.inf, power), station)]

    return rows


def strongest_between(start_m: float, end_m: float) -> Pick:
    """The strongest site in a range of offsets, the first one winning a tie."""
    def pick(offset: np.ndarray, lateral: np.ndarray, power: np.ndarray, station: np.ndarray) -> list[int]:
        inside = np.flatnonzero((offset >= start_m) & (offset <= end_m))
        if not len(inside):
            return []
        top = inside[power[inside] == power[inside].max()]
        return [top[np.argmin(offset[top])]]

    return pick


def best_per_stretch(spacing_km: float) -> Pick:
    """The best site of each stretch as ``thin_candidates`` ranks them: most power, least detour, id."""
    def pick(offset: np.ndarray, lateral: np.ndarray, power: np.ndarray, station: np.ndarray) -> list[int]:
        stretch, chosen = np.floor(offset / 1000.0 / spacing_km), []
        for k in np.unique(stretch):
            inside = np.flatnonzero(np.isnan(stretch) if np.isnan(k) else stretch == k)
            top = inside[power[inside] == power[inside].max()]
            top = top[lateral[top] == lateral[top].min()]
            chosen.append(min(top, key=lambda i: (station[i] is not None, station[i] or "")))
        return chosen

    return pick


def _runs(top: int) -> Callable[[Hits], list[tuple]]:
    """The sites of a corridor in one tile in runs that no site of another tile interrupts, with the ``top`` widest gaps of each.

    Rows: sites, fast sites, qualifying sites of the run, its first and last offset, starts and ends of gaps. All sites are counted in the first row.
    """
    def rows(hits: Hits) -> list[tuple]:
        counts, rated = (len(hits.at), int(hits.of("_fast").sum())), hits.of("_rated")
        if not rated.any():
            return [(*counts, 0, None, None, None, None)]
        offset, edge = hits.offset()[rated], hits.edge[rated]
        order = np.argsort(offset, kind="stable")
        offset, edge = offset[order], edge[order]
        low, high = edge.min(), edge.max()
        cuts = []
        if high > low:
            # the line stays in the tile from one edge to the next if they follow each other and meet inside
            start, length, x, y = (hits.edges[c][low:high + 1] for c in ("edge_start_m", "edge_m", "x1", "y1"))
            size, cx, cy = hits.tile
            linked = (np.abs(start[1:] - start[:-1] - length[:-1]) <= 1e-6) & (np.floor(x[:-1] / size) == cx) & (np.floor(y[:-1] / size) == cy)
            part = np.concatenate(([0], np.cumsum(~linked)))[edge - low]
            cuts = (np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(offset)]):
            run = offset[a:b]
            gap = np.diff(run)
            widest = np.flatnonzero(gap >= np.partition(gap, -top)[-top]) if len(gap) > top else np.arange(len(gap))
            widest = widest[np.lexsort((run[widest], -gap[widest]))][:top]
            out.append((*(counts if a == 0 else (0, 0)), b - a, float(run[0]), float(run[-1]), run[widest], run[widest + 1]))
        return out

    return rows


_RUN = ("sites bigint, fast_sites bigint, rated_sites bigint, first_m double, last_m double, gap_starts array<double>, gap_ends array<double>")


def _outer_gaps(ends: DataFrame, routes: DataFrame, length: str) -> DataFrame:
    """The stretches before the first and after the last site, or the whole route. ``ends``: route_id, _first, _last."""
    spans = routes.select("route_id", F.col(length).alias("_length")).join(ends, "route_id", "left")
    covered = F.col("_first").isNotNull()
    edge = F.struct  # (start, end, kind)
    tiles = F.when(covered, F.array(
        edge(F.lit(0.0).alias("gap_start"), F.col("_first").alias("gap_end"), F.lit("origin").alias("gap_kind")),
        edge(F.col("_last").alias("gap_start"), F.col("_length").alias("gap_end"), F.lit("destination").alias("gap_kind")),
    )).otherwise(F.array(
        edge(F.lit(0.0).alias("gap_start"), F.col("_length").alias("gap_end"), F.lit("whole_route").alias("gap_kind")),
    ))
    return spans.select("route_id", F.inline(tiles))


def _with_gap(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn(
        "gap",
        F.when(F.col("gap_kind") == "destination", F.greatest(F.lit(0.0), F.col("gap_end") - F.col("gap_start")))
        .otherwise(F.col("gap_end") - F.col("gap_start")),
    )


def _gaps_by_tiles(points: DataFrame, routes: DataFrame, lengths: DataFrame, buffer_m: float, top: int, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of sites, figures over all gaps, and at least the ``top`` widest gaps of each route, without a row for any site near a route."""
    edges = cut_lineage(line_edges(routes, ["route_id"]))
    runs = cut_lineage(along_lines(points, edges, "route_id", buffer_m, _runs(top), _RUN, cfg, rank=["edge_no", "edge_start_m"], by_spot=True))
    sites = runs.groupBy("route_id").agg(
        F.sum("sites").alias("stations_in_corridor"), F.sum("fast_sites").alias("fast_stations_in_corridor"), F.sum("rated_sites").alias("qualifying_stations"))
    covered = runs.where("rated_sites > 0")
    in_order = W.partitionBy("route_id").orderBy("first_m", "last_m").rowsBetween(W.unboundedPreceding, -1)
    joints = covered.select("route_id", F.max("last_m").over(in_order).alias("gap_start"), F.col("first_m").alias("gap_end")).where("gap_start is not null")
    within = covered.select("route_id", F.inline(F.arrays_zip(F.col("gap_starts").alias("gap_start"), F.col("gap_ends").alias("gap_end"))))
    ends = covered.groupBy("route_id").agg(F.min("first_m").alias("_first"), F.max("last_m").alias("_last"))
    outer = _outer_gaps(ends, lengths, "geometry_length_m")
    gaps = cut_lineage(_with_gap(joints.unionByName(within).withColumn("gap_kind", F.lit("between")).unionByName(outer)))
    between = covered.groupBy("route_id").agg(F.sum("rated_sites").alias("_rated"), (F.max("last_m") - F.min("first_m")).alias("_span"))
    ended = gaps.groupBy("route_id").agg(F.max("gap").alias("max_gap_m"), F.sum(F.when(F.col("gap_kind") != "between", F.col("gap"))).alias("_ends"))
    totals = ended.join(between, "route_id", "left").select(
        "route_id", (F.coalesce("_rated", F.lit(0)) + 1).alias("gap_count"), "max_gap_m", (F.col("_ends") + F.coalesce("_span", F.lit(0.0))).alias("gap_total_m"))
    return sites, totals.withColumn("mean_gap_m", F.col("gap_total_m") / F.col("gap_count")), gaps


def coverage_score(max_gap_km: Column, per_100km: Column, cfg: Config = DEFAULT) -> Column:
    """0-100: worst gap against its target, density against its target."""
    gap = F.lit(100.0 * cfg.target_max_gap_km) / F.greatest(max_gap_km, F.lit(cfg.target_max_gap_km))
    density = F.least(F.lit(100.0), per_100km * 100.0 / cfg.target_fast_per_100km)
    return F.round(gap * SCORE_GAP_WEIGHT + density * (1 - SCORE_GAP_WEIGHT), 1)


def methodology(buffer_km: float, min_power_kw: float, cfg: Config = DEFAULT) -> str:
    # fixed value: published wording
    return (
        f"Ladestationen im {buffer_km:g}-km-Korridor der Route; Lücken entlang der Streckengeometrie "
        f"(EPSG:{cfg.metric_srid}) zwischen Standorten mit mindestens {min_power_kw:g} kW, einschließlich der Abschnitte "
        f"vor dem ersten und nach dem letzten Schnelllader. Zielwerte: maximale Lücke "
        f"{cfg.target_max_gap_km:g} km, {cfg.target_fast_per_100km:g} Schnellladestandorte je 100 km."
    )


def corridor_coverage(routes: DataFrame, corridor: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Coverage report per demo corridor: site counts, densities, gap figures, worst gap, score."""
    counts = {
        "station_count": F.count(F.lit(1)),
        "fast_station_count": F.count_if("is_fast_charger"),
        "ultra_fast_station_count": F.count_if("is_ultra_fast_charger"),
        "ccs_station_count": F.count_if("has_ccs"),
        "operator_count": F.count_distinct("operator"),
        "charging_point_count": F.sum("connector_count"),
        "fast_charging_point_count": F.sum("fast_connector_count"),
        "ultra_fast_charging_point_count": F.sum("ultra_fast_connector_count"),
    }
    corridor = cut_lineage(corridor)
    rollup = corridor.groupBy("route_id").agg(
        *(c.alias(n) for n, c in counts.items()),
        F.sum(F.coalesce("effective_total_power_kw", "effective_max_power_kw")).alias("_power"),
        F.max("effective_max_power_kw").alias("max_station_power_kw"),
        F.round(F.min("distance_to_route_km"), 3).alias("nearest_station_distance_km"),
        round_decimal(F.avg("distance_to_route_km"), 3).alias("mean_station_distance_km"),
    )
    median = exact_percentiles(corridor, ["route_id"], F.col("effective_max_power_kw"), {"_median": 0.5}, cfg.salt_buckets)
    demo = routes.where("is_demo").select(
        "route_id", F.col("slug").alias("route_slug"), F.col("name").alias("route_name"), "origin_name",
        "destination_name", F.col("distance_km").alias("route_distance_km"),
        F.col("duration_min").alias("route_duration_min"), "geometry",
    )
    lengths = route_lengths(demo).select("route_id", km(F.col("geometry_length_m")).alias("route_geometry_length_km"))
    fast = corridor.where("is_fast_charger").select("route_id", "station_id", "route_offset_km")
    lengths = cut_lineage(lengths)
    gaps = cut_lineage(gaps_along(fast, lengths, "route_offset_km", "route_geometry_length_km", _GAP_SLICE_M / 1000.0))
    gap_rollup = gaps.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("gap_count"), F.round(F.sum("gap"), 3).alias("gap_total_km"),
        F.round(F.max("gap"), 3).alias("max_gap_km"), round_decimal(F.avg("gap"), 3).alias("mean_gap_km"),
        count_where(F.col("gap") > cfg.target_max_gap_km).alias("gaps_above_target_count"),
        F.max_by(
            F.struct("gap_start", "gap_end", "gap", "gap_kind"), F.struct(F.col("gap"), -F.col("gap_start"))
        ).alias("_worst"),
    )
    p90 = exact_percentiles(gaps, ["route_id"], F.col("gap"), {"_p90": 0.9}, cfg.salt_buckets)
    per_100km = {
        "stations_per_100km": "station_count", "fast_stations_per_100km": "fast_station_count",
        "fast_charging_points_per_100km": "fast_charging_point_count",
    }
    report = demo.drop("geometry").join(lengths, "route_id")
    for part in (rollup, median, gap_rollup, p90):
        report = report.join(part, "route_id", "left")
    return report.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counts}).withColumns({
        "corridor_buffer_km": F.lit(cfg.corridor_buffer_m / 1000.0),
        "fast_charger_min_kw": F.lit(cfg.fast_kw),
        "target_max_gap_km": F.lit(cfg.target_max_gap_km),
        "target_fast_stations_per_100km": F.lit(cfg.target_fast_per_100km),
        "installed_power_kw": F.round(F.coalesce("_power", F.lit(0.0)), 1),
        "median_station_power_kw": F.round("_median", 1),
        "p90_gap_km": round_decimal(F.col("_p90"), 3),
        "largest_gap_start_km": F.round("_worst.gap_start", 3),
        "largest_gap_end_km": F.round("_worst.gap_end", 3),
        "largest_gap_km": F.round("_worst.gap", 3),
        "largest_gap_kind": F.col("_worst.gap_kind"),
        **{n: F.round(F.col(c) * 100.0 / F.nullif("route_distance_km", F.lit(0.0)), 2) for n, c in per_100km.items()},
    }).withColumns({
        "coverage_score": coverage_score(F.col("max_gap_km"), F.col("fast_stations_per_100km"), cfg),
        "methodology": F.lit(methodology(cfg.corridor_buffer_m / 1000.0, cfg.fast_kw, cfg)),
    }).drop("_power", "_median", "_worst", "_p90")


def coverage_query(
    routes: DataFrame, stations: DataFrame, *, power_col: str = "max_power_kw", buffer_km: float = 5.0,
    min_power_kw: float = 50.0, top_gaps: int = 25, min_reported_gap_km: float = 0.0,
    count_all_stations: bool = True, include_geometry: bool = False, cfg: Config = DEFAULT,
) -> DataFrame:
    """Parameterised gap analysis: the ranked gaps of every given route with the route figures repeated.

    The worst gap of a route is always reported, further ones down to ``min_reported_gap_km`` and
    up to ``top_gaps`` of them. Without ``count_all_stations`` only sites of the wanted power enter the distance join and the
    totals over all sites are null. ``include_geometry`` adds each gap's stretch of the line as GeoJSON, null for gaps of no length.
    """
    rated = stations.withColumn("_kw", F.coalesce(F.col(power_col), F.lit(0.0)))
    if not count_all_stations:
        rated = rated.where(F.col("_kw") >= min_power_kw)
    lengths = cut_lineage(route_lengths(routes))
    key = ["station_id", "_kw", "is_fast_charger"]
    if (single := one_row_each(rated, key)) is not None:
        strong = F.coalesce(F.col("_kw") >= min_power_kw, F.lit(False))
        points = single.select("latitude", "longitude", strong.alias("_rated"), F.coalesce("is_fast_charger", F.lit(False)).alias("_fast"))
        sites, totals, gaps = _gaps_by_tiles(points, routes, lengths, buffer_km * 1000.0, top_gaps, cfg)
    else:  # a site in several places counts where it is nearest to the route
        near = cut_lineage(distance_join(rated, routes, ["station_id"], ["route_id"], buffer_km * 1000.0, cfg, keep=key[1:]))
        sites = near.groupBy("route_id").agg(
            F.count(F.lit(1)).alias("stations_in_corridor"),
            F.count_if("is_fast_charger").alias("fast_stations_in_corridor"),
            count_where(F.col("_kw") >= min_power_kw).alias("qualifying_stations"),
        )
        qualifying = near.where(F.col("_kw") >= min_power_kw).select("route_id", "station_id", "offset_m")
        gaps = cut_lineage(gaps_along(qualifying, lengths, "offset_m", "geometry_length_m", _GAP_SLICE_M))
        totals = gaps.groupBy("route_id").agg(
            F.count(F.lit(1)).alias("gap_count"), F.max("gap").alias("max_gap_m"), F.avg("gap").alias("mean_gap_m"),
            F.sum("gap").alias("gap_total_m"),
        )
    # the filter on the rank lets Spark keep only ``top_gaps`` rows per route before the shuffle
    worst_first = W.partitionBy("route_id").orderBy(F.col("gap").desc(), F.col("gap_start"))
    ranked = gaps.withColumn("rank_in_route", F.row_number().over(worst_first)).where(F.col("rank_in_route") <= top_gaps)
    reported = ranked.where((F.col("rank_in_route") == 1) | (F.col("gap") >= min_reported_gap_km * 1000.0))
    head = routes.select(
        "route_id", F.col("slug").alias("route_slug"), F.col("name").alias("route_name"),
        F.col("distance_m").alias("_driving_m"),
    )
    per_100km = F.col("qualifying_stations") * 100.0 / F.nullif(F.col("_driving_m") / 1000.0, F.lit(0.0))
    counted = ("stations_in_corridor", "fast_stations_in_corridor")
    if not count_all_stations:
        sites = sites.withColumns({c: F.lit(None).cast("bigint") for c in counted})
    shape: list[Column] = []
    if include_geometry:
        pieces = reported.where("gap_end > gap_start").select(
            "route_id", F.col("rank_in_route").alias("piece"), F.col("gap_start").alias("start_m"), F.col("gap_end").alias("end_m"))
        lines = line_substring(routes, pieces).select("route_id", F.col("piece").alias("rank_in_route"), geojson_line(F.col("vertices")).alias("gap_geometry"))
        reported, shape = reported.join(lines, ["route_id", "rank_in_route"], "left"), [F.col("gap_geometry")]
    return (
        reported.join(totals, "route_id").join(lengths, "route_id").join(head, "route_id")
        .join(sites, "route_id", "left")
        .withColumn("qualifying_stations", F.coalesce("qualifying_stations", F.lit(0)))
        .select(
            "route_id", "route_slug", "route_name", F.lit(buffer_km).alias("buffer_km"),
            F.lit(min_power_kw).alias("min_power_kw"), km(F.col("_driving_m")).alias("route_distance_km"),
            km(F.col("geometry_length_m")).alias("route_geometry_length_km"), *counted, "qualifying_stations",
            F.round(per_100km, 2).alias("qualifying_stations_per_100km"), "gap_count",
            km(F.col("max_gap_m")).alias("max_gap_km"), km(F.col("mean_gap_m")).alias("mean_gap_km"),
            km(F.col("gap_total_m")).alias("gap_total_km"), "rank_in_route", "gap_kind",
            km(F.col("gap_start")).alias("start_offset_km"), km(F.col("gap_end")).alias("end_offset_km"),
            km(F.col("gap")).alias("gap_km"),
            coverage_score(F.col("max_gap_m") / 1000.0, per_100km, cfg).alias("coverage_score"),
            F.lit(methodology(buffer_km, min_power_kw, cfg)).alias("methodology"), *shape,
        )
    )


def underserved(coverage: DataFrame, max_gap_km: float = 50.0) -> DataFrame:
    """Every evaluated corridor with its worst gap, whether it breaches the threshold, and the breaching stretches."""
    breach = F.col("gap_km") > max_gap_km
    stretches = F.collect_list(F.when(breach, F.struct("rank_in_route", "start_offset_km", "end_offset_km", "gap_kind")))
    text = F.array_join(F.transform(
        F.array_sort("_stretches"),
        lambda s: F.format_string("%.3f-%.3f %s", s.start_offset_km, s.end_offset_km, s.gap_kind),
    ), "; ")
    return (
        coverage.groupBy("route_id").agg(
            F.first("route_slug").alias("_slug"), F.first("route_name").alias("name"),
            F.first("max_gap_km").alias("worst_gap_km"), F.first("coverage_score").alias("coverage_score"),
            stretches.alias("_stretches"),
        )
        .select(
            F.coalesce("_slug", "route_id").alias("route_slug"), "name", "worst_gap_km", "coverage_score",
            (F.col("worst_gap_km") > max_gap_km).alias("is_underserved"),
            F.size("_stretches").alias("segment_count"), text.alias("segments"),
        )
    )


def gap_invariant(coverage: DataFrame, tolerance_km: float = 0.01) -> DataFrame:
    """Corridors whose gaps do not add up to the length of the route."""
    drift = F.abs(F.col("gap_total_km") - F.col("route_geometry_length_km"))
    return coverage.select(
        "route_id", "gap_count", "gap_total_km", "route_geometry_length_km", F.round(drift, 3).alias("drift_km"),
        (drift > tolerance_km).alias("is_broken"),
    ).distinct()
