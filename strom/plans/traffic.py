"""Traffic events: lifecycle facts, impact per road, events along corridors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions import lookups
from strom.functions.lookups import round_decimal, seconds_between, share_percent
from strom.operators.sizes import is_small, skew_join
from strom.operators.spatial import covers, deal_out, distance_join, edge_cover, line_edges, segments_distance
from strom.operators.tiles import Hits, along_lines, hypot, nearest_spot, one_row_each
from strom.plans.fleet import active_at
from strom.plans.stations import distinct_text
from strom.session import cut_lineage

BIN_M = 500.0  # fixed value


def fct_traffic_events(events: DataFrame, as_of: datetime) -> DataFrame:
    """Events with severity figures and their lifecycle at ``as_of``."""
    start, end, now = F.col("starts_at"), F.col("ends_at"), F.lit(as_of)
    return events.withColumns({
        "severity_ordinal": lookups.severity_ordinal(F.col("severity")),
        "severity_delay_factor": lookups.severity_delay_factor(F.col("severity")),
        "has_extent_geometry": F.col("geometry").isNotNull(),
        "evaluated_at": now,
        "planned_duration_hours": F.round(seconds_between(start, end) / 3600.0, 2),
        "is_active_now": active_at(start, end, as_of),
        "is_upcoming": F.coalesce(start > now, F.lit(False)),
        "is_expired": F.coalesce(end < now, F.lit(False)),
        "is_open_started": start.isNull(),
        "is_open_ended": end.isNull(),
        "has_reported_delay": F.col("delay_minutes").isNotNull(),
    })


def traffic_filter(
    events: DataFrame, *, box: tuple[float, float, float, float] | None = None, event_type: str | None = None,
    severity: str | None = None, road: str | None = None, active_at_time: datetime | None = None,
) -> DataFrame:
    """All given conditions must hold; newest start first."""
    from strom.plans.station_queries import bbox

    conditions = [
        bbox(F.col("latitude"), F.col("longitude"), *box) if box else None,
        F.col("event_type") == event_type if event_type else None,
        F.col("severity") == severity if severity else None,
        F.upper("road_name") == road.strip().upper() if road else None,
        active_at(F.col("starts_at"), F.col("ends_at"), active_at_time) if active_at_time else None,
    ]
    for condition in conditions:
        if condition is not None:
            events = events.where(condition)
    return events.orderBy(F.col("starts_at").desc_nulls_last(), "traffic_event_id")


def geojson_features(events: DataFrame, cap: int = 20_000) -> DataFrame:
    """The ``cap`` most severe events as features, a line where one is known and else a point, with total, truncation flag and extent of all vertices returned."""
    kept = events.orderBy(lookups.severity_ordinal(F.col("severity")).desc_nulls_last(), "traffic_event_id").limit(cap)
    is_line = F.col("geometry").isNotNull()
    vertices = F.transform(F.array_sort("geometry"), lambda v: F.array(F.round(v["longitude"], 6), F.round(v["latitude"], 6)))
    kinds = {"LineString": vertices, "Point": F.array(F.round("longitude", 6), F.round("latitude", 6))}
    lines, points = (F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("traffic_event_id").alias("id"), F.struct(F.lit(kind).alias("type"), place.alias("coordinates")).alias("geometry"),
        F.struct("external_id", "event_type", "severity", "is_blocked", "road_name", "direction", "title", "delay_minutes", F.lit(kind).alias("geometry_kind")).alias("properties"),
    ), {"ignoreNullFields": "false"}) for kind, place in kinds.items())
    rows = kept.select("traffic_event_id", F.when(is_line, lines).otherwise(points).alias("feature"), *(
        F.coalesce(edge(F.transform("geometry", lambda v: v[side])), F.col(side)).alias(f"_{name}")
        for name, side, edge in (("west", "longitude", F.array_min), ("south", "latitude", F.array_min), ("east", "longitude", F.array_max), ("north", "latitude", F.array_max))))
    extent = rows.agg(F.struct(F.min("_west").alias("west"), F.min("_south").alias("south"), F.max("_east").alias("east"), F.max("_north").alias("north")).alias("_extent")).scalar()
    total = events.agg(F.count(F.lit(1))).scalar()
    return rows.select("traffic_event_id", "feature", total.alias("total_matching"), *(extent.getField(c).alias(c) for c in ("west", "south", "east", "north"))).withColumn(
        "truncated", F.col("total_matching") > cap)


def events_on_segments(
    events: DataFrame, segments: DataFrame, buffer_m: float, cfg: Config = DEFAULT, keep: Sequence[str] = ()
) -> DataFrame:
    """Pairs of event point and segment within the buffer, with the event columns ``keep``."""
    return distance_join(events, segments, ["traffic_event_id"], ["route_segment_id"], buffer_m, cfg, keep=keep)


def _live_lines(events: DataFrame, as_of: datetime) -> DataFrame:
    point = F.struct(F.lit(0).alias("ordinal"), "latitude", "longitude")
    return events.where(active_at(F.col("starts_at"), F.col("ends_at"), as_of)).select(
        "traffic_event_id", F.coalesce("geometry", F.array(point, point)).alias("geometry"))


def _tally_near(buffer_m: float, reach_m: float) -> Callable[[Hits], list[tuple]]:
    """Worst severity and rows of the events whose lines come within ``buffer_m`` of a segment, from pieces of these with their middle within ``reach_m``."""
    def far(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.maximum(0.0, np.minimum(1.0, np.where(square > 0, ((px - ax) * dx + (py - ay) * dy) / square, 0.0)))
        ex, ey = px - (ax + t * dx), py - (ay + t * dy)
        return np.sqrt(ex * ex + ey * ey)

    def side(ax, ay, bx, by, px, py):
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def rows(hits: Hits) -> list[tuple]:
        edge = hits.one_edge()
        # an event counts by the first of its pieces near the segment: those near it follow each other, as both are straight
        _, ex, ey = nearest_spot(hits.of("before_x"), hits.of("before_y"), edge)
        at = hits.at[~(hypot(ex, ey) <= reach_m)]
        if not len(at):
            return []
        a = [hits.columns[c][at] for c in ("ax0", "ay0", "ax1", "ay1")]
        b = edge[:4]
        least = np.minimum(np.minimum(far(*a[:2], *b), far(*a[2:], *b)), np.minimum(far(*b[:2], *a), far(*b[2:], *a)))
        crossing = (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)
        at = at[(least <= buffer_m) | crossing]
        if not len(at):
            return []
        worst = np.fmax.reduce(hits.columns["severity_ordinal"][at].astype(float))
        return [(None if np.isnan(worst) else int(worst), int(hits.columns["event_rows"][at].sum()))]

    return rows


def event_tally_on_segments(events: DataFrame, segments: DataFrame, as_of: datetime, buffer_m: float, tally: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Of ``event_lines_on_segments`` with the figures of ``tally`` what a sum and a maximum per segment need: rows of segment, worst severity and event rows.

    Event lines are cut into pieces, found by their middles tile by tile. Lines of more than one edge, and ids that come twice, go by pairs.
    """
    ends = ("x0", "y0", "x1", "y1")
    lines = cut_lineage(line_edges(_live_lines(events, as_of).where("traffic_event_id is not null"), ["traffic_event_id"]).select("traffic_event_id", *ends, "edge_m"))
    edges = cut_lineage(line_edges(segments.where("route_segment_id is not null"), ["route_segment_id"]))
    if not all(e.groupBy(key).count().where("count > 1").isEmpty() for e, key in ((lines, "traffic_event_id"), (edges, "route_segment_id"))):
        return event_lines_on_segments(events, segments, as_of, buffer_m, cfg, keep=tally)
    piece_m = 2 * buffer_m
    pieces = lines.join(tally.hint("merge"), "traffic_event_id").withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("edge_m") / piece_m)))
    pieces = pieces.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces").cast("bigint") - 1)))

    def middle(low: str, high: str, piece):
        return F.col(low) + (F.col(high) - F.col(low)) * ((piece + 0.5) / F.col("_pieces"))

    points = pieces.select(
        middle("x0", "x1", F.col("_piece")).alias("px"), middle("y0", "y1", F.col("_piece")).alias("py"),
        *(F.when(F.col("_piece") > 0, middle(f"{v}0", f"{v}1", F.col("_piece") - 1)).alias(f"before_{v}") for v in ("x", "y")),
        *(F.col(c).alias(f"a{c}") for c in ends), F.col("severity_ordinal").cast("double").alias("severity_ordinal"), "event_rows")
    reach_m = buffer_m + piece_m / 2 + 1e-3
    return along_lines(points, edges, "route_segment_id", reach_m, _tally_near(buffer_m, reach_m), "severity_ordinal int, event_rows bigint", cfg, rank=["edge_no"])


def event_lines_on_segments(
    events: DataFrame, segments: DataFrame, as_of: datetime, buffer_m: float, cfg: Config = DEFAULT, keep: DataFrame | None = None
) -> DataFrame:
    """Pairs of active event and segment whose lines come within the buffer; events without a line count as a point.

    ``keep`` holds a row per event with columns to carry; events without one are left out.
    """
    live = _live_lines(events, as_of)
    size = 2 * buffer_m + 4_000.0

    def prefixed(lines: DataFrame, prefix: str, key: str, reach: float, more: Sequence[str] = ()) -> DataFrame:
        edges = line_edges(lines, [key]).withColumn(f"{prefix}_several", F.count(F.lit(1)).over(W.partitionBy(key)) > 1)
        cover = edge_cover(deal_out(edges, key), reach, size)
        return cover.select(key, "cx", "cy", f"{prefix}_several", *more, *(F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    # an event meets a segment in the first of its cells that the segment covers, and in no other one
    earlier = W.partitionBy("traffic_event_id", "ax0", "ay0", "ax1", "ay1").orderBy("cx", "cy").rowsBetween(W.unboundedPreceding, -1)
    event_cells = cut_lineage(prefixed(live, "a", "traffic_event_id", 0.0).withColumn("_earlier", F.collect_list(F.struct("cx", "cy")).over(earlier)))
    segment_cells = cut_lineage(prefixed(segments, "b", "route_segment_id", buffer_m))
    if keep is not None:
        event_cells = event_cells.join(keep, "traffic_event_id")
    carried = [c for c in keep.columns if c != "traffic_event_id"] if keep is not None else []
    if is_small(segment_cells, cfg.broadcast_rows):
        pairs = event_cells.join(F.broadcast(segment_cells), ["cx", "cy"])
    else:
        pairs = skew_join(event_cells, segment_cells, ["cx", "cy"], F.col("traffic_event_id"), cfg.salt_buckets, hot_rows=cfg.hot_rows)
    met = pairs.where(segments_distance(pairs) <= buffer_m).where(~F.exists("_earlier", lambda c: covers(
        *(F.col(f"b{v}") for v in ("x0", "y0", "x1", "y1")), c["cx"], c["cy"], buffer_m, size)))
    columns = ["traffic_event_id", "route_segment_id", *carried]
    several = F.col("a_several") | F.col("b_several")
    single = met.where(~several).select(*columns)
    if event_cells.where("a_several").isEmpty() and segment_cells.where("b_several").isEmpty():
        return single
    return single.unionByName(met.where(several).select(*columns).dropDuplicates(["traffic_event_id", "route_segment_id"]))


class _TouchedGroups:
    """Per segment the groups of the events near it as bits, 64 in a word; per task which events are near any segment, and once per tile their groups."""

    schema = "words array<bigint>, bits array<bigint>, cx bigint, cy bigint, met binary, groups binary"

    def __call__(self, hits: Hits) -> list[tuple]:
        columns = hits.columns
        if "met" not in columns:
            columns["names"], columns["code"] = np.unique(columns["_group"], return_inverse=True)
            columns["word"], columns["bit"] = columns["names"] >> 6, np.left_shift(np.int64(1), columns["names"] & 63)
            columns["met"] = np.zeros(len(columns["_group"]), bool)
        columns["met"][hits.at] = True
        seen = np.zeros(len(columns["names"]), bool)
        seen[columns["code"][hits.at]] = True
        seen = np.flatnonzero(seen)
        words = columns["word"][seen]
        start = np.concatenate(([0], np.flatnonzero(words[1:] != words[:-1]) + 1))
        return [(words[start], np.bitwise_or.reduceat(columns["bit"][seen], start), None, None, None, None)]

    def finish(self, columns: dict, task: tuple) -> list[tuple]:
        cx, cy, part = task
        order = np.argsort(columns["_no"])  # the same in all tasks of a tile
        met = columns["met"][order] if "met" in columns else np.zeros(len(order), bool)
        # an event without an id is none that could be counted
        groups = np.where(columns["_named"], columns["_group"], -1)[order].astype(np.int64)
        return [(None, None, cx, cy, np.packbits(met).tobytes(), groups.tobytes() if part == 0 else None)]


def _matched_events(met):  # Spark takes hints that are text for none it knows
    """Per group how many events of one tile any of its tasks has met."""
    groups = np.frombuffer(next(g for g in met.column("groups").to_pylist() if g is not None), np.int64)
    bits = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in met.column("met").to_pylist()])
    names, counts = np.unique(groups[np.unpackbits(bits, count=len(groups)).astype(bool)], return_counts=True)
    return pa.table({"_group": names[names >= 0], "events": counts[names >= 0].astype(np.int64)})


def _touched(facts: DataFrame, segments: DataFrame, buffer_m: float, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Groups near each segment as bits, and the number of events near any segment in each group. ``facts``: events with their ``_group``, which is never negative."""
    single = one_row_each(facts, ["traffic_event_id", "_group"])
    if single is None:  # an event in several places counts once
        near = events_on_segments(facts, segments, buffer_m, cfg, keep=["_group"]).where("route_segment_id is not null")
        word, bit = F.expr("_group div 64"), F.expr("shiftleft(1L, cast(pmod(_group, 64) as int))")
        return (near.groupBy("route_segment_id", word.alias("_word")).agg(F.bit_or(bit).alias("_bits")),
                near.groupBy("_group").agg(F.count_distinct("traffic_event_id").alias("corridor_matched_event_count")))
    points = single.select("latitude", "longitude", "_group", F.col("traffic_event_id").isNotNull().alias("_named"), F.monotonically_increasing_id().alias("_no"))
    edges = line_edges(segments.where("route_segment_id is not null"), ["route_segment_id"])
    found = cut_lineage(along_lines(points, edges, "route_segment_id", buffer_m, _TouchedGroups(), _TouchedGroups.schema, cfg, rank=["edge_no"]))
    of_segments = found.where("route_segment_id is not null").select("route_segment_id", F.inline(F.arrays_zip(F.col("words").alias("_word"), F.col("bits").alias("_bits"))))
    matched = found.where("met is not null").select("cx", "cy", "met", "groups").groupBy("cx", "cy").applyInArrow(_matched_events, "_group bigint, events bigint")
    return (of_segments.groupBy("route_segment_id", "_word").agg(F.bit_or("_bits").alias("_bits")),
            matched.groupBy("_group").agg(F.sum("events").alias("corridor_matched_event_count")))


def traffic_impact(facts: DataFrame, segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per road, type and severity: how many events, how long, and which corridor stretches they touch."""
    group = ["road_name", "event_type", "severity"]

    def onto(base: DataFrame, part: DataFrame) -> DataFrame:
        """Left join on the group; events without a road form a group of their own."""
        part = part.withColumnsRenamed({c: f"_{c}" for c in group})
        same = F.col("road_name").eqNullSafe(F.col("_road_name"))
        same = same & (F.col("event_type") == F.col("_event_type")) & (F.col("severity") == F.col("_severity"))
        return base.join(part, same, "left").drop(*(f"_{c}" for c in group))

    numbered = cut_lineage(facts.select(*group).distinct().withColumn("_group", F.monotonically_increasing_id()))
    # a stretch counts once per group however many events touch it
    touched, matched = _touched(onto(facts, numbered).where("_group is not null"), segments, cfg.traffic_buffer_m, cfg)
    stretches = touched.join(segments.select("route_segment_id", "route_id", "segment_distance_km").distinct(), "route_segment_id")

    def groups_of(rows: DataFrame) -> DataFrame:
        each = rows.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("(shiftright(_bits, _bit) & 1L) = 1"))
        return each.withColumn("_group", F.col("_word") * 64 + F.col("_bit"))

    lengths = groups_of(stretches).groupBy("_group").agg(F.count(F.lit(1)).alias("affected_segment_count"), F.sum("segment_distance_km").alias("_km"))
    on_routes = stretches.where("route_id is not null").groupBy("route_id", "_word").agg(F.bit_or("_bits").alias("_bits"))
    on_routes = groups_of(on_routes).groupBy("_group").agg(F.count(F.lit(1)).alias("affected_route_count"))
    flags = {
        "active_event_count": "is_active_now", "upcoming_event_count": "is_upcoming", "expired_event_count": "is_expired",
        "blocked_event_count": "is_blocked", "open_ended_event_count": "is_open_ended",
        "events_with_extent_count": "has_extent_geometry", "events_with_reported_delay_count": "has_reported_delay",
    }
    rollup = facts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("event_count"), *(F.count_if(flag).alias(name) for name, flag in flags.items()),
        F.count_distinct("direction").alias("direction_count"), F.sum("delay_minutes").alias("_sum"),
        F.avg("delay_minutes").alias("_avg"), F.max("delay_minutes").alias("max_reported_delay_minutes"),
        F.min("starts_at").alias("earliest_starts_at"), F.max("ends_at").alias("latest_ends_at"),
        F.avg("planned_duration_hours").alias("_hours"), F.max("evaluated_at").alias("evaluated_at"),
        distinct_text("source_system").alias("source_systems"), distinct_text("data_origin").alias("data_origins"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )

    joined = onto(rollup, numbered).join(lengths, "_group", "left").join(on_routes, "_group", "left").join(matched, "_group", "left").drop("_group")
    zero = ("affected_route_count", "affected_segment_count", "corridor_matched_event_count")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).withColumns({
        "is_road_known": F.col("road_name").isNotNull(),
        "severity_ordinal": lookups.severity_ordinal(F.col("severity")),
        "severity_delay_factor": lookups.severity_delay_factor(F.col("severity")),
        "has_active_event": F.col("active_event_count") > 0,
        "total_reported_delay_minutes": round_decimal(F.col("_sum"), 1),
        "mean_reported_delay_minutes": round_decimal(F.col("_avg"), 1),
        "mean_planned_duration_hours": round_decimal(F.col("_hours"), 2),
        "delay_reporting_coverage_percent": share_percent(F.col("events_with_reported_delay_count"), F.col("event_count")),
        "match_buffer_km": F.lit(cfg.traffic_buffer_m / 1000.0),
        "affected_segment_distance_km": round_decimal(F.coalesce("_km", F.lit(0.0)), 3),
        "corridor_match_share_percent": share_percent(F.col("corridor_matched_event_count"), F.col("event_count")),
    }).drop("_sum", "_avg", "_hours", "_km")


def events_along_route(routes: DataFrame, events: DataFrame, as_of: datetime, buffer_m: float, cfg: Config = DEFAULT) -> DataFrame:
    """Active events near each corridor with their offset along it."""
    live = events.where(active_at(F.col("starts_at"), F.col("ends_at"), as_of))
    return distance_join(live, routes, ["traffic_event_id"], ["route_id"], buffer_m, cfg, keep=["severity", "is_blocked", "road_name"])


def _worst_in_bins(bin_m: float, reach: int) -> Callable[[Hits], list[tuple]]:
    """Per bin along a line the worst event, without those whose painted bins two others paint at least as badly."""
    def rows(hits: Hits) -> list[tuple]:
        offset, worst = hits.offset(), hits.of("_worst")
        bins = np.floor(offset / bin_m).astype(np.int64)
        first = bins.min()
        found = np.zeros(bins.max() - first + 1, np.int64)
        for level in np.unique(worst):
            found[bins[worst == level] - first] = level
        kept: list[tuple[int, int]] = []
        for at in np.flatnonzero(found).tolist():
            level = int(found[at])
            while len(kept) > 1 and kept[-1][1] <= min(level, kept[-2][1]) and at - kept[-2][0] <= 2 * reach + 1:
                kept.pop()
            kept.append((at, level))
        return [((first + at + 0.5) * bin_m, level) for at, level in kept]

    return rows


def worst_along_route(
    routes: DataFrame, events: DataFrame, as_of: datetime, buffer_m: float, cfg: Config = DEFAULT, reach_km: float = 2.0, bin_m: float = BIN_M
) -> DataFrame:
    """Of ``events_along_route`` what ``paint_events`` needs: the worst severity in each bin of a route, in its middle, without bins that change nothing."""
    live = events.where(active_at(F.col("starts_at"), F.col("ends_at"), as_of))
    single = one_row_each(live, ["traffic_event_id", "severity", "is_blocked", "road_name"])
    if single is None:  # an event in several places counts where it is nearest to the route
        return events_along_route(routes, events, as_of, buffer_m, cfg)
    level = lookups.severity_ordinal(_painted_severity())
    points = single.select("latitude", "longitude", level.alias("_worst")).where("_worst is not null")
    found = along_lines(
        points, line_edges(routes, ["route_id"]), "route_id", buffer_m, _worst_in_bins(bin_m, _reach(reach_km, bin_m)), "offset_m double, _level int", cfg,
        rank=["edge_no", "edge_start_m"])
    return found.select("route_id", "offset_m", lookups.severity_name(F.col("_level")).alias("severity"), F.lit(False).alias("is_blocked"))


def _painted_severity() -> Column:
    return F.when(F.col("is_blocked"), F.lit("severe")).otherwise(F.col("severity"))


def _reach(reach_km: float, bin_m: float) -> int:
    return max(1, int(reach_km * 1000.0 / bin_m))


def paint_events(placed: DataFrame, lengths: DataFrame, reach_km: float = 2.0, bin_m: float = BIN_M) -> DataFrame:
    """Worst severity per bin of a corridor; a blocked road counts as severe, untouched bins stay NULL."""
    reach, severity = _reach(reach_km, bin_m), _painted_severity()
    # the worst per bin first, as a number: few rows are spread over the neighbouring bins, and nothing is sorted
    centres = placed.select("route_id", F.floor(F.col("offset_m") / bin_m).alias("_centre"), lookups.severity_ordinal(severity).alias("_worst"))
    centres = centres.groupBy("route_id", "_centre").agg(F.max("_worst").alias("_worst"))
    painted = (
        centres.withColumn("bin", F.explode(F.sequence(F.col("_centre") - reach, F.col("_centre") + reach)))
        .groupBy("route_id", "bin").agg(lookups.severity_name(F.max("_worst")).alias("severity"))
    )
    bins = F.ceil(F.col("line_m") / bin_m)
    spine = lengths.select("route_id", F.explode(F.sequence(F.lit(0).cast("bigint"), bins - 1)).alias("bin"))
    return spine.join(painted, ["route_id", "bin"], "left")
