"""Nearest-neighbour and interval joins without comparing every pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.geo import with_utm32
from strom.operators.sizes import is_small, skew_join
from strom.operators.spatial import cell
from strom.session import cut_lineage

_RINGS_M = (15_000.0, 90_000.0, 600_000.0)
_FACTOR, _SLACK_M = 4, 1e-3  # a box holds so many by so many smaller ones; far above the rounding of distances


def _extent(points: DataFrame, sites: DataFrame) -> float:
    """No two of them are farther apart; 1 m if there are none."""
    def sides(df: DataFrame, x: str, y: str):
        return df.where(~F.isnan(x) & ~F.isnan(y)).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    low_x, high_x, low_y, high_y = ([v for v in pair if v is not None] for pair in zip(sides(points, "px", "py"), sides(sites, "sx", "sy")))
    return math.hypot(max(high_x) - min(low_x), max(high_y) - min(low_y)) + 1.0 if low_x else 1.0


def _finer(sites: DataFrame, first_m: float) -> list[float]:
    """Rings before the first one where sites stand closely: cells of about one site, then four times as wide, so that a point meets a few sites
    however many there are. The area is that of the cells of the first ring with a site in them.
    """
    cells = sites.where("sx is not null and sy is not null").groupBy(cell(F.col("sx"), first_m).alias("cx"), cell(F.col("sy"), first_m).alias("cy")).count()
    taken, count = cells.agg(F.count(F.lit(1)), F.sum("count")).first()
    sizes, size = [], math.sqrt(taken / count) * first_m if count else first_m
    while size * 2 <= first_m and len(sizes) < 8:
        sizes.append(size)
        size *= 4
    return sizes


def _boxes(sites: DataFrame, size: float, extent: float) -> list[DataFrame]:
    """What the sites in each cell take up, from cells of ``size`` to those that only a few of lie within ``extent``."""
    corners = {"west": F.min("sx"), "east": F.max("sx"), "south": F.min("sy"), "north": F.max("sy")}
    levels = [cut_lineage(sites.groupBy(cell(F.col("sx"), size).alias("cx"), cell(F.col("sy"), size).alias("cy")).agg(
        *(c.alias(n) for n, c in corners.items())))]
    while size < extent:
        size *= _FACTOR
        up = {a: F.floor(F.col(a) / _FACTOR).cast("bigint") for a in ("cx", "cy")}
        levels.append(cut_lineage(levels[-1].groupBy(*(c.alias(a) for a, c in up.items())).agg(
            *(getattr(F, f)(n).alias(n) for n, f in (("west", "min"), ("east", "max"), ("south", "min"), ("north", "max"))))))
    return levels


def _descend(points: DataFrame, sites: DataFrame, point_id: Sequence[str], site_id: str, limit: float, size: float, extent: float, cfg: Config) -> DataFrame:
    """The nearest site within ``limit`` of points that may be far from any, ``_b`` with distance and id.

    From boxes about as large as everything down to cells of ``size``, a point goes on with boxes that may hold a site no farther than the farthest
    corner of another box, so it meets a few boxes of each size, however many sites there are.
    """
    def gap(at: str, low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(low) - F.col(at), F.col(at) - F.col(high))

    def span(at: str, low: str, high: str) -> Column:
        return F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high)))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if is_small(right, cfg.broadcast_rows // 9):
            return left.join(F.broadcast(right), on)
        return skew_join(left, right, on, F.struct("px", "py"), cfg.salt_buckets, hot_rows=cfg.hot_rows)

    sites = sites.where("sx is not null and sy is not null and not isnan(sx) and not isnan(sy)")
    levels, open_boxes = _boxes(sites, size, extent), None
    for boxes in reversed(levels):
        if open_boxes is None:  # the largest boxes: no more than 2 x 2, as none is smaller than the extent
            pairs = points.crossJoin(F.broadcast(boxes))
        else:
            pairs = met(open_boxes, boxes.withColumns({"_up_x": F.floor(F.col("cx") / _FACTOR), "_up_y": F.floor(F.col("cy") / _FACTOR)}), ["_up_x", "_up_y"])
        pairs = pairs.withColumns({"_near": F.hypot(gap("px", "west", "east"), gap("py", "south", "north")),
                                   "_far": F.hypot(span("px", "west", "east"), span("py", "south", "north"))}).where(F.col("_near") <= limit + _SLACK_M)
        least = F.min("_far").over(W.partitionBy(*point_id))
        kept = pairs.withColumn("_least", least).where(F.col("_near") <= F.col("_least") + _SLACK_M)
        open_boxes = cut_lineage(kept.select(*point_id, "px", "py", F.col("cx").alias("_up_x"), F.col("cy").alias("_up_y")))
    placed = sites.withColumns({"_up_x": cell(F.col("sx"), size), "_up_y": cell(F.col("sy"), size)})
    distance = F.hypot(F.col("sx") - F.col("px"), F.col("sy") - F.col("py"))
    best = met(open_boxes, placed, ["_up_x", "_up_y"]).groupBy(*point_id).agg(F.min(F.struct(distance.alias("distance_m"), F.col(site_id))).alias("_b"))
    return best.where(F.col("_b.distance_m") <= limit)


def nearest(
    points: DataFrame, sites: DataFrame, point_id: Sequence[str], site_id: str, radius_m: float | None = None,
    cfg: Config = DEFAULT, rings_m: Sequence[float] = _RINGS_M,
) -> DataFrame:
    """The nearest site of every point, ties by site id: point columns, site id, distance. Points without one are kept.

    Search widens ring by ring: a point looks into its own and the eight neighbouring cells, which is
    conclusive once the best distance is no longer than the cell side; only inconclusive points go on
    to the next, larger cells. Points that the first of ``rings_m`` leaves open descend through boxes of sites, as a larger ring might hold
    every site. ``radius_m`` bounds the search; without it every point finds its site however far away.
    """
    spots = cut_lineage(with_utm32(sites.select(site_id, "latitude", "longitude"), "latitude", "longitude", "sx", "sy").select(
        site_id, "sx", "sy"))
    small = is_small(spots, cfg.broadcast_rows // 9)
    open_points = cut_lineage(with_utm32(points, "latitude", "longitude", "px", "py"))
    extent = _extent(open_points, spots)
    limit = radius_m if radius_m is not None else extent
    first = min(rings_m[0], limit)
    finer = _finer(spots, first)
    sizes = finer or [first]
    done = None
    for size in sizes:
        around = spots.withColumn("cx", F.explode(F.sequence(cell(F.col("sx"), size) - 1, cell(F.col("sx"), size) + 1)))
        around = around.withColumn("cy", F.explode(F.sequence(cell(F.col("sy"), size) - 1, cell(F.col("sy"), size) + 1)))
        here = open_points
        keyed = here.select(*point_id, "px", "py").withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
        pairs = (
            keyed.join(F.broadcast(around), ["cx", "cy"]) if small
            else skew_join(keyed, around, ["cx", "cy"], F.struct("px", "py"), cfg.salt_buckets, hot_rows=cfg.hot_rows)
        )
        distance = F.hypot(F.col("sx") - F.col("px"), F.col("sy") - F.col("py"))
        best = pairs.groupBy(*point_id).agg(F.min(F.struct(distance.alias("distance_m"), F.col(site_id))).alias("_b"))
        found = best.where(F.col("_b.distance_m") <= min(size, limit)).select(
            *point_id, F.col(f"_b.{site_id}").alias(site_id), F.col("_b.distance_m").alias("distance_m")
        )
        found = cut_lineage(found)
        done = found if done is None else done.unionByName(found)
        open_points = open_points.join(found.select(*point_id), list(point_id), "left_anti")
    open_points = cut_lineage(open_points.where("px is not null and py is not null").select(*point_id, "px", "py"))
    if sizes[-1] < limit and not open_points.isEmpty():
        far = _descend(open_points, spots, point_id, site_id, limit, sizes[0], extent, cfg)
        done = done.unionByName(far.select(*point_id, F.col(f"_b.{site_id}").alias(site_id), F.col("_b.distance_m").alias("distance_m")))
    return points.join(done, list(point_id), "left")


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_width: float
) -> DataFrame:
    """Pairs of overlapping half-open intervals of one key, with the overlap length.

    Both sides are cut into bins; a pair meets in every bin both cover and is kept only in the bin
    where its overlap starts, so each pair appears once and a long key is spread over its bins. Neither side is broadcast
    by its estimated size: that knows nothing of the rows that come out of exploded arrays.
    """
    def binned(df: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.ceil(F.col(end) / bin_width) - 1, F.floor(F.col(start) / bin_width))
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), last)))

    (ls, le), (rs, re) = left_span, right_span
    start, end = F.greatest(ls, rs), F.least(le, re)
    pairs = binned(left, ls, le).join(binned(right, rs, re).hint("merge"), [key, "_bin"])
    return pairs.where((start < end) & (F.floor(start / bin_width) == F.col("_bin"))).withColumn("overlap", end - start).drop("_bin")
