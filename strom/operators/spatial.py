"""Distance joins on a metric grid.

Spark has no spatial join, and a bare distance predicate becomes a nested loop. Each edge of a line
is assigned to the grid cells it can reach within the buffer, each point to its one cell; the cell
is an equi-join key, and the exact distance decides. A point meets every edge at most once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strom.config import DEFAULT, Config
from strom.functions.geo import planar_to_edge, with_utm32
from strom.operators.sizes import is_small, skew_join
from strom.session import cut_lineage

# a cell whose points and edges make more pairs than this many times their number is cut into 4 x 4, down to a 256th of the first cells
_CROWDED, _CUT, _CUTS = 16, 4, 4
_SLACK_M = 1e-3  # far above the rounding of distances and cells


def line_edges(lines: DataFrame, line_id: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """Edges of every polyline in metres: x0, y0, x1, y1, length, running offset, line length.

    ``geometry`` is an array of (ordinal, latitude, longitude) in line order. A line is one row, so
    the per-line window below is bounded by what fits into a row. Lines are brought together as rows and
    projected afterwards: a small table may stand for many vertices, and few tasks read it. An inner explode would
    make Spark check every geometry at the scan, and work out those that are computed there several times.
    """
    vertices = lines.select(*line_id, F.col(geometry).alias("_line")).repartition(*line_id)
    vertices = vertices.select(*line_id, F.posexplode_outer("_line").alias("_at", "_v")).where("_at is not null").select(
        *line_id, (F.col("_at") + 1).alias("edge_no"), F.col("_v.latitude").alias("lat0"), F.col("_v.longitude").alias("lon0"),
    )
    vertices = with_utm32(vertices, "lat0", "lon0", "x0", "y0")
    along = W.partitionBy(*line_id).orderBy("edge_no")
    edges = vertices.withColumns({
        after: F.lead(before).over(along) for before, after in (("lat0", "lat1"), ("lon0", "lon1"), ("x0", "x1"), ("y0", "y1"))
    })
    edges = edges.withColumn("edge_m", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    return edges.withColumns({
        "line_m": F.sum("edge_m").over(W.partitionBy(*line_id)),
        "edge_start_m": F.sum("edge_m").over(so_far) - F.col("edge_m"),
    }).where(F.col("x1").isNotNull())


def cell(metres: Column, size: float) -> Column:
    return F.floor(metres / size)


def _span(a: Column, b: Column, buffer_m: float, size: float) -> tuple[Column, Column]:
    return cell(F.least(a, b) - buffer_m, size), cell(F.greatest(a, b) + buffer_m, size)


def _reaches(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, buffer_m: float, size: float) -> Column:
    distance, _ = planar_to_edge((cx + 0.5) * size, (cy + 0.5) * size, x0, y0, x1, y1)
    return distance <= buffer_m + size * 0.7072


def edge_cover(edges: DataFrame, buffer_m: float, size: float) -> DataFrame:
    """One row per edge and grid cell that can hold a point within the buffer."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    covered = edges
    for axis, a, b in (("cx", ends[0], ends[2]), ("cy", ends[1], ends[3])):
        covered = covered.withColumn(axis, F.explode(F.sequence(*_span(a, b, buffer_m, size))))
    return covered.where(_reaches(*ends, F.col("cx"), F.col("cy"), buffer_m, size))


def covers(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, buffer_m: float, size: float) -> Column:
    """Whether ``edge_cover`` gives this cell to this edge."""
    inside = [axis.between(*_span(a, b, buffer_m, size)) for axis, a, b in ((cx, x0, x1), (cy, y0, y1))]
    return inside[0] & inside[1] & _reaches(x0, y0, x1, y1, cx, cy, buffer_m, size)


def with_cells(points: DataFrame, size: float, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Points with metric position and cell; those without a position match nothing and are left out."""
    points = with_utm32(points.where(F.col(latitude).isNotNull() & F.col(longitude).isNotNull()), latitude, longitude, "px", "py")
    return points.withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})


def deal_out(df: DataFrame, *by: str) -> DataFrame:
    """Few bytes may stand for much work, so they go to a number of tasks that does not depend on their size."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *by)


def cell_join(points: DataFrame, cover: DataFrame, cfg: Config) -> DataFrame:
    """Equi-join on the cell; ``cover`` has been written. Hot cells are split: by broadcasting a small cover, else by dealing them out."""
    if is_small(cover, cfg.broadcast_rows):
        return points.join(F.broadcast(cover), ["cx", "cy"])
    return skew_join(points, cover, ["cx", "cy"], F.struct("px", "py"), cfg.salt_buckets, hot_rows=cfg.hot_rows)


def with_steps(edges: DataFrame) -> DataFrame:
    """Adds what ``_spot`` needs of every edge: its extent in both directions and its length, which is never zero."""
    return edges.withColumns({"run": F.col("x1") - F.col("x0"), "rise": F.col("y1") - F.col("y0"), "step_m": F.greatest("edge_m", F.lit(1e-9))})


def _spot(part: Callable[[str], Column]) -> tuple[Column, Column]:
    """Distance of the point (px, py) to the edge whose columns ``part`` gives, and the offset of the nearest spot along its line."""
    along = ((F.col("px") - part("x0")) * part("run") + (F.col("py") - part("y0")) * part("rise")) / part("step_m")
    along = F.greatest(F.lit(0.0), F.least(part("edge_m"), along))
    share = along / part("step_m")
    return F.hypot(F.col("px") - part("x0") - share * part("run"), F.col("py") - part("y0") - share * part("rise")), part("edge_start_m") + along


def _in_cells(df: DataFrame, cells: DataFrame, cfg: Config, how: str) -> DataFrame:
    """Rows of ``df`` joined with their cell, one row each in ``cells``."""
    if how == "inner" and not is_small(cells, cfg.broadcast_rows):
        return skew_join(df, cells, ["cx", "cy"], F.struct("x0", "y0", "x1", "y1"), cfg.salt_buckets, hot_rows=cfg.hot_rows)
    return df.join(F.broadcast(cells) if is_small(cells, cfg.broadcast_rows) else cells, ["cx", "cy"], how)


def _first_of_equals(edges: DataFrame, edge_id: Sequence[str]) -> DataFrame:
    """Of edges in exactly the same place the first by ``edge_id``: every point is equally far from them all."""
    place = ["x0", "y0", "x1", "y1", "edge_m"]
    rest = [c for c in edges.columns if c not in {*place, *edge_id}]
    return edges.groupBy(*place).agg(F.min(F.struct(*edge_id, *rest)).alias("_first")).select(*place, "_first.*")


def _leading(spots: DataFrame, cover: DataFrame, buffer_m: float, size: float, cfg: Config) -> DataFrame:
    """Rows of ``cover`` in cells with a point, without edges that are nearest to no place of the cell, with the cell's number of points.

    A place of a cell is at most half a diagonal from its centre, so an edge farther from the centre than another one by a whole diagonal is
    farther from every place.
    """
    far, _ = planar_to_edge((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    cover = cover.withColumn("_far", far).where(F.col("_far") <= buffer_m + size * 0.7072)
    cells = cover.groupBy("cx", "cy").agg(F.min("_far").alias("_least")).join(
        spots.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_spots")), ["cx", "cy"])
    kept = _in_cells(cover, cut_lineage(cells), cfg, "inner").where(F.col("_far") <= F.col("_least") + size * 1.4144 + _SLACK_M)
    return cut_lineage(kept.drop("_far", "_least"))


def _leading_pairs(spots: DataFrame, edges: DataFrame, buffer_m: float, size: float, cfg: Config) -> DataFrame:
    """Pairs of a point and an edge in its cell, at least those with the nearest edge; crowded cells are cut up first.

    Cells that are not crowded make no more pairs than ``_CROWDED`` times their points and edges together. Cutting ends with the smallest cells,
    where what is left meets pair by pair.
    """
    cover, parts = _leading(spots, edge_cover(edges, buffer_m, size), buffer_m, size, cfg), []
    for _ in range(_CUTS):
        counted = cover.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_edges"), F.max("_spots").alias("_spots"))
        crowded = cut_lineage(counted.where(F.col("_edges") * F.col("_spots") > _CROWDED * (F.col("_edges") + F.col("_spots"))).select("cx", "cy"))
        if crowded.isEmpty():
            break
        parts.append(cell_join(_in_cells(spots, crowded, cfg, "left_anti"), _in_cells(cover, crowded, cfg, "left_anti").drop("_spots"), cfg))
        size /= _CUT
        spots = cut_lineage(_in_cells(spots, crowded, cfg, "left_semi").withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)}))
        cover = deal_out(_in_cells(cover, crowded, cfg, "left_semi").drop("_spots"))
        for axis in ("cx", "cy"):
            cover = cover.withColumn(axis, F.explode(F.sequence(F.col(axis) * _CUT, F.col(axis) * _CUT + (_CUT - 1))))
        cover = _leading(spots, cover, buffer_m, size, cfg)
    parts.append(cell_join(spots, cover.drop("_spots"), cfg))
    return reduce(DataFrame.unionByName, parts)


def edge_matches(
    points: DataFrame, edges: DataFrame, buffer_m: float, cfg: Config = DEFAULT, cell_m: float | None = None, nearest_by: Sequence[str] = (),
) -> DataFrame:
    """Every (point, edge) pair within the buffer, with distance and offset along the line.

    With ``nearest_by``, the columns that decide between equally near edges, pairs are left out that are not needed to find the least (distance
    rounded to micrometres, ``nearest_by``) of a point, and pairs grow no faster than points and edges together.
    """
    size = max(cell_m or buffer_m, 1.0)
    slim = with_steps(edges.drop("lat0", "lon0", "lat1", "lon1"))
    # points are written with position and cell: a join on the cell would compute the projection again in a filter at the scan, and
    # projection, join and distance in one stage make code too large to be compiled well
    spots = cut_lineage(deal_out(with_cells(points, size)))
    if nearest_by:
        pairs = _leading_pairs(spots, cut_lineage(deal_out(_first_of_equals(slim, nearest_by))), buffer_m, size, cfg)
    else:
        pairs = cell_join(spots, cut_lineage(edge_cover(deal_out(slim), buffer_m, size)), cfg)
    distance, offset = _spot(F.col)
    near = pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= buffer_m)
    return near.withColumn("offset_m", offset).drop("cx", "cy", "run", "rise", "step_m")


def closest_spots(
    points: DataFrame, edges: DataFrame, point_id: Sequence[str], line_id: Sequence[str], buffer_m: float,
    rank: Callable[[Column, Column, Callable[[str], Column]], Column], cfg: Config = DEFAULT, keep: Sequence[str] = (), line_keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (point, line) with an edge within the buffer, and the least ``rank`` of these edges as ``_best``.

    ``rank`` makes a struct of distance, offset and the columns of an edge; the distance, unrounded or rounded, comes first. ``line_keep`` names columns
    that are alike in all edges of a line. A point meets a line in its own cell only, and there all edges within reach of it, so the edges of a line are
    gathered per cell beforehand and no pair is shuffled. Only points whose key comes back are grouped afterwards.
    """
    size = max(buffer_m, 1.0)
    slim = with_steps(edges.drop("lat0", "lon0", "lat1", "lon1"))
    own = [c for c in slim.columns if c not in {*line_id, *line_keep}]
    cover = edge_cover(deal_out(slim, *line_id), buffer_m, size).groupBy(*line_id, "cx", "cy").agg(
        F.collect_list(F.struct(*own)).alias("_edges"), *(F.first(c).alias(c) for c in line_keep))
    cover = cut_lineage(cover.withColumn("_count", F.size("_edges")))
    most = cover.agg(F.max("_count")).first()[0] or 1
    one = cover.where("_count = 1").select("cx", "cy", *line_id, *line_keep, *(F.col("_edges")[0].getField(c).alias(c) for c in own))
    several = cover.where("_count > 1").drop("_count")
    # points are written with position and cell: a join on the cell would compute the projection again in a filter at the scan
    spots = with_cells(points.select(*point_id, *keep, "latitude", "longitude"), size).drop("latitude", "longitude")
    spots = cut_lineage(deal_out(spots))
    key = [*dict.fromkeys([*point_id, *keep])]

    def ranked(part: Callable[[str], Column]) -> Column:
        distance, offset = _spot(part)
        return F.when(distance <= buffer_m, rank(distance, offset, part))

    def matched(met: DataFrame) -> DataFrame:
        distance, offset = _spot(F.col)
        near = cell_join(met, one, cfg).withColumn("_m", distance).where(F.col("_m") <= buffer_m)
        parts = [near.withColumn("_best", rank(F.col("_m"), offset, F.col))]
        if most > 1:  # the distance alone decides who meets: Spark interprets functions over arrays
            near = cell_join(met, several, cfg).where(F.array_min(F.transform("_edges", lambda e: _spot(e.getField)[0])) <= buffer_m)
            parts.append(near.withColumn("_best", F.array_min(F.transform("_edges", lambda e: ranked(e.getField)))))
        return reduce(DataFrame.unionByName, (p.select(*line_id, *key, *line_keep, "_best") for p in parts))

    again = cut_lineage(spots.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_again_{c}") for c in key)))
    if again.isEmpty():
        return matched(spots)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in key))
    grouped = matched(spots.join(again, same, "left_semi")).groupBy(*line_id, *key).agg(
        *(F.first(c).alias(c) for c in line_keep), F.min("_best").alias("_best"))
    return matched(spots.join(again, same, "left_anti")).unionByName(grouped)


def distance_join(
    points: DataFrame, lines: DataFrame, point_id: Sequence[str], line_id: Sequence[str], buffer_m: float,
    cfg: Config = DEFAULT, keep: Sequence[str] = (), geometry: str = "geometry",
) -> DataFrame:
    """Points within ``buffer_m`` of a polyline: one row per (point, line) with the nearest spot.

    ``keep`` names further point columns to carry. Only edges a point is close to are compared, and no pair is shuffled.
    """
    near = closest_spots(
        points, line_edges(lines, line_id, geometry), point_id, line_id, buffer_m,
        lambda distance, offset, edge: F.struct(distance.alias("distance_m"), edge("edge_no").alias("edge_no"), offset.alias("offset_m")),
        cfg, keep, ["line_m"])
    return near.select(
        *line_id, *point_id, *keep, F.col("_best.distance_m").alias("distance_m"), F.col("_best.offset_m").alias("offset_m"), "line_m")


def segments_distance(pairs: DataFrame, a: str = "a", b: str = "b") -> Column:
    """Distance between two edges named by prefixes (``<p>x0`` ...); zero where they cross."""
    def c(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}{name}")

    def ends(p: str, q: str) -> list[Column]:
        return [
            planar_to_edge(c(p, f"x{i}"), c(p, f"y{i}"), c(q, "x0"), c(q, "y0"), c(q, "x1"), c(q, "y1"))[0]
            for i in (0, 1)
        ]

    def side(p: str, q: str, i: int) -> Column:
        return (c(p, "x1") - c(p, "x0")) * (c(q, f"y{i}") - c(p, "y0")) - (c(p, "y1") - c(p, "y0")) * (
            c(q, f"x{i}") - c(p, "x0")
        )

    crossing = (side(a, b, 0) * side(a, b, 1) < 0) & (side(b, a, 0) * side(b, a, 1) < 0)
    return F.when(crossing, F.lit(0.0)).otherwise(F.least(*ends(a, b), *ends(b, a)))
