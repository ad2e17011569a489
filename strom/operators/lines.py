"""Pieces of polylines, cut out by offsets along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.operators.nearest import interval_join
from strom.operators.spatial import line_edges

_BIN_M, _TOUCH_M = 25_000.0, 1e-6


def on_edge(offset: Column) -> tuple[Column, Column]:
    """Latitude and longitude at an offset along the line, on the edge of the row."""
    t = F.when(F.col("edge_m") > 0, (offset - F.col("edge_start_m")) / F.col("edge_m")).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.col("lat0") + (F.col("lat1") - F.col("lat0")) * t, F.col("lon0") + (F.col("lon1") - F.col("lon0")) * t


def line_substring(routes: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` (route_id, piece, start_m, end_m in the metric grid) cut out of their lines as vertex lists.

    A piece only meets the edges it overlaps, in bins along the line; an overlap within the rounding of offsets is none.
    """
    edges = line_edges(routes, ["route_id"]).withColumn("edge_end_m", F.col("edge_start_m") + F.col("edge_m"))
    overlaps = interval_join(
        pieces.select("route_id", "piece", "start_m", "end_m"), edges, "route_id", ("start_m", "end_m"), ("edge_start_m", "edge_end_m"), _BIN_M
    ).where(F.col("overlap") > _TOUCH_M)
    begin, finish = F.greatest("start_m", "edge_start_m"), F.least("end_m", "edge_end_m")
    (lat_a, lon_a), (lat_b, lon_b) = on_edge(begin), on_edge(finish)
    # every overlapped edge gives its first point; the last one also its end
    closes = F.col("end_m") <= F.col("edge_end_m") + _TOUCH_M
    point = F.struct(begin.alias("at"), lat_a.alias("latitude"), lon_a.alias("longitude"))
    end_point = F.struct(finish.alias("at"), lat_b.alias("latitude"), lon_b.alias("longitude"))
    spots = F.when(closes, F.array(point, end_point)).otherwise(F.array(point))
    return (
        overlaps.select("route_id", "piece", F.inline(spots)).groupBy("route_id", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("at", "latitude", "longitude"))).alias("vertices"))
    )


def geojson_line(vertices: Column) -> Column:
    """A list of vertices as the text of a GeoJSON LineString."""
    spots = F.array_join(F.transform(vertices, lambda v: F.format_string("[%.6f, %.6f]", v.longitude, v.latitude)), ", ")
    return F.concat(F.lit('{"type": "LineString", "coordinates": ['), spots, F.lit("]}"))
