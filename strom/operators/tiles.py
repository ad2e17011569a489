"""Figures of the points near each line, without a row for any pair of point and line.

Points and edges are dealt into square tiles. A task holds the points of one tile, sorted by rows and within them by x, takes one line after
the other, finds the points within the buffer with the nearest spot of the line to each, and hands them to a function that keeps what the
result needs. Comparing is still as much work as there are pairs near each other, but only the kept figures are written, moved and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strom.config import DEFAULT, Config
from strom.functions.geo import with_utm32
from strom.operators.sizes import is_small
from strom.operators.spatial import cell, deal_out, edge_cover, with_steps
from strom.session import cut_lineage

TILE_M = 50_000.0
# a tile is halved until no task gets more points than this, and its lines are dealt out so that no task gets more edges than that
MOST_POINTS, MOST_EDGES = 1_000_000, 8_192
_SLACK_M = 1e-3
_EDGE = ("x0", "y0", "x1", "y1", "run", "rise", "edge_m", "step_m", "edge_start_m")


class Hits:
    """The points near one line, once each: their places in the tile's ``columns``, distance, place of the nearest edge in ``edges``, offset along that edge."""

    def __init__(self, columns: dict, edges: dict, at: np.ndarray, distance: np.ndarray, edge: np.ndarray, along: np.ndarray, tile: tuple[float, float, float]):
        self.columns, self.edges, self.at, self.distance, self.edge, self.along, self.tile = columns, edges, at, distance, edge, along, tile

    def of(self, column: str) -> np.ndarray:
        return self.columns[column][self.at]

    def one_edge(self) -> list[float]:
        """The figures of the first hit's edge, as ``nearest_spot`` takes them."""
        return [float(self.edges[c][self.edge[0]]) for c in _EDGE]

    def edge_of(self, column: str) -> np.ndarray:
        return self.edges[column][self.edge]

    def offset(self) -> np.ndarray:
        return self.edge_of("edge_start_m") + self.along

    def inside(self) -> Hits:
        """Those whose nearest spot lies in this tile; every other one is inside in another tile."""
        size, cx, cy = self.tile
        share = self.along / self.edge_of("step_m")
        sx, sy = self.edge_of("x0") + share * self.edge_of("run"), self.edge_of("y0") + share * self.edge_of("rise")
        kept = (np.floor(sx / size) == cx) & (np.floor(sy / size) == cy)
        return self if kept.all() else Hits(self.columns, self.edges, self.at[kept], self.distance[kept], self.edge[kept], self.along[kept], self.tile)


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {name: table.column(name).to_pandas().to_numpy() for name in table.column_names}


def _upper(values: np.ndarray) -> np.ndarray:
    """Numbers without the lower 32 bits of their mantissa."""
    return (values.view(np.int64) & -(1 << 32)).view(np.float64)


def hypot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """To the last bit what Spark's ``hypot`` gives (fdlibm), so that of two edges that lie on each other the same one is nearest here and there."""
    a, b = np.maximum(np.abs(x), np.abs(y)), np.minimum(np.abs(x), np.abs(y))
    w, high = a - b, _upper(a)
    far = np.sqrt(high * high - (b * -b - (a - high) * (a + high)))
    twice, upper = a + a, _upper(b)
    high = _upper(twice)
    even = np.sqrt(high * upper - (w * -w - (high * (b - upper) + (twice - high) * b)))
    return np.where(b < a * 2.0**-60, a + b, np.where(w > b, far, even))


def nearest_spot(px: np.ndarray, py: np.ndarray, edge: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset along an edge, in the order of ``_EDGE``, of the nearest spot to each point, and the way from there to the point."""
    x0, y0, _, _, run, rise, edge_m, step_m, _ = edge
    qx, qy = px - x0, py - y0
    along = np.maximum(0.0, np.minimum(edge_m, (qx * run + qy * rise) / step_m))
    share = along / step_m
    return along, qx - share * run, qy - share * rise


class _Near:
    """Finds the points of a tile near edges."""

    def __init__(self, px: np.ndarray, py: np.ndarray, buffer_m: float):
        self.reach, self.high = buffer_m + _SLACK_M, max(buffer_m / 2, 1.0)
        row = np.floor(py / self.high)
        self.order = np.lexsort((px, row))
        self.px, self.py = px[self.order], py[self.order]
        self.first_row, self.last_row = row.min(), row.max()
        self.left, self.wide = self.px.min() - 1.0, np.ptp(self.px) + 3.0
        # rows lie one behind the other, so one search finds a stretch of any of them
        self.keys = (row[self.order] - self.first_row) * self.wide + (self.px - self.left)

    def stretches(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """First place and number of points that may be near, for each row an edge can reach, and where the rows of each edge begin.

        In a row these are the points beside the part of the edge that is near the row.
        """
        reach, high = self.reach, self.high
        low = np.maximum(np.floor((np.minimum(y0, y1) - reach) / high), self.first_row)
        rows = np.maximum(np.minimum(np.floor((np.maximum(y0, y1) + reach) / high), self.last_row) - low + 1, 0).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(rows)))
        edge = np.repeat(np.arange(len(x0)), rows)
        row = low[edge] + (np.arange(begins[-1]) - begins[edge])
        x0, y0, run, rise = x0[edge], y0[edge], (x1 - x0)[edge], (y1 - y0)[edge]
        flat = rise == 0
        rise = np.where(flat, 1.0, rise)
        a, b = (np.where(flat, at, np.clip((row * high + side - y0) / rise, 0.0, 1.0)) * run + x0 for at, side in ((0.0, -reach), (1.0, high + reach)))
        base = (row - self.first_row) * self.wide
        start = np.searchsorted(self.keys, base + np.clip(np.minimum(a, b) - reach - self.left, 0.0, self.wide - 1.0), "left")
        end = np.searchsorted(self.keys, base + np.clip(np.maximum(a, b) + reach - self.left, 0.0, self.wide - 1.0), "right")
        return start, np.maximum(end - start, 0), begins.tolist()


def _matcher(line_id: str, buffer_m: float, size: float, rank: Sequence[str], digits: int | None, by_spot: bool, reduce: Callable[[Hits], list[tuple]], schema: pa.Schema):
    reach = (buffer_m + _SLACK_M) ** 2

    def work(key, lines: pa.Table, points: pa.Table) -> pa.Table:
        out: list[tuple] = []
        columns = _arrays(points)
        good = np.isfinite(columns["px"].astype(float)) & np.isfinite(columns["py"].astype(float))
        columns = columns if good.all() else {name: values[good] for name, values in columns.items()}
        if lines.num_rows and len(columns["px"]):
            near = _Near(columns["px"], columns["py"], buffer_m)
            columns = {name: values[near.order] for name, values in columns.items()}
            px, py, tile = near.px, near.py, (size, key[0].as_py(), key[1].as_py())
            edges = _arrays(lines)
            names, _ = pd.factorize(edges[line_id], use_na_sentinel=False)
            ranks = [pd.factorize(edges[c], sort=True)[0] for c in rank]
            order = np.lexsort((*reversed(ranks), names))
            edges, names = {c: v[order] for c, v in edges.items()}, names[order]
            numbers = np.column_stack([edges[c] for c in _EDGE]).astype(float).tolist()
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).tolist()
            first, count, begins = near.stretches(*(edges[c].astype(float) for c in _EDGE[:4]))
            best, chosen, spot = np.full(len(px), np.inf), np.zeros(len(px), np.int64), np.zeros(len(px))
            for a, b in zip(starts, [*starts[1:], len(names)]):
                found, one = [], None
                for i in range(a, b):
                    beside = count[begins[i]:begins[i + 1]]
                    ends = beside.cumsum()
                    if not len(ends) or not ends[-1]:
                        continue
                    at = np.arange(ends[-1]) + np.repeat(first[begins[i]:begins[i + 1]] - (ends - beside), beside)
                    along, qx, qy = nearest_spot(px[at], py[at], numbers[i])
                    close = np.flatnonzero(qx * qx + qy * qy <= reach)
                    distance = hypot(qx[close], qy[close])
                    close, distance = close[distance <= buffer_m], distance[distance <= buffer_m]
                    at, along = at[close], along[close]
                    measure = distance if digits is None else np.round(distance, digits)
                    if b - a == 1:
                        if len(at):
                            one = Hits(columns, edges, at, measure, np.full(len(at), i), along, tile)
                        continue
                    # edges come in the order of ``rank``, so an equally near one before stays
                    known = best[at]
                    found.append(at[known == np.inf])
                    better = measure < known
                    at = at[better]
                    best[at], chosen[at], spot[at] = measure[better], i, along[better]
                if found:
                    at = np.concatenate(found)
                    one = Hits(columns, edges, at, best[at], chosen[at], spot[at], tile)
                    best[at] = np.inf
                if one is not None:
                    hits = one.inside() if by_spot else one
                    if len(hits.at):
                        out += [(edges[line_id][a], *row) for row in reduce(hits)]
        if len(columns["px"]) and (finish := getattr(reduce, "finish", None)):
            out += [(None, *row) for row in finish(columns, tuple(k.as_py() for k in key))]
        made = list(zip(*out)) if out else [()] * len(schema)
        return pa.table([pa.array(values, type=field.type) for values, field in zip(made, schema)], schema=schema)

    return work


def _tile_size(spots: DataFrame, buffer_m: float, tile_m: float) -> float:
    size = max(tile_m, 2 * buffer_m)
    while size / 2 >= 2 * buffer_m:
        most = spots.groupBy(cell(F.col("px"), size).alias("cx"), cell(F.col("py"), size).alias("cy")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= MOST_POINTS:
            break
        size /= 2
    return size


def along_lines(
    points: DataFrame, edges: DataFrame, line_id: str, buffer_m: float, reduce: Callable[[Hits], list[tuple]], schema: str,
    cfg: Config = DEFAULT, *, rank: Sequence[str], digits: int | None = None, by_spot: bool = False, tile_m: float = TILE_M,
) -> DataFrame:
    """What ``reduce`` makes of the points within ``buffer_m`` of each line, tile by tile: rows of the line's id and ``schema``.

    ``edges`` are ``line_edges`` with columns that ``reduce`` needs; the nearest edge counts, by the distance to ``digits`` places, then by the columns
    ``rank``. Points are given by latitude and longitude, or by ``px`` and ``py`` in metres. Every point has a row of its own. A point counts in its own tile, or with ``by_spot`` in the tile of its nearest spot, so that within a
    tile no point is missing between two spots of a line. A method ``finish`` of ``reduce`` adds rows without a line from the columns of a task's points.
    """
    if "px" not in points.columns:
        points = with_utm32(points.where("latitude is not null and longitude is not null"), "latitude", "longitude", "px", "py").drop("latitude", "longitude")
    spots = cut_lineage(deal_out(points.where("px is not null and py is not null")))
    size = _tile_size(spots, buffer_m, tile_m)
    slim = with_steps(edges.drop("lat0", "lon0", "lat1", "lon1"))
    cover = cut_lineage(edge_cover(deal_out(slim, line_id), 2 * buffer_m if by_spot else buffer_m, size))
    parts = cut_lineage(cover.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / MOST_EDGES).cast("int").alias("_parts")))
    parts = F.broadcast(parts) if is_small(parts, cfg.broadcast_rows) else parts
    if by_spot:
        for axis, at in (("cx", "px"), ("cy", "py")):
            reach = cell(F.col(at) - buffer_m, size), cell(F.col(at) + buffer_m, size)
            spots = spots.withColumn(axis, F.explode(F.sequence(*reach)))
    else:
        spots = spots.withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
    keys = ["cx", "cy", "_part"]
    lines = cover.join(parts, ["cx", "cy"]).withColumn("_part", F.pmod(F.xxhash64(line_id), F.col("_parts")).cast("int")).drop("_parts")
    spots = spots.join(parts, ["cx", "cy"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    whole = StructType.fromDDL(f"{line_id} {edges.schema[line_id].dataType.simpleString()}, {schema}")
    work = _matcher(line_id, buffer_m, size, rank, digits, by_spot, reduce, to_arrow_schema(whole))
    return deal_out(lines, *keys).groupBy(*keys).cogroup(deal_out(spots, *keys).groupBy(*keys)).applyInArrow(work, whole)



def one_row_each(points: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """Points with a position, one row for each ``key``; None if rows of one key lie in different places."""
    key = [*dict.fromkeys(key)]
    points = points.where("latitude is not null and longitude is not null").select(*key, "latitude", "longitude")
    moved = (F.min("latitude") != F.max("latitude")) | (F.min("longitude") != F.max("longitude"))
    often = points.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), moved.alias("_moved"))
    rows, moved = often.agg(F.max("_rows"), F.max("_moved")).first()
    return None if moved else points.dropDuplicates(key) if (rows or 0) > 1 else points
