"""Geodesic and metric-grid functions on coordinate columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371.0088 * 1000.0  # fixed value


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) * (2 * EARTH_RADIUS_M)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlon = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def point_to_edge_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a short edge in a local plane centred on the point."""
    metre = math.pi / 180.0 * EARTH_RADIUS_M
    shrink = F.cos(F.radians(lat))
    ax, ay = (lon1 - lon) * shrink * metre, (lat1 - lat) * metre
    bx, by = (lon2 - lon) * shrink * metre, (lat2 - lat) * metre
    distance, _ = planar_to_edge(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    return distance


def planar_to_edge(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance from a point to an edge in a plane, and the clamped position 0..1 of the nearest spot."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((px - ax) * dx + (py - ay) * dy) / square).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


# Transverse Mercator after Krüger (4th order) on GRS80, zone 32: EPSG:25832
_A, _F = 6378137.0, 1 / 298.257222101
_N = _F / (2 - _F)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
)
_SCALE = 0.9996 * _RECTIFYING


def with_utm32(df: DataFrame, latitude: str, longitude: str, x: str, y: str) -> DataFrame:
    """Adds easting and northing in metres."""
    sin_lat = F.sin(F.radians(F.col(latitude)))
    df = df.withColumn(f"_t_{x}", F.sinh(F.atanh(sin_lat) - F.atanh(sin_lat * _E) * _E))
    delta = F.radians(F.col(longitude) - 9.0)
    t = F.col(f"_t_{x}")
    df = df.withColumns({
        f"_xi_{x}": F.atan2(t, F.cos(delta)),
        f"_eta_{x}": F.atanh(F.sin(delta) / F.sqrt(t * t + 1.0)),
    })
    xi, eta = F.col(f"_xi_{x}"), F.col(f"_eta_{x}")
    east, north = eta, xi
    for j, alpha in enumerate(_ALPHA, 1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * alpha
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * alpha
    return df.withColumns({x: east * _SCALE + 500_000.0, y: north * _SCALE}).drop(f"_t_{x}", f"_xi_{x}", f"_eta_{x}")


def duck_utm32(relation: str, latitude: str, longitude: str, x: str, y: str) -> str:
    """Oracle spelling of ``with_utm32``: a subquery over ``relation`` with two more columns."""
    sin_lat = f"sin(radians({latitude}))"
    east = "eta_" + "".join(f" + {a!r}::double * cos({2*j}*xi_) * sinh({2*j}*eta_)" for j, a in enumerate(_ALPHA, 1))
    north = "xi_" + "".join(f" + {a!r}::double * sin({2*j}*xi_) * cosh({2*j}*eta_)" for j, a in enumerate(_ALPHA, 1))
    return (
        f"(select * exclude (t_, xi_, eta_), 500000::double + {_SCALE!r}::double * ({east}) as {x}, "
        f"{_SCALE!r}::double * ({north}) as {y} from "
        f"(select *, atan2(t_, cos(radians({longitude} - 9))) as xi_, "
        f"atanh(sin(radians({longitude} - 9)) / sqrt(1 + t_ * t_)) as eta_ from "
        f"(select *, sinh(atanh({sin_lat}) - {_E!r}::double * atanh({_E!r}::double * {sin_lat})) as t_ from {relation}) u1) u2)"
    )
