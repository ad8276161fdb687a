"""Distances, projections and tile arithmetic as Column expressions.

Coordinates are E5: integer degrees times 100,000. Everything here stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius in metres; metres around the equator of the Web-Mercator plane; its latitude limit in degrees.
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_HALF_M = math.pi * 6_378_137.0
MERCATOR_MAX_LAT = 85.05112878


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def degrees(e5: Column | str) -> Column:
    return _col(e5) / 1e5


def to_e5(deg: Column | str) -> Column:
    """Degrees to E5, halves away from zero."""
    return F.round(_col(deg) * 1e5).cast("int")


def decimetres(metres: Column | str) -> Column:
    return F.round(_col(metres) * 10).cast("int")


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle metres between two E5 points."""
    a1, o1, a2, o2 = (F.radians(degrees(x)) for x in (lat1, lon1, lat2, lon2))
    square = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    half = square(a2 - a1) + F.cos(a1) * F.cos(a2) * square(o2 - o1)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def flat_distance_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Equirectangular metres with one cosine, at the mean latitude; for steps between neighbouring fixes."""
    a1, o1, a2, o2 = (F.radians(degrees(x)) for x in (lat1, lon1, lat2, lon2))
    dx = (o2 - o1) * F.cos((a1 + a2) / 2)
    return F.sqrt(dx * dx + (a2 - a1) * (a2 - a1)) * EARTH_RADIUS_M


def fcc_distance_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Kilometres by the formula of FCC rule 73.208, which holds up to 475 km."""
    # Kilometres per degree as a cosine series of the mean latitude (the rule itself prints 0.56605).
    per_lat = ((0, 111.13209), (2, -0.566605), (4, 0.0012))
    per_lon = ((1, 111.41513), (3, -0.09455), (5, 0.00012))
    mid = F.radians((degrees(lat1) + degrees(lat2)) / 2)
    series = lambda terms: sum((F.lit(c) * F.cos(mid * k) if k else F.lit(c) for k, c in terms), F.lit(0.0))
    dy, dx = series(per_lat) * (degrees(lat2) - degrees(lat1)), series(per_lon) * (degrees(lon2) - degrees(lon1))
    return F.sqrt(dx * dx + dy * dy)


def leg_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """A route leg: great-circle metres, rounded."""
    return F.round(haversine_m(lat1, lon1, lat2, lon2)).cast("long")


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Twice the signed area of the triangle o, a, b."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segment_distance_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    along = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
    ex, ey = px - ax - along * dx, py - ay - along * dy
    return F.sqrt(ex * ex + ey * ey)


# --- Web Mercator and tiles -------------------------------------------------------------------------------------------------------


def mercator_x(lon_deg: Column) -> Column:
    """0 to 1 from west to east."""
    return F.greatest(F.least(lon_deg, F.lit(180.0)), F.lit(-180.0)) / 360 + 0.5


def mercator_y(lat_deg: Column) -> Column:
    """0 to 1 from north to south; latitudes beyond the plane's limit lie on it."""
    lat = F.radians(F.greatest(F.least(lat_deg, F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT)))
    return 0.5 - F.asinh(F.tan(lat)) / (2 * math.pi)


def mercator_lon(x: Column) -> Column:
    return (x - 0.5) * 360


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh((0.5 - y) * (2 * math.pi))))


def tile_index(at: Column, zoom: Column, upper: bool = False) -> Column:
    """The tile of a place 0 to 1 along an axis; as the upper end of a range, the last tile that it reaches into. Within the grid."""
    n = F.pow(F.lit(2.0), zoom)
    index = F.ceil(at * n) - 1 if upper else F.floor(at * n)
    return F.greatest(F.lit(0), F.least(index, n - 1)).cast("int")


def parent(tile: Column) -> Column:
    return F.shiftright(tile, 1)
