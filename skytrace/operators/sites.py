"""Nearest sites within a radius, by a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.geo import EARTH_RADIUS_M, haversine_m
from skytrace.storage import settled


#: Sites of a cell to aim at; how often a cell's side is halved at most.
CROWD, MOST_HALVINGS = 4, 10


def nearest_site(points: DataFrame, sites: DataFrame, key: str, radius_m: float, site_key: str = "site_id") -> DataFrame:
    """points (lat_e5, lon_e5) with the id and distance of the nearest site within the radius, null where there is none. Ties go to the
    smaller id; sites at one place count once.

    Where sites are crowded, a point looks within a part of the radius first: a site found there is the nearest of all. Only
    points without one look twice as far, up to the radius, so what a point meets doesn't grow with the number of sites.
    """
    places = settled(sites.groupBy("lat_e5", "lon_e5").agg(F.min(site_key).alias("_site")))
    high = math.degrees(radius_m / EARTH_RADIUS_M) * 1e5
    cells = places.groupBy(F.floor(F.col("lat_e5") / high), F.floor(F.col("lon_e5") / high)).count()
    squares, whole = cells.agg(F.sum(F.col("count").cast("double") * F.col("count")), F.sum("count")).first()
    halvings = min(max(math.ceil(math.log(squares / whole / CROWD, 4)), 0), MOST_HALVINGS) if whole else 0
    found, rest = None, points.select(key, "lat_e5", "lon_e5")
    for k in range(halvings, -1, -1):
        near = _within(rest, places, key, radius_m / 2**k, site_key)
        near = settled(near) if k else near
        found = near if found is None else found.unionByName(near)
        rest = settled(rest.join(near.select(key).hint("merge"), key, "left_anti")) if k else rest
    return points.join(found, key, "left")


def _within(points: DataFrame, places: DataFrame, key: str, radius_m: float, site_key: str) -> DataFrame:
    """(key, site_key, distance_m) of the points that have a site within the radius, of which the nearest.

    Sites are dealt to grid cells as high as the radius and, per row of cells, as wide; a point meets the sites of its own and the
    neighbouring cells in an equi-join. Each site is copied three times per row and each point once per
    row, so nothing is compared with all of the other side. Meridian 180 is a border of the grid: cells wrap around it.
    """
    high = math.degrees(radius_m / EARTH_RADIUS_M) * 1e5
    row = lambda lat: F.floor(lat / high).cast("long")
    # The widest a cell must be at the row's end that lies nearer a pole, one row further for the neighbours.
    edge = lambda r: F.least((F.abs(r + 0.5) + 1.5) * high / 1e5, F.lit(89.9))
    columns = lambda r: F.greatest(F.floor(36_000_000 / (high / F.cos(F.radians(edge(r))))), F.lit(1)).cast("long")
    cell = lambda lon, r: F.floor((lon + 18_000_000) / 36_000_000 * columns(r)).cast("long")
    around = places.select("_site", F.col("lat_e5").alias("_lat"), F.col("lon_e5").alias("_lon"), F.explode(F.sequence(row(F.col("lat_e5")) - 1, row(F.col("lat_e5")) + 1)).alias("_row"))
    around = around.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("_lon"), F.col("_row")) + d, columns(F.col("_row")))))))
    placed = points.select(key, "lat_e5", "lon_e5").withColumn("_row", row(F.col("lat_e5"))).withColumn("_cell", F.pmod(cell(F.col("lon_e5"), F.col("_row")), columns(F.col("_row"))))
    distance = haversine_m("lat_e5", "lon_e5", "_lat", "_lon")
    near = placed.join(around, ["_row", "_cell"]).withColumn("_d", distance).where(F.col("_d") <= radius_m)
    return near.groupBy(key).agg(F.min(F.struct("_d", "_site")).alias("_best")).select(key, F.col("_best._site").alias(site_key), F.col("_best._d").alias("distance_m"))
