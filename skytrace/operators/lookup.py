"""Looking fixes up by place, and elevations up by fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import degrees, mercator_x, mercator_y
from skytrace.storage import settled

# Cells along a flight's longer side; fixes of a flight that a point is compared with one by one.
CELLS, WHOLE_FIXES = 200, 256


def _square(a: Column, b: Column) -> Column:
    return (a - b).cast("double") * (a - b)


def nearest_fix(fixes: DataFrame, points: DataFrame, rings: int = 3) -> DataFrame:
    """points (point_id, flight_id, lat_e5, lon_e5) with the idx of the flight's nearest fix, in squared degrees; ties to the smaller. Fixes
    without a place take no part.

    A flight of up to WHOLE_FIXES fixes is one row that its points meet, so each point is sent once. Points of longer flights go by
    a grid (`_by_grid`).
    """
    counted = fixes.where("lat_e5 is not null and lon_e5 is not null").select("flight_id", "idx", F.col("lat_e5").alias("_fa"), F.col("lon_e5").alias("_fo"), F.count("*").over(W.partitionBy("flight_id")).alias("_n"))
    counted = settled(counted)
    few = counted.where(F.col("_n") <= WHOLE_FIXES).groupBy("flight_id").agg(F.collect_list(F.struct("idx", "_fa", "_fo")).alias("_fixes")).hint("merge")
    best = F.array_min(F.transform("_fixes", lambda f: F.struct((_square(F.col("lat_e5"), f["_fa"]) + _square(F.col("lon_e5"), f["_fo"])).alias("d"), f["idx"].alias("idx"))))
    many = counted.where(F.col("_n") > WHOLE_FIXES).drop("_n")
    told = points.join(few, "flight_id", "left").select(*points.columns, best["idx"].alias("idx"))
    if many.isEmpty():
        return told
    flights = many.select("flight_id").distinct()
    return told.join(flights, "flight_id", "left_anti").unionByName(_by_grid(many, points.join(flights, "flight_id", "left_semi"), rings)).select(told.columns)


def _by_grid(fixes: DataFrame, points: DataFrame, rings: int) -> DataFrame:
    """points with the idx of their flight's nearest fix. fixes: (flight_id, idx, _fa, _fo).

    A flight's fixes are dealt to cells that are `rings` of CELLS parts of its longer side wide, and a point meets those of its own cell and
    the eight around it. A fix no further than a cell's width is surely the nearest; points for which there is none are compared
    with all fixes of their flight.
    """
    bounds = fixes.groupBy("flight_id").agg(F.min("_fa").alias("_a"), F.min("_fo").alias("_o"), F.greatest(F.max("_fa") - F.min("_fa"), F.max("_fo") - F.min("_fo"), F.lit(1)).alias("_span"))
    bounds = settled(bounds.withColumn("_size", F.col("_span") / CELLS * rings))
    cell = lambda v, low: F.floor((F.col(v) - F.col(low)) / F.col("_size")).cast("long")
    placed = settled(fixes.join(bounds, "flight_id").select("flight_id", "idx", "_fa", "_fo", cell("_fa", "_a").alias("_y"), cell("_fo", "_o").alias("_x")))
    own = settled(points.join(bounds, "flight_id").withColumn("_py", cell("lat_e5", "_a")).withColumn("_px", cell("lon_e5", "_o")))
    around = own.withColumn("_y", F.explode(F.sequence(F.col("_py") - 1, F.col("_py") + 1))).withColumn("_x", F.explode(F.sequence(F.col("_px") - 1, F.col("_px") + 1)))
    best = F.min(F.struct((_square(F.col("lat_e5"), F.col("_fa")) + _square(F.col("lon_e5"), F.col("_fo"))).alias("d"), "idx")).alias("_best")
    near = around.join(placed, ["flight_id", "_y", "_x"]).groupBy("point_id").agg(best)
    sure = settled(own.join(near, "point_id", "left").withColumn("_sure", F.coalesce(F.sqrt("_best.d") <= F.col("_size"), F.lit(False))))
    rest = sure.where(~F.col("_sure")).select(points.columns).join(placed, "flight_id").groupBy("point_id").agg(best)
    rest = rest.select("point_id", F.col("_best.idx").alias("_rest"))
    found = F.when(F.col("_sure"), F.col("_best.idx")).otherwise(F.col("_rest"))
    return sure.join(rest, "point_id", "left").select(*points.columns, found.alias("idx"))


def ground_elevation(fixes: DataFrame, tiles: DataFrame, zoom: int, side: int) -> DataFrame:
    """fixes with elevation_m: the pixel that each lies in, null without a tile. tiles: (z, x, y, px), px the values row by row; they are
    met in an equi-join on the tile, of which the pixel is taken by its place."""
    across, down = mercator_x(degrees("lon_e5")) * (side << zoom), mercator_y(degrees("lat_e5")) * (side << zoom)
    whole = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit((side << zoom) - 1)).cast("long")
    at = fixes.withColumn("_gx", whole(across)).withColumn("_gy", whole(down))
    at = at.withColumn("_x", F.floor(F.col("_gx") / side)).withColumn("_y", F.floor(F.col("_gy") / side))
    there = tiles.where(F.col("z") == zoom).select(F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), F.col("px").alias("_px"))
    value = F.get("_px", ((F.col("_gy") % side) * side + F.col("_gx") % side).cast("int"))
    return at.join(there, ["_x", "_y"], "left").withColumn("elevation_m", value).drop("_gx", "_gy", "_x", "_y", "_px")
