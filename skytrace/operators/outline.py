"""Simplification and hulls, level by level: all stretches of all flights that are still open are halved at once.

A point carries the ends of the stretch it lies in, so a level is one window over stretches; LEVELS of them are put together before
what is left is kept. The points of a flight stay in one partition, so levels need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import EARTH_RADIUS_M, degrees
from skytrace.operators.series import in_order
from skytrace.storage import settled

LEVELS = 4


def on_plane(fixes: DataFrame) -> DataFrame:
    """fixes with x and y: metres on a plane around the flight's mean, each fix with its own cosine. The mean sums in order of idx, so that
    reruns agree to the last bit, by which equally small rectangles are told apart."""
    flight = in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lat, lon = F.radians(degrees("lat_e5")), F.radians(degrees("lon_e5"))
    return fixes.withColumn("x", F.lit(EARTH_RADIUS_M) * (lon - F.avg(lon).over(flight)) * F.cos(lat)).withColumn("y", F.lit(EARTH_RADIUS_M) * (lat - F.avg(lat).over(flight)))


def _levels(points: DataFrame, halved: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The points that `halved` ever picks. Points have `open` and `picked`; a level picks some of the open ones and closes others."""
    picked, todo = None, points
    while True:
        for _ in range(LEVELS):
            todo = halved(todo)
        todo = settled(todo.where(F.col("open") | F.col("picked")))
        some = todo.where("picked")
        picked = some if picked is None else picked.unionByName(some)
        todo = todo.where("open")
        if todo.isEmpty():
            return picked


def simplified(fixes: DataFrame, tolerance_m: float, chord_m: float | None = None) -> DataFrame:
    """(flight_id, idx) of the fixes that a Ramer-Douglas-Peucker simplification keeps, with a chord cap: a stretch whose fixes are all
    within tolerance_m of its chord is still halved by index where the chord is longer than chord_m. Of equally far fixes the first."""
    own = on_plane(fixes.select("flight_id", "idx", "lat_e5", "lon_e5")).withColumn("i", (F.row_number().over(in_order()) - 1).cast("long"))
    flight = W.partitionBy("flight_id")
    ends = own.withColumn("_b", F.max(F.struct("i", "x", "y")).over(flight)).withColumn("_a", F.min(F.struct("i", "x", "y")).over(flight))
    is_end = (F.col("i") == 0) | (F.col("i") == F.col("_b.i"))
    points = ends.select("flight_id", "idx", "i", "x", "y", F.col("_a").alias("a"), F.col("_b").alias("b"), (~is_end).alias("open"), is_end.alias("picked"))
    points = settled(points)

    def halved(rows: DataFrame) -> DataFrame:
        stretch = W.partitionBy("flight_id", F.col("a.i"), "open")
        dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        rx, ry, long = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y"), dx * dx + dy * dy
        along = F.when(long > 0, F.least(F.greatest((rx * dx + ry * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        off = (rx - along * dx) * (rx - along * dx) + (ry - along * dy) * (ry - along * dy)
        far = F.max(F.struct(off.alias("off"), (-F.col("i")).alias("_i"), F.struct("i", "x", "y").alias("p"))).over(stretch)
        middle = F.max(F.when(F.col("i") == F.floor((F.col("a.i") + F.col("b.i")) / 2), F.struct("i", "x", "y"))).over(stretch)
        rows = rows.withColumn("_far", F.when(F.col("open"), far)).withColumn("_mid", F.when(F.col("open"), middle))
        at = F.when(F.col("_far.off") > tolerance_m**2, F.col("_far.p"))
        at = at if chord_m is None else at.when(long > chord_m**2, F.col("_mid"))
        rows = rows.withColumn("_at", F.when(F.col("open"), at))
        before, behind = F.col("i") < F.col("_at.i"), F.col("i") > F.col("_at.i")
        return rows.select("flight_id", "idx", "i", "x", "y", F.when(F.col("open") & behind, F.col("_at")).otherwise(F.col("a")).alias("a"), F.when(F.col("open") & before, F.col("_at")).otherwise(F.col("b")).alias("b"), F.coalesce(F.col("open") & (before | behind), F.lit(False)).alias("open"), (F.col("picked") | F.coalesce(F.col("i") == F.col("_at.i"), F.lit(False))).alias("picked"))

    return _levels(points, halved).select("flight_id", "idx")


def hull_corners(points: DataFrame) -> DataFrame:
    """(flight_id, x, y): corners of the convex hull of each flight's points (flight_id, x, y), by quickhull: beyond each side of what is
    known of it, the farthest point is a corner, and what lies within is dropped."""
    flight = W.partitionBy("flight_id")
    own = points.select("flight_id", "x", "y").distinct().withColumn("a", F.min(F.struct("x", "y")).over(flight)).withColumn("b", F.max(F.struct("x", "y")).over(flight))
    here = F.struct("x", "y")
    left = lambda a, b: (F.col(f"{b}.x") - F.col(f"{a}.x")) * (F.col("y") - F.col(f"{a}.y")) - (F.col(f"{b}.y") - F.col(f"{a}.y")) * (F.col("x") - F.col(f"{a}.x"))
    is_end = (here == F.col("a")) | (here == F.col("b"))
    side = left("a", "b")
    start = own.select("flight_id", "x", "y", F.when(side > 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(side > 0, F.col("b")).otherwise(F.col("a")).alias("b"), (~is_end & (side != 0)).alias("open"), is_end.alias("picked"))
    start = settled(start)

    def halved(rows: DataFrame) -> DataFrame:
        far = F.max(F.struct(left("a", "b").alias("off"), "x", "y")).over(W.partitionBy("flight_id", "a", "b", "open"))
        rows = rows.withColumn("f", F.when(F.col("open"), far))
        hit = F.coalesce((F.col("x") == F.col("f.x")) & (F.col("y") == F.col("f.y")), F.lit(False))
        rows = rows.withColumn("_hit", hit).withColumn("_one", left("a", "f") > 0).withColumn("_two", left("f", "b") > 0)
        beyond = F.col("open") & ~F.col("_hit") & (F.col("_one") | F.col("_two"))
        corner = F.struct(F.col("f.x").alias("x"), F.col("f.y").alias("y"))
        return rows.select("flight_id", "x", "y", F.when(F.col("open") & F.col("_two") & ~F.col("_one"), corner).otherwise(F.col("a")).alias("a"), F.when(F.col("open") & F.col("_one"), corner).otherwise(F.col("b")).alias("b"), F.coalesce(beyond, F.lit(False)).alias("open"), (F.col("picked") | F.col("_hit")).alias("picked"))

    return _levels(start, halved).select("flight_id", "x", "y")


def aspect_ratios(fixes: DataFrame, tolerance_m: float = 100.0) -> DataFrame:
    """(flight_id, aspect_ratio): sides' ratio of the smallest rectangle, at any angle, around each track simplified to tolerance_m; infinity
    for a line, null for a point or less than three fixes."""
    own = settled(on_plane(fixes.select("flight_id", "idx", "lat_e5", "lon_e5")).withColumn("_n", F.count("*").over(W.partitionBy("flight_id"))))
    some = own.where("_n > 2").drop("_n")
    corners = settled(hull_corners(some.join(simplified(some, tolerance_m), ["flight_id", "idx"])))
    flight = W.partitionBy("flight_id")
    # Around a point within, corners go by their angle.
    turned = corners.withColumn("_angle", F.atan2(F.col("y") - F.avg("y").over(flight), F.col("x") - F.avg("x").over(flight)))
    ring = W.partitionBy("flight_id").orderBy("_angle")
    there = F.coalesce(F.lead(F.struct("x", "y")).over(ring), F.first(F.struct("x", "y")).over(ring))
    sides = turned.withColumn("_to", there).select("flight_id", "_angle", (F.col("_to.x") - F.col("x")).alias("dx"), (F.col("_to.y") - F.col("y")).alias("dy")).where("dx != 0 or dy != 0")
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    # Two rectangles on one diagonal of the hull are equally large: rounding tells which is taken, so the division comes last, as in the SQL.
    along, across = F.col("x") * F.col("dx") + F.col("y") * F.col("dy"), F.col("y") * F.col("dx") - F.col("x") * F.col("dy")
    boxes = sides.join(corners, "flight_id").groupBy("flight_id", "_angle", size.alias("_size")).agg((F.max(along) - F.min(along)).alias("w"), (F.max(across) - F.min(across)).alias("h"))
    boxes = boxes.withColumn("w", F.col("w") / F.col("_size")).withColumn("h", F.col("h") / F.col("_size"))
    least, most = F.least("w", "h"), F.greatest("w", "h")
    ratio = F.when(least <= most * 1e-9, F.lit(float("inf"))).otherwise(most / least)
    best = boxes.groupBy("flight_id").agg(F.min_by(ratio, F.struct(F.col("w") * F.col("h"), "_angle")).alias("aspect_ratio"))
    return own.select("flight_id").distinct().join(best, "flight_id", "left")
