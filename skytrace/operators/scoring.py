"""Routes of flights as they score: the free distance, and of each kind of triangle the better of the open and the closed one.

A kind is searched only where it can matter: the best triangle with a wider gap (a probe) must be long enough beside the free distance.
Probes and searches are rows of one table, so all flights and kinds go through the frontier together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import haversine_m
from skytrace.operators.distance import free_distances
from skytrace.operators.outline import aspect_ratios
from skytrace.operators.triangles import FAI_SIDE, FAI_SIDE_KM, GAPS, best_triangles
from skytrace.storage import settled

# Largest gap of a probe as a share of the perimeter; factors of each kind; what makes each kind worth a search, in
# metres, as an aspect ratio and as shares of the free distance.
PROBE_GAP = 0.25
FACTORS = {("fai_triangle", "olc_open"): 1.4, ("fai_triangle", "olc_closed"): 1.6, ("free_triangle", "olc_open"): 1.2, ("free_triangle", "olc_closed"): 1.4}
FAI_LEAST_FD_M, FAI_MOST_ASPECT, FAI_LEAST_M, FAI_TO_FD = 5_000, 7.0, 10_000, 0.25
FREE_PROBE_TO_FD, FREE_TO_FD = 0.5, 0.25


def _measured(found: DataFrame, fixes: DataFrame) -> DataFrame:
    """found with legs_m, gap_m and distance_m: whole metres between the turns and between the ends of the gap, and the legs' sum less the gap."""
    key = ["flight_id", "type", "sub_type"]
    at = found.select(*key, F.posexplode(F.concat("turns", "gap_ends")).alias("k", "idx")).join(fixes.select("flight_id", "idx", "lat_e5", "lon_e5"), ["flight_id", "idx"])
    there = at.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "lat_e5", "lon_e5"))).alias("p"))
    metres = lambda a, b: F.floor(haversine_m(F.col("p")[a]["lat_e5"], F.col("p")[a]["lon_e5"], F.col("p")[b]["lat_e5"], F.col("p")[b]["lon_e5"]) + 0.5).cast("long")
    told = there.select(*key, F.array(metres(0, 1), metres(1, 2), metres(2, 0)).alias("legs_m"), metres(3, 4).alias("gap_m"))
    whole = F.col("legs_m")[0] + F.col("legs_m")[1] + F.col("legs_m")[2]
    return found.join(told, key).withColumn("distance_m", F.greatest(whole - F.col("gap_m"), F.lit(0).cast("long")))


def _search(kind: str, sub_type: str, gap: float, side: float, side_km: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(sub_type).alias("sub_type"), F.lit(gap).alias("most_gap"), F.lit(side).alias("side"), side_km.cast("double").alias("side_km"))


def scored_routes(fixes: DataFrame) -> DataFrame:
    """(flight_id, type, sub_type, turns, legs_m, distance_m, gap_m, gap_ends, factor, score, optimal): a row per flight and route; turns and
    gap_ends are idx. Without a free distance a flight has no route. Every search goes to its end, so optimal is always true."""
    distance = settled(free_distances(fixes))
    own = settled(fixes.select("flight_id", "idx", "lat_e5", "lon_e5").join(distance, "flight_id", "left_semi"))
    about = settled(distance.select("flight_id", F.col("distance_m").alias("fd")).join(aspect_ratios(own), "flight_id", "left"))
    fd, free, fai = F.col("fd"), "free_triangle", "fai_triangle"
    narrow = (fd < FAI_LEAST_FD_M) | F.coalesce(F.col("aspect_ratio") >= FAI_MOST_ASPECT, F.lit(False))
    probes = about.select("flight_id", F.explode(F.array_compact(F.array(_search(free, "probe", PROBE_GAP, 0.0, F.lit(0.0)), F.when(~narrow, _search(fai, "probe", PROBE_GAP, FAI_SIDE, F.lit(FAI_SIDE_KM)))))).alias("s")).select("flight_id", "s.*")
    probed = _measured(best_triangles(own, searches=settled(probes)), own).join(about, "flight_id")
    worth = F.when(F.col("type") == free, F.col("distance_m") >= FREE_PROBE_TO_FD * fd).otherwise(F.col("distance_m") >= F.greatest(F.lit(float(FAI_LEAST_M)), FAI_TO_FD * fd))
    wanted = probed.where(worth).select("flight_id", "type", "fd")
    side_km = F.greatest(F.lit(FAI_SIDE_KM), fd / 1000 * FAI_TO_FD * FAI_SIDE)
    both = F.array(*[_search(free, sub, gap, 0.0, F.lit(0.0)) for sub, gap in GAPS.items()]), F.array(*[_search(fai, sub, gap, FAI_SIDE, side_km) for sub, gap in GAPS.items()])
    searches = wanted.select("flight_id", F.explode(F.when(F.col("type") == free, both[0]).otherwise(both[1])).alias("s")).select("flight_id", "s.*")
    found = _measured(best_triangles(own, searches=settled(searches)), own).join(about, "flight_id")
    # A free triangle whose open form is short beside the free distance doesn't count in either form.
    of_kind = W.partitionBy("flight_id", "type")
    short = F.max(F.when(F.col("sub_type") == "olc_open", F.col("distance_m"))).over(of_kind) < FREE_TO_FD * fd
    factor = F.element_at(F.create_map(*[F.lit(x) for (t, s), v in FACTORS.items() for x in (f"{t} {s}", v)]), F.concat_ws(" ", "type", "sub_type"))
    found = found.withColumn("_short", F.coalesce(short, F.lit(True)) & (F.col("type") == free)).withColumn("factor", factor).withColumn("score", F.col("distance_m") / 1000 * F.col("factor"))
    # The better form, the open one of equals.
    best = F.row_number().over(of_kind.orderBy(F.desc("score"), F.desc("sub_type")))
    names = ["flight_id", "type", "sub_type", "turns", "legs_m", "distance_m", "gap_m", "gap_ends", "factor", "score"]
    triangles = found.where("not _short").withColumn("_rank", best).where("_rank = 1").select(names)
    none = {"type": F.lit("free_distance"), "sub_type": F.lit("none"), "gap_m": F.lit(None).cast("long"), "gap_ends": F.lit(None).cast("array<long>"), "factor": F.lit(1.0), "score": F.col("distance_m") / 1000}
    return distance.withColumns(none).select(names).unionByName(triangles).withColumn("optimal", F.lit(True))
