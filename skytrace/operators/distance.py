"""The free distance, the longest way over five fixes in order, found and proven by bounds over blocks of fixes.

A flight's fixes are cut into blocks, and for each of the five turns a table holds the blocks that may hold it. One relaxation forward and one backward
(each a join of a turn's blocks with the next turn's) give every block the longest way through it that the blocks' boxes allow. Blocks
whose bound is below a way that is known are dropped, the rest cut into SPLIT parts, until blocks are single fixes: what is then longest is longest of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import haversine_m
from skytrace.operators.series import in_order
from skytrace.storage import settled

TURNS = 5
#: Blocks of a flight to begin with, at most; parts that a block is cut into.
FIRST_BLOCKS, SPLIT = 64, 4
#: Kilometres by which rounding may lower a bound.
ROUNDING_KM = 1e-6


def _per_degree(mid: Column) -> tuple[Column, Column]:
    """Kilometres of a degree of latitude and of longitude at a mean latitude in radians."""
    # FCC rule 73.208.
    dy = 111.13209 - 0.566605 * F.cos(2 * mid) + 0.0012 * F.cos(4 * mid)
    dx = 111.41513 * F.cos(mid) - 0.09455 * F.cos(3 * mid) + 0.00012 * F.cos(5 * mid)
    return dy, dx


def fcc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two E5 points by FCC rule 73.208."""
    dy, dx = _per_degree(F.radians((lat1 + lat2) / 2e5))
    return F.hypot(dx * (lon2 - lon1) / 1e5, dy * (lat2 - lat1) / 1e5)


def _most_km(a: str, b: str) -> Column:
    """No two fixes of two blocks are further apart: a degree of longitude is longest nearest the equator, one of latitude farthest."""
    of = lambda side, c: F.col(f"{side}.{c}")
    low, high = F.radians((of(a, "south") + of(b, "south")) / 2e5), F.radians((of(a, "north") + of(b, "north")) / 2e5)
    near, far = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high))), F.greatest(F.abs(low), F.abs(high))
    across = F.greatest(of(a, "east") - of(b, "west"), of(b, "east") - of(a, "west")) / 1e5
    up = F.greatest(of(a, "north") - of(b, "south"), of(b, "north") - of(a, "south")) / 1e5
    return F.hypot(_per_degree(near)[1] * across, _per_degree(far)[0] * up)


def moved(fixes: DataFrame, latest: bool = False) -> DataFrame:
    """(flight_id, idx, i, n, lat, lon): fixes without those that repeat the place before (latest: the place behind), numbered anew."""
    w = in_order()
    here = F.struct("lat_e5", "lon_e5")
    beside = F.lead(here) if latest else F.lag(here)
    own = fixes.select("flight_id", "idx", F.col("lat_e5").cast("double").alias("lat"), F.col("lon_e5").cast("double").alias("lon"), F.coalesce(beside.over(w) == here, F.lit(False)).alias("_same")).where("not _same").drop("_same")
    return own.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("n", F.count("*").over(W.partitionBy("flight_id")))


def _blocks(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """(flight_id, block, box): the bounds of blocks of `size` fixes, with a fix of each."""
    own = places.join(sizes, "flight_id").withColumn("block", F.floor(F.col("i") / F.col("size")))
    box = F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min_by(F.struct("i", "lat", "lon"), "i").alias("one"))
    return own.groupBy("flight_id", "size", "block").agg(box.alias("box"))


def _relaxed(alive: DataFrame, forward: bool) -> DataFrame:
    """alive (flight_id, turn, block, size, box) with `most`, the longest way that the boxes allow up to each turn (or from it on), and
    `known`, the longest over the blocks' own fixes (null where there is none)."""
    order = range(TURNS) if forward else range(TURNS - 1, -1, -1)
    layer, out = None, None
    for turn in order:
        own = alive.where(F.col("turn") == turn)
        if layer is None:
            layer = own.withColumn("most", F.lit(0.0)).withColumn("known", F.lit(0.0))
        else:
            here, there = own.select("flight_id", F.col("block").alias("b"), F.col("box").alias("to")), layer.select("flight_id", "size", F.col("block").alias("a"), F.col("box").alias("from"), "most", "known")
            # Turns may share a block of several fixes, but not a single fix.
            apart = (F.col("a") < F.col("b")) if forward else (F.col("a") > F.col("b"))
            both = there.join(here, "flight_id").where(apart | ((F.col("a") == F.col("b")) & (F.col("size") > 1)))
            single = fcc_km(F.col("from.one.lat"), F.col("from.one.lon"), F.col("to.one.lat"), F.col("to.one.lon"))
            most = F.col("most") + F.when(F.col("size") == 1, single).otherwise(_most_km("from", "to") + ROUNDING_KM)
            known = F.when(apart, F.col("known") + single)
            best = both.groupBy("flight_id", F.col("b").alias("block")).agg(F.max(most).alias("most"), F.max(known).alias("known"))
            layer = own.join(best, ["flight_id", "block"])
        layer = layer.select("flight_id", "turn", "block", "size", "box", "most", "known")
        out = layer if out is None else out.unionByName(layer)
    return out


def _ways(alive: DataFrame, latest: bool) -> DataFrame:
    """(flight_id, way, km): the longest way over single fixes; the first fixes (latest: the last) of equal ways to a turn, the last of equal ends."""
    layer = alive.where("turn = 0").select("flight_id", "box.one", F.lit(0.0).alias("km"), F.array(F.col("box.one.i")).alias("way"))
    for turn in range(1, TURNS):
        here = alive.where(F.col("turn") == turn).select("flight_id", F.col("box.one").alias("to"))
        both = layer.join(here, "flight_id").where(F.col("one.i") < F.col("to.i"))
        km = F.col("km") + fcc_km(F.col("one.lat"), F.col("one.lon"), F.col("to.lat"), F.col("to.lon"))
        best = F.max(F.struct(km.alias("km"), (F.col("one.i") if latest else -F.col("one.i")).alias("_i"), F.concat("way", F.array(F.col("to.i"))).alias("way"))).alias("best")
        layer = both.groupBy("flight_id", "to").agg(best).select("flight_id", F.col("to").alias("one"), "best.km", "best.way")
    return layer.groupBy("flight_id").agg(F.max(F.struct("km", F.element_at("way", -1).alias("_i"), "way")).alias("best")).select("flight_id", "best.way", "best.km").where("km > 0")


def free_distances(fixes: DataFrame, latest: bool = False) -> DataFrame:
    """(flight_id, turns, legs_m, distance_m, optimal) of the free distance of each flight that has one; turns are idx, legs whole metres on
    the sphere, the distance rounded to ten. optimal is always true: whatever was left out is proven to be no longer. Of ways that are equally
    long, as a place comes again, the first fix of a turn is taken, or the last."""
    places = settled(moved(fixes, latest))
    sizes = places.groupBy("flight_id").agg(F.max("n").alias("n")).where(F.col("n") >= TURNS)
    steps = F.ceil(F.greatest(F.log2(F.col("n") / FIRST_BLOCKS), F.lit(0.0)) / 2)  # cuts by four down to a fix
    sizes = settled(sizes.select("flight_id", F.pow(F.lit(float(SPLIT)), steps).cast("long").alias("size")))
    turns = F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn")
    alive = settled(_blocks(places, sizes).select("flight_id", turns, "block", "size", "box"))
    done = alive.where("size = 1")
    todo = alive.where("size > 1")
    while not todo.isEmpty():
        to, on = settled(_relaxed(todo, True)), settled(_relaxed(todo, False))
        known = to.where(F.col("turn") == TURNS - 1).groupBy("flight_id").agg(F.coalesce(F.max("known"), F.lit(0.0)).alias("least"))
        through = to.join(on.select("flight_id", "turn", "block", F.col("most").alias("rest")), ["flight_id", "turn", "block"]).join(known, "flight_id")
        kept = through.where(F.col("most") + F.col("rest") >= F.col("least")).select("flight_id", "turn", "size", "block")
        parts = kept.select("flight_id", "turn", (F.col("size") / SPLIT).cast("long").alias("size"), F.explode(F.sequence(F.col("block") * SPLIT, F.col("block") * SPLIT + SPLIT - 1)).alias("block"))
        finer = kept.select("flight_id", (F.col("size") / SPLIT).cast("long").alias("size")).distinct()
        alive = settled(parts.join(_blocks(places, finer), ["flight_id", "size", "block"]).select("flight_id", "turn", "block", "size", "box"))
        done, todo = done.unionByName(alive.where("size = 1")), alive.where("size > 1")
    found = _ways(done, latest).select("flight_id", F.posexplode("way").alias("turn", "i")).join(places.select("flight_id", "i", "idx", "lat", "lon"), ["flight_id", "i"])
    by_turn = W.partitionBy("flight_id").orderBy("turn")
    leg = F.when(F.col("turn") > 0, F.floor(haversine_m(F.lag("lat").over(by_turn), F.lag("lon").over(by_turn), "lat", "lon") + 0.5).cast("long"))
    listed = found.withColumn("leg", leg).groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("turn", "idx", "leg"))).alias("l"))
    legs = F.filter("l.leg", lambda x: x.isNotNull())
    metres = F.aggregate(legs, F.lit(0).cast("long"), lambda a, x: a + x)
    return listed.select("flight_id", F.col("l.idx").alias("turns"), legs.alias("legs_m"), (F.floor(metres / 10 + 0.5) * 10).cast("long").alias("distance_m"), F.lit(True).alias("optimal"))
