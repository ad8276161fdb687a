"""The best triangle of each flight, by branch and bound over a frontier table.

A triangle is three fixes in order; its gap is the distance of the closest fixes up to the first and from the last on; what counts is its perimeter
less the gap. The frontier holds triples of blocks of fixes with a bound on what a triangle over them can be worth. Each level
halves the blocks, reckons bounds by joins with the blocks' boxes, and drops triples below a triangle that is known, until blocks are single
fixes. Pairs of blocks that may hold the closest fixes are halved beside them. Nothing is given up, so what is left is the best of all.
A flight of no more than WHOLE_FIXES fixes is a single block: its triples are compared at once where its row is, without a frontier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import EARTH_RADIUS_M
from skytrace.operators.series import in_order
from skytrace.storage import settled

# Largest gap of an open and of a closed triangle, as shares of the perimeter; least side of an FAI triangle as a share, and
# in km.
GAPS = {"olc_open": 0.2, "olc_closed": 0.05}
FAI_SIDE, FAI_SIDE_KM = 0.28, 1.4
SIDES = {"free_triangle": (0.0, 0.0), "fai_triangle": (FAI_SIDE, FAI_SIDE_KM)}
#: Blocks of a flight to begin with, at most; kilometres by which rounding may move a bound.
FIRST_BLOCKS, ROUNDING_KM = 24, 1e-6
#: Fixes of a flight whose triples (350,000 at most) are all compared; bounds over so few fixes drop too little to pay for their rows.
WHOLE_FIXES = 128


def _half_chord_km(dlat: Column, dlon: Column, cosines: Column) -> Column:
    """Kilometres over differences in radians and the product of the latitudes' cosines."""
    half = F.sin(dlat / 2) * F.sin(dlat / 2) + cosines * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * EARTH_RADIUS_M / 1000)


def _km(p: Column, q: Column) -> Column:
    """Kilometres between two places (lat, lon, cos), in radians."""
    return _half_chord_km(q["lat"] - p["lat"], q["lon"] - p["lon"], p["cos"] * q["cos"])


def _most_km(p: Column, q: Column) -> Column:
    """No two fixes of two boxes are further apart."""
    up = F.greatest(p["north"] - q["south"], q["north"] - p["south"])
    across = F.least(F.greatest(p["east"] - q["west"], q["east"] - p["west"]), F.lit(3.141592653589793))
    return _half_chord_km(up, across, p["wide"] * q["wide"])


def _least_km(p: Column, q: Column) -> Column:
    """No two fixes of two boxes are closer."""
    apart = lambda a, b, c, d: F.greatest(a - b, c - d, F.lit(0.0))
    up, across = apart(p["south"], q["north"], q["south"], p["north"]), apart(p["west"], q["east"], q["west"], p["east"])
    return _half_chord_km(up, across, p["narrow"] * q["narrow"])


def _places(fixes: DataFrame) -> DataFrame:
    """(flight_id, idx, i, n, lat, lon, cos): fixes numbered from 0, in radians."""
    lat, lon = F.radians(F.col("lat_e5") / 1e5), F.radians(F.col("lon_e5") / 1e5)
    own = fixes.where("lat_e5 is not null and lon_e5 is not null")
    own = own.select("flight_id", "idx", lat.alias("lat"), lon.alias("lon"), F.cos(lat).alias("cos"), (F.row_number().over(in_order()) - 1).cast("long").alias("i"))
    return own.withColumn("n", F.count("*").over(W.partitionBy("flight_id"))).where("n > 2")


def _boxes(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """(flight_id, block, box): bounds of the blocks of each flight's size, with the first and the last fix of each."""
    own = places.join(_dealt(sizes), "flight_id").withColumn("block", F.floor(F.col("i") / F.col("size")))
    one = F.struct("i", "lat", "lon", "cos")
    box = F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("cos").alias("narrow"), F.max("cos").alias("wide"), F.min(one).alias("first"), F.max(one).alias("last"))
    # The equator is wider than either end of a box across it.
    made = own.groupBy("flight_id", "block").agg(box.alias("box"))
    return made.withColumn("box", F.when((F.col("box.south") < 0) & (F.col("box.north") > 0), F.col("box").withField("wide", F.lit(1.0))).otherwise(F.col("box")))


def _dealt(df: DataFrame) -> DataFrame:
    """df, never broadcast: tables of the search grow with the flights, and take far more memory than their files."""
    return df.hint("merge")


def _of(boxes: DataFrame, block: str) -> DataFrame:
    return _dealt(boxes.select("flight_id", F.col("block").alias(block), F.col("box").alias("_" + block)))


def _near(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """pairs (flight_id, q, w, cap) that may hold the closest fixes of some triangle, with `close` (a bound on their distance, q, w) and
    `shown`, the distance of the first fix of q from the last of w. cap is what earlier or later blocks are known to reach for every triangle that could use the pair."""
    both = pairs.join(_of(boxes, "q"), ["flight_id", "q"]).join(_of(boxes, "w"), ["flight_id", "w"])
    both = both.select("flight_id", "q", "w", "cap", F.struct(_least_km(F.col("_q"), F.col("_w")).alias("km"), F.col("_q.first.i").alias("q"), F.col("_w.last.i").alias("w")).alias("close"), _km(F.col("_q.first"), F.col("_w.last")).alias("shown"))
    so_far = F.min("shown").over(W.partitionBy("flight_id", "w").orderBy("q").rowsBetween(W.unboundedPreceding, 0))
    reach = F.min("_so").over(W.partitionBy("flight_id", "q").orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("_so", so_far).withColumn("cap", F.least("cap", reach))
    return both.where(F.col("close.km") <= F.col("cap") + ROUNDING_KM).drop("_so")


def _gaps(near: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (flight_id, a, c) with `close`, the least of near pairs with q up to a and w from c on, and `shown`, the least that is shown."""
    upto = near.join(_dealt(asked.select("flight_id", "a").distinct()), "flight_id").where(F.col("q") <= F.col("a"))
    upto = upto.groupBy("flight_id", "a", F.col("w").alias("c")).agg(F.min("close").alias("close"), F.min("shown").alias("shown"))
    rows = upto.withColumn("asks", F.lit(False)).unionByName(asked.select("flight_id", "a", "c").withColumn("asks", F.lit(True)), allowMissingColumns=True)
    on = W.partitionBy("flight_id", "a").orderBy(F.desc("c"), "asks").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("close", F.min("close").over(on)).withColumn("shown", F.min("shown").over(on)).where("asks").select("flight_id", "a", "c", "close", "shown")


_SEARCH = ["flight_id", "type", "sub_type"]


def _legs(triples: DataFrame, boxes: DataFrame) -> DataFrame:
    """(flight_id, x, y, leg) of every two blocks that are corners of a triple: no two of their fixes are further apart than leg.most; leg.ff and
    leg.fl are the distances of the first fix of x from the first and the last of y, null where these don't come in this order."""
    two = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = triples.select("flight_id", F.explode(F.array(two("a", "b"), two("b", "c"), two("a", "c"))).alias("p")).select("flight_id", "p.*").distinct()
    both = pairs.join(_of(boxes, "x"), ["flight_id", "x"]).join(_of(boxes, "y"), ["flight_id", "y"])
    real = lambda end: F.when(F.col("_x.first.i") < F.col(f"_y.{end}.i"), _km(F.col("_x.first"), F.col(f"_y.{end}")))
    return both.select("flight_id", "x", "y", F.struct(_most_km(F.col("_x"), F.col("_y")).alias("most"), real("first").alias("ff"), real("last").alias("fl")).alias("leg"))


def _bounded(triples: DataFrame, gaps: DataFrame, boxes: DataFrame) -> DataFrame:
    """triples with `bound`, what a triangle over them is worth at most, and `worth`, that over the first fixes of a and b and the last of c,
    null where it isn't valid."""
    legs = settled(_legs(triples, boxes))
    of = lambda x, y: _dealt(legs.select("flight_id", F.col("x").alias(x), F.col("y").alias(y), F.col("leg").alias(x + y)))
    own = triples.join(_dealt(of("a", "c").join(_dealt(gaps), ["flight_id", "a", "c"])), ["flight_id", "a", "c"]).join(of("a", "b"), ["flight_id", "a", "b"]).join(of("b", "c"), ["flight_id", "b", "c"])
    most = [F.col("ab.most"), F.col("bc.most"), F.col("ac.most")]
    # From the first fix of a by the first of b to the last of c; null unless they come in this order.
    real = [F.col("ab.ff"), F.col("bc.fl"), F.col("ac.fl")]
    own = own.withColumns({"_most": most[0] + most[1] + most[2], "_least": F.least(*most), "_real": real[0] + real[1] + real[2], "_side": F.least(*real)})
    total = F.when(F.col("side") > 0, F.least(F.col("_most"), F.col("_least") / F.col("side"))).otherwise(F.col("_most")) + ROUNDING_KM
    fits = (F.col("close.km") <= F.col("most_gap") * total + ROUNDING_KM) & (F.col("_least") >= F.col("side_km") - ROUNDING_KM)
    valid = F.col("_real").isNotNull() & (F.col("shown") <= F.col("most_gap") * F.col("_real")) & (F.col("_side") >= F.col("side") * F.col("_real")) & (F.col("_side") >= F.col("side_km"))
    own = own.withColumn("bound", total - F.col("close.km")).withColumn("worth", F.when(valid, F.col("_real") - F.col("shown"))).where(fits)
    return own.select(*_SEARCH, "most_gap", "side", "side_km", "size", "a", "b", "c", "known", "bound", "worth", "close", F.col("_real").alias("perimeter_km"))


def _best_triples(lat: np.ndarray, lon: np.ndarray, searches: list[dict]) -> list[tuple | None]:
    """The best (worth, turns, gap_ends, perimeter_km, gap_km) of each search over all triples of a few fixes, None where none is valid; of equals
    the last second turn, then the first other turns and ends. lat, lon in radians."""
    half = np.sin((lat - lat[:, None]) / 2) ** 2 + np.cos(lat) * np.cos(lat)[:, None] * np.sin((lon - lon[:, None]) / 2) ** 2
    km = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(half, 1.0))) / 1000
    # At (a, c): the least distance of a fix up to a from one from c on.
    near = np.minimum.accumulate(np.minimum.accumulate(km[:, ::-1], axis=1)[:, ::-1], axis=0)
    best = [(0.0, 0, 0, 0)] * len(searches)
    for b in range(1, len(lat) - 1):
        ab, bc, ac, gap = km[:b, b, None], km[b, b + 1 :], km[:b, b + 1 :], near[:b, b + 1 :]
        total = ab + bc + ac
        worth = total - gap
        most, least = worth.max(), np.minimum(np.minimum(ab, bc), ac)
        for k, s in enumerate(searches):
            if most >= best[k][0]:
                valid = (gap <= s["most_gap"] * total) & (least >= s["side"] * total) & (least >= s["side_km"])
                own = np.where(valid, worth, 0.0)
                a, c = divmod(int(own.argmax()), own.shape[1])
                best[k] = max(best[k], (float(own[a, c]), b, -a, -(b + 1 + c)))
    out = []
    for worth, b, *ends in best:
        a, c = (-x for x in ends)
        if worth > 0:
            q, w = divmod(int(km[: a + 1, c:].argmin()), len(lat) - c)
            out.append((worth, [a, b, c], [q, c + w], float(km[a, b] + km[b, c] + km[a, c]), float(km[q, c + w])))
        else:
            out.append(None)
    return out


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, own = [], batch.column("fixes")
        for k, searches in enumerate(batch.column("searches").to_pylist()):
            idx, lat, lon = (own[k].values.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "lat", "lon"))
            for s, found in zip(searches, _best_triples(lat, lon, searches)):
                if found is not None:
                    rows.append((k, s["type"], s["sub_type"], idx[found[1]].tolist(), idx[found[2]].tolist(), *found[3:]))
        of = lambda c, kind: pa.array([r[c] for r in rows], kind)  # noqa: E731, B023
        columns = [batch.column("flight_id").take(of(0, pa.int64())), of(1, pa.string()), of(2, pa.string()), of(3, pa.list_(pa.int64())), of(4, pa.list_(pa.int64())), of(5, pa.float64()), of(6, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*_SEARCH, "turns", "gap_ends", "perimeter_km", "gap_km"])


def _at_once(places: DataFrame, searches: DataFrame) -> DataFrame:
    """The best triangles of flights of up to WHOLE_FIXES fixes: a row per flight, dealt to as many tasks as the session shuffles to, as
    the work is not in the bytes."""
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = places.repartition(tasks, "flight_id").groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("idx").cast("long").alias("idx"), "lat", "lon"))).alias("fixes"))
    asked = searches.groupBy("flight_id").agg(F.collect_list(F.struct("type", "sub_type", "most_gap", "side", "side_km")).alias("searches"))
    flight = places.select("flight_id").schema[0].dataType.simpleString()
    return told.join(_dealt(asked), "flight_id").mapInArrow(_of_rows, f"flight_id {flight}, type string, sub_type string, turns array<long>, gap_ends array<long>, perimeter_km double, gap_km double")


def best_triangles(fixes: DataFrame, gaps: dict[str, float] = GAPS, sides: dict[str, tuple[float, float]] = SIDES, searches: DataFrame | None = None) -> DataFrame:
    """(flight_id, type, sub_type, turns, gap_ends, perimeter_km, gap_km): the best triangle of each flight, shape and gap; turns and
    gap_ends are idx; of equals the one of the last second turn, then of the first others. gaps: the largest gap as a share of the perimeter;
    sides: the least side of each shape as a share of the perimeter and in km. searches, if given, says what to look for in which flight:
    (flight_id, type, sub_type, most_gap, side, side_km). Flights without a valid triangle have no row."""
    places = settled(_places(fixes if searches is None else fixes.join(_dealt(searches.select("flight_id").distinct()), "flight_id", "left_semi")))
    if searches is None:
        each = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("sub_type"), F.lit(float(g)).alias("most_gap"), F.lit(float(share)).alias("side"), F.lit(float(km)).alias("side_km")) for t, (share, km) in sides.items() for s, g in gaps.items()])
        searches = places.where("i = 0").select("flight_id", F.explode(each).alias("s")).select("flight_id", "s.*")
    found, more = _at_once(places.where(F.col("n") <= WHOLE_FIXES), searches), places.where(F.col("n") > WHOLE_FIXES)
    return found if more.isEmpty() else found.unionByName(_by_blocks(more, searches))


def _by_blocks(places: DataFrame, searches: DataFrame) -> DataFrame:
    """The best triangles of longer flights, by branch and bound."""
    halvings = F.ceil(F.greatest(F.log2(F.col("n") / FIRST_BLOCKS), F.lit(0.0)))
    sizes = settled(places.groupBy("flight_id").agg(F.max("n").alias("n")).select("flight_id", "n", F.pow(F.lit(2.0), halvings).cast("long").alias("size")))
    block = lambda low: F.explode(F.sequence(low, F.floor((F.col("n") - 1) / F.col("size"))))
    pairs = sizes.withColumn("q", block(F.lit(0).cast("long"))).withColumn("w", block(F.col("q"))).select("flight_id", "q", "w", F.lit(float("inf")).alias("cap"))
    triples = sizes.withColumn("a", block(F.lit(0).cast("long"))).withColumn("b", block(F.col("a"))).withColumn("c", block(F.col("b"))).where("size > 1 or (a < b and b < c)")
    triples = triples.join(_dealt(searches), "flight_id").select(*_SEARCH, "most_gap", "side", "side_km", "size", "a", "b", "c", F.lit(0.0).alias("known"))
    done = None
    while True:
        boxes = settled(_boxes(places, sizes.select("flight_id", "size")))
        near = settled(_near(pairs, boxes))
        triples = settled(triples)
        gap = _gaps(near, triples.select("flight_id", "a", "c").distinct())
        found = settled(_bounded(triples, gap, boxes))
        known = found.groupBy(*_SEARCH).agg(F.greatest(F.max("known"), F.coalesce(F.max("worth"), F.lit(0.0))).alias("known"))
        ended = found.where((F.col("size") == 1) & F.col("worth").isNotNull())
        done = ended if done is None else done.unionByName(ended)
        alive = settled(found.where("size > 1").drop("known").join(_dealt(known), _SEARCH).where(F.col("bound") >= F.col("known") - ROUNDING_KM))
        if alive.isEmpty():
            break
        halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        cut = alive.select(*_SEARCH, "most_gap", "side", "side_km", (F.col("size") / 2).cast("long").alias("size"), "a", "b", "c", "known")
        rest = lambda df, c: df.select(*[x for x in df.columns if x != c], halves(c))
        triples = rest(rest(rest(cut, "a"), "b"), "c").where("(a < b and b < c) or (size > 1 and a <= b and b <= c)")
        sizes = cut.groupBy("flight_id").agg(F.first("size").alias("size"), (F.max("a") * 2 + 1).alias("last_a"), (F.min("c") * 2).alias("first_c"))
        pairs = rest(rest(near.select("flight_id", "q", "w", "cap").join(_dealt(sizes), "flight_id"), "q"), "w").where("q <= w and q <= last_a and w >= first_c").select("flight_id", "q", "w", "cap")
    best = done.groupBy(*_SEARCH).agg(F.max(F.struct("worth", "b", (-F.col("a")).alias("_a"), (-F.col("c")).alias("_c"), "close", "perimeter_km")).alias("t"))
    ends = F.array(-F.col("t._a"), F.col("t.b"), -F.col("t._c"), F.col("t.close.q"), F.col("t.close.w"))
    told = best.where("t.worth > 0").select(*_SEARCH, F.posexplode(ends).alias("k", "i"), F.col("t.perimeter_km").alias("perimeter_km"), F.col("t.close.km").alias("gap_km"))
    named = told.join(_dealt(places.select("flight_id", "i", "idx")), ["flight_id", "i"]).groupBy(*_SEARCH, "perimeter_km", "gap_km").agg(F.sort_array(F.collect_list(F.struct("k", "idx")))["idx"].alias("idx"))
    return named.select(*_SEARCH, F.slice("idx", 1, 3).alias("turns"), F.slice("idx", 4, 2).alias("gap_ends"), "perimeter_km", "gap_km")
