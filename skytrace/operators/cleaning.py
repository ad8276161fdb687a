"""Cleaning of fixes: what depends on neighbours by rank or value is a window; what depends on decisions about earlier fixes (the
filter that anchors on the last fix it kept) follows pointers, whose number of hops doubles from join to join.

A flight_id may be of any type that Spark can compare, a struct of a flight and one of its candidates among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import flat_distance_m
from skytrace.operators.detection import flight_windows
from skytrace.operators.series import in_order
from skytrace.storage import settled

# Speed that no fix can exceed, in m/s; a gap that ends a track; how long a backward run is a slip; most pieces of a
# shifted track.
MOST_MPS, GAP_S, SLIP_FIXES, MOST_PIECES = 277.78, 1800, 3, 5


def _up_to_here() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def drop_same_time(fixes: DataFrame) -> DataFrame:
    """The first fix of each run of equal times stays."""
    return fixes.withColumn("_p", F.lag("t").over(in_order())).where(F.col("_p").isNull() | (F.col("_p") != F.col("t"))).drop("_p")


def drop_backward(fixes: DataFrame) -> DataFrame:
    """A fix stays where it is later than all before it."""
    top = F.max("t").over(in_order().rowsBetween(W.unboundedPreceding, -1))
    return fixes.withColumn("_top", top).where(F.col("_top").isNull() | (F.col("t") > F.col("_top"))).drop("_top")


def drop_same_place(fixes: DataFrame) -> DataFrame:
    """A fix goes where it repeats the position before; idx stays, so results can be mapped back."""
    same = F.lag("lat_e5").over(in_order()).eqNullSafe(F.col("lat_e5")) & F.lag("lon_e5").over(in_order()).eqNullSafe(F.col("lon_e5"))
    return fixes.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def monotone_segments(fixes: DataFrame) -> DataFrame:
    """segment: how often time has run backward so far."""
    back = F.when(F.col("t") < F.lag("t").over(in_order()), 1).otherwise(0)
    return fixes.withColumn("_back", back).withColumn("segment", F.sum("_back").over(_up_to_here())).drop("_back")


def gap_segments(fixes: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """segment: how many gaps longer than gap_s lie before."""
    gap = F.when(F.col("t") - F.lag("t").over(in_order()) > gap_s, 1).otherwise(0)
    return fixes.withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(_up_to_here())).drop("_gap")


def sustained(fixes: DataFrame, holds: str, seconds: int) -> DataFrame:
    """sustained: whether the fix lies in a run where `holds` is true that lasts longer than `seconds`."""
    new = F.when(F.col(holds).eqNullSafe(F.lag(holds).over(in_order())), 0).otherwise(1)
    numbered = fixes.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_up_to_here()))
    run = W.partitionBy("flight_id", "_run")
    return numbered.withColumn("sustained", F.col(holds) & (F.max("t").over(run) - F.min("t").over(run) > seconds)).drop("_new", "_run")


def time_slice(fixes: DataFrame, windows: DataFrame) -> DataFrame:
    """Fixes within each flight's takeoff_t and landing_t, both included; flights without one have no rows."""
    return fixes.join(windows, "flight_id").where(F.col("t").between(F.col("takeoff_t"), F.col("landing_t"))).drop("takeoff_t", "landing_t")


def slice_bounds(fixes: DataFrame, windows: DataFrame) -> DataFrame:
    """(flight_id, first_idx, last_idx, n, error): which fixes time_slice() leaves of each flight in windows; without any, error says so, as for
    a flight that has no fixes or a null takeoff_t or landing_t."""
    kept = time_slice(fixes, windows).groupBy("flight_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))
    told = windows.select("flight_id").distinct().join(kept, "flight_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return told.withColumn("error", F.when(F.col("n") == 0, "no fixes between takeoff and landing"))


# --- fixes that can be reached ----------------------------------------------------------------------------------------------------


def _reach(a: str, b: str) -> Column:
    """Whether fix b lies after fix a and can be reached from it at less than MOST_MPS; both are structs (t, lat_e5, lon_e5)."""
    dt = F.col(f"{b}.t") - F.col(f"{a}.t")
    return (dt > 0) & (flat_distance_m(f"{a}.lat_e5", f"{a}.lon_e5", f"{b}.lat_e5", f"{b}.lon_e5") < MOST_MPS * dt)


def _next_reachable(places: DataFrame, breaks: DataFrame) -> DataFrame:
    """(flight_id, at, next): the first fix behind each break that can be reached from it; breaks without one are left out. The fixes
    that are tried double from round to round, so a break costs as many rows as twice the fixes it skips."""
    found, todo, tried = None, breaks, 1
    while True:
        offsets = F.explode(F.sequence(F.lit(tried + 1), F.lit(2 * tried))).alias("_by")
        tries = todo.select("flight_id", "at", F.col("here").alias("from"), offsets).withColumn("i", F.col("at") + F.col("_by")).join(places.select("flight_id", "i", F.col("here").alias("to")), ["flight_id", "i"])
        hits = tries.where(_reach("from", "to")).groupBy("flight_id", "at").agg(F.min("i").alias("next"))
        hits = settled(hits)
        found = hits if found is None else found.unionByName(hits)
        tried *= 2
        todo = settled(todo.where(F.col("at") + tried < F.col("last")).join(hits, ["flight_id", "at"], "left_anti"))
        if todo.isEmpty():
            return found


def _visited(hops: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes (flight_id, at) on the way from each head along hops (flight_id, at, to): each round adds what lies twice as many hops
    away, by hops that have doubled."""
    seen, n = settled(heads), -1
    while n != (n := seen.count()):
        further = seen.join(hops, ["flight_id", "at"]).select("flight_id", F.col("to").alias("at"))
        seen = settled(seen.unionByName(further).distinct())
        hops = settled(hops.join(hops.select("flight_id", F.col("at").alias("to"), F.col("to").alias("_to")), ["flight_id", "to"]).select("flight_id", "at", F.col("_to").alias("to")))
    return seen


def plausible_fixes(fixes: DataFrame) -> DataFrame:
    """(flight_id, idx) of the fixes that can be reached from the last one kept at less than MOST_MPS; if only the first step is out of
    reach, the first fix is the odd one.

    Between breaks, where a fix can't be reached from the one before it, all are kept or none. So only breaks need a search for the
    next fix that can be reached, and the kept ones are those on the way of pointers from break to break.
    """
    w = in_order()
    places = fixes.select("flight_id", "idx", F.struct("t", "lat_e5", "lon_e5").alias("here"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    places = places.withColumn("last", F.count("*").over(W.partitionBy("flight_id")) - 1).withColumn("_n", F.lead("here").over(w))
    places = places.withColumn("fits", _reach("here", "_n")).drop("_n")
    odd = (F.col("last") > 1) & ~F.col("fits") & F.lead("fits").over(w)
    stop = F.min(F.when(~F.coalesce("fits", F.lit(False)), F.col("i"))).over(W.partitionBy("flight_id").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0))
    # stop: the first break, or the last fix, from each fix on.
    places = settled(places.withColumn("odd", odd & (F.col("i") == 0)).withColumn("stop", stop))
    breaks = places.where("fits = false").select("flight_id", F.col("i").alias("at"), "here", "last")
    nexts = _next_reachable(places, breaks)
    # From break to break: behind the next reachable fix, the first break from there on.
    to = places.select("flight_id", F.col("i").alias("next"), "stop", "last")
    hops = nexts.join(to, ["flight_id", "next"]).select("flight_id", "at", F.col("stop").alias("to"))
    begin = F.when(F.col("odd"), 1).otherwise(0).cast("long")
    heads = places.where("i = 0").select("flight_id", begin.alias("i")).join(places.select("flight_id", "i", "stop"), ["flight_id", "i"])
    seen = _visited(hops, heads.select("flight_id", F.col("stop").alias("at")))
    starts = heads.select("flight_id", "i").unionByName(nexts.join(seen, ["flight_id", "at"]).select("flight_id", F.col("next").alias("i"))).withColumn("starts", F.lit(True))
    kept = F.last(F.when(F.col("starts"), F.col("stop")), ignorenulls=True).over(W.partitionBy("flight_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return places.join(starts, ["flight_id", "i"], "left").withColumn("_until", kept).where(F.col("_until") >= F.col("i")).select("flight_id", "idx")


# --- on all flights ---------------------------------------------------------------------------------------------------------------

_FIX = ["idx", "t", "lat_e5", "lon_e5", "geo_dm", "pressure_dm"]


def shifted_flights(fixes: DataFrame) -> DataFrame:
    """(flight_id, shifted): whether time runs backward for more than SLIP_FIXES fixes somewhere. Nested backward runs are shorter than
    the outer, so each backward step is looked at on its own: a window finds where the time before it is passed."""
    w = in_order()
    back = fixes.select("flight_id", "idx", "t").withColumn("_p", F.lag("t").over(w)).withColumn("_next", F.collect_list("t").over(w.rowsBetween(0, SLIP_FIXES)))
    # More than SLIP_FIXES: neither the fix itself nor the next ones, as many as there must be, are later.
    run = (F.size("_next") > SLIP_FIXES) & ~F.exists("_next", lambda t: t > F.col("_p"))
    return back.groupBy("flight_id").agg(F.coalesce(F.bool_or((F.col("t") < F.col("_p")) & run), F.lit(False)).alias("shifted"))


def chained_pieces(fixes: DataFrame) -> DataFrame:
    """(flight_id, segment, chain, place): for each of a track's pieces between backward steps the chain that it begins, of the later pieces
    that each begin after the one before has ended. Tracks of more than MOST_PIECES pieces have none."""
    pieces = monotone_segments(fixes).groupBy("flight_id", "segment").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    listed = pieces.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("first", "segment", "last"))).alias("p")).where(F.size("p") <= MOST_PIECES)
    # At most MOST_PIECES entries, so each chain is folded in place.
    none = F.array().cast("array<struct<first:bigint,segment:bigint,last:bigint>>")
    own = F.aggregate(F.slice("p", F.col("chain") + 1, F.size("p")), none, lambda c, x: F.when((F.size(c) == 0) | (x["first"] > F.element_at(c, -1)["last"]), F.concat(c, F.array(x))).otherwise(c))
    chains = listed.withColumn("chain", F.explode(F.sequence(F.lit(0), F.size("p") - 1))).select("flight_id", "chain", F.posexplode(own).alias("place", "piece"))
    return chains.select("flight_id", F.col("piece.segment").alias("segment"), "chain", "place")


def longest_flights(fixes: DataFrame) -> DataFrame:
    """The plausible fixes of each track, cut to the part between gaps longer than GAP_S with the longest flight; all of them where
    there is no gap, or no flight in any part."""
    parts = settled(gap_segments(fixes.join(plausible_fixes(fixes), ["flight_id", "idx"])))
    cut = parts.groupBy("flight_id").agg(F.max("segment").alias("most")).where("most > 0").select("flight_id")
    own = parts.join(cut, "flight_id", "left_semi").withColumn("flight_id", F.struct("flight_id", "segment"))
    length = F.struct((F.col("landing_t") - F.col("takeoff_t")).alias("s"), (-F.col("flight_id.segment")).alias("_segment"))
    best = flight_windows(own).groupBy(F.col("flight_id.flight_id").alias("flight_id")).agg((-F.max(length)["_segment"]).alias("best"))
    return parts.join(best, "flight_id", "left").where(F.col("best").isNull() | (F.col("best") == F.col("segment"))).drop("segment", "best")


def cleaned(fixes: DataFrame) -> DataFrame:
    """The cleaned fixes of every flight, without repeated times, slips, jumps and all but the longest flight, with new dense idx and the
    old one as raw_idx. fixes: (flight_id, idx, t, lat_e5, lon_e5, geo_dm, pressure_dm).

    A track whose time runs backward for long is tried as every chain of its pieces, of which the one with the longest flight stays,
    the first of equals; one of more than MOST_PIECES pieces, or without a flight in any chain, has no rows.
    """
    once = settled(drop_same_time(fixes.select("flight_id", *_FIX)))
    shifted = settled(shifted_flights(once))
    plain = drop_backward(once.join(shifted.where("not shifted"), "flight_id", "left_semi")).withColumn("raw_idx", F.col("idx"))
    apart = once.join(shifted.where("shifted"), "flight_id", "left_semi")
    straight = longest_flights(plain).select("flight_id", "raw_idx", *_FIX)
    chained = monotone_segments(apart).join(chained_pieces(apart), ["flight_id", "segment"]).withColumn("raw_idx", F.col("idx"))
    chained = chained.withColumn("flight_id", F.struct("flight_id", "chain"))
    chained = chained.withColumn("idx", (F.row_number().over(W.partitionBy("flight_id").orderBy("place", "raw_idx")) - 1).cast("long")).drop("segment", "chain", "place")
    tried = settled(longest_flights(chained))
    length = F.struct((F.col("landing_t") - F.col("takeoff_t")).alias("s"), (-F.col("flight_id.chain")).alias("_chain"))
    best = flight_windows(tried).groupBy(F.col("flight_id.flight_id").alias("flight_id")).agg((-F.max(length)["_chain"]).alias("best"))
    joined = tried.select(F.col("flight_id.flight_id").alias("flight_id"), F.col("flight_id.chain").alias("chain"), "raw_idx", *_FIX).join(best, "flight_id").where("chain = best")
    both = straight.unionByName(joined.select(straight.columns))
    dense = (F.row_number().over(in_order()) - 1).cast("long")
    return both.withColumn("_idx", dense).select("flight_id", F.col("_idx").alias("idx"), "raw_idx", "t", "lat_e5", "lon_e5", "geo_dm", "pressure_dm")
