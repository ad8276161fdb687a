"""Takeoff and landing, as windows over fixes; the likeliest states take a flight's signs, one by one, from one row."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import flat_distance_m, haversine_m
from skytrace.operators.series import in_order
from skytrace.storage import settled

# Half the smoothing period; speeds (horizontal, vertical) that start and keep up a flight and that end one on the
# ground, in m/s; how long each must last; what makes an altitude tell something; the speed of the plain model, in km/h, its
# chances (at the start, of staying, of a right sign), and how short a stop is none.
HALF_PERIOD_S = 5
START_MPS, GO_ON_MPS, GROUND_MPS = (5.0, 0.9), (1.5, 0.05), (2.5, 0.1)
FLIGHT_S, GROUND_S = 60, 20
ALTITUDE_FIXES, ALTITUDE_RANGE_DM, ALTITUDE_VALUES = 5, 100, 4
PLAIN_KMH, START_CHANCES, STAY, RIGHT, SHORT_STOP_S = 15.0, (0.8, 0.2), 0.9995, 0.8, 300
CHANGE, WRONG = 0.0005, 0.2  # what STAY and RIGHT leave, without the rounding of a difference
#: Decimals of mean speeds and of ways that are compared: a mean that is just a limit, and ways of one length, are told so whatever the order of their sums.
MEAN_DIGITS, WAY_DIGITS = 9, 6


def _upto() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def _flight() -> WindowSpec:
    return W.partitionBy("flight_id")


def rounds_for(fixes: DataFrame) -> int:
    """Rounds of a scan over the longest flight."""
    (most,) = fixes.groupBy("flight_id").count().agg(F.max("count")).first()
    return max(1, math.ceil(math.log2(most or 1)))


# --- the likeliest states -----------------------------------------------------------------------------------------------------------


def _path(signs: Iterable[bool | None]) -> list[int]:
    """The likeliest states behind some signs; sums of logarithms in the order of the fixes, as their rounding decides between equals."""
    stay, change, right, wrong = map(math.log, (STAY, CHANGE, RIGHT, WRONG))
    came, a, b = [], None, None
    for s in signs:
        ra, rb = (wrong, right) if s else (right, wrong)
        if a is None:
            a, b = math.log(START_CHANCES[0]) + ra, math.log(START_CHANCES[1]) + rb
        else:
            came.append((a + stay < b + change, a + change < b + stay))
            a, b = max(a + stay, b + change) + ra, max(a + change, b + stay) + rb
    states = [int(b >= a)]
    for to in reversed(came):
        states.append(int(to[states[-1]]))
    return states[::-1]


def _states(signs: pd.Series) -> pd.Series:
    return signs.map(_path)


def likeliest_states(fixes: DataFrame, sign: str, rounds: int | None = None) -> DataFrame:
    """fixes with `state`: the likeliest path through two states (0, 1) that tend to stay and mostly show their own sign. A state keeps
    its predecessor's unless changing pays; of equal ends the second. Equals are many, and which of them a sum of doubles makes the greater
    depends on its order, so a flight's signs are a row and summed one by one, whatever `rounds`."""
    rest = [c for c in fixes.columns if c not in ("flight_id", "idx", sign)]
    told = fixes.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("idx", sign, *rest))).alias("_f"))
    each = F.explode(F.arrays_zip("_f", F.pandas_udf(_states, "array<tinyint>")(F.col(f"_f.{sign}")).alias("_states"))).alias("_e")
    return told.select("flight_id", each).select("flight_id", "_e._f.*", F.col("_e._states").cast("int").alias("state")).select(*fixes.columns, "state")


def speed_windows(fixes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(flight_id, takeoff_idx, landing_idx) by the plain model of speeds alone, whatever the altitudes tell: from the first flying fix
    to where the last flying run ends; stops of less than SHORT_STOP_S between flying runs are none."""
    w = in_order()
    dt = F.col("t") - F.lag("t").over(w)
    moved = haversine_m(F.lag("lat_e5").over(w), F.lag("lon_e5").over(w), "lat_e5", "lon_e5")
    own = fixes.select("flight_id", "idx", "t", ((dt > 0) & (moved * 3.6 > PLAIN_KMH * F.greatest(dt, F.lit(1)))).alias("_fast"))
    own = own.withColumn("_n", F.count("*").over(_flight())).where("_n > 1")
    own = own.withColumn("fast", F.coalesce("_fast", F.lead("_fast").over(w)))
    told = likeliest_states(own.select("flight_id", "idx", "t", "fast"), "fast", rounds)
    new = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    told = told.withColumn("_new", new).withColumn("_run", F.sum("_new").over(_upto()))
    runs = told.groupBy("flight_id", "_run").agg(F.first("state").alias("state"), F.min("idx").alias("idx"), F.min_by("t", "idx").alias("t"), F.max("idx").alias("last"))
    by_run = W.partitionBy("flight_id").orderBy("_run")
    short = (F.lead("t").over(by_run) - F.col("t") < SHORT_STOP_S) & F.lag("t").over(by_run).isNotNull()
    runs = runs.withColumn("flying", (F.col("state") == 1) | F.coalesce(short, F.lit(False))).withColumn("_next", F.lead("idx").over(by_run)).withColumn("_grounded", ~F.lead("flying").over(by_run))
    found = runs.groupBy("flight_id").agg(F.min(F.when(F.col("flying"), F.col("idx"))).alias("takeoff_idx"), F.max(F.when(F.col("flying") & F.col("_grounded"), F.col("_next"))).alias("_down"), F.max("last").alias("_last"))
    return found.where("takeoff_idx is not null").select("flight_id", "takeoff_idx", F.coalesce("_down", "_last").alias("landing_idx"))


# --- by altitude --------------------------------------------------------------------------------------------------------------------


def _smoothed(fixes: DataFrame, *columns: str) -> DataFrame:
    """Each column's mean from the last fix HALF_PERIOD_S or more before to the first as much after it, to MEAN_DIGITS decimals."""
    out = fixes
    near = W.partitionBy("flight_id").orderBy("t").rangeBetween(-HALF_PERIOD_S + 1, HALF_PERIOD_S - 1)
    before = W.partitionBy("flight_id").orderBy("t").rangeBetween(W.unboundedPreceding, -HALF_PERIOD_S)
    after = W.partitionBy("flight_id").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, -HALF_PERIOD_S)
    out = out.withColumn("_lo", F.max(F.struct("t", "idx", *columns)).over(before)).withColumns({f"_s_{c}": F.sum(c).over(near) for c in columns}).withColumn("_c", F.count("*").over(near))
    out = out.withColumn("_hi", F.max(F.struct((-F.col("t")).alias("t"), (-F.col("idx")).alias("idx"), *columns)).over(after))
    n = F.col("_c") + F.col("_lo").isNotNull().cast("int") + F.col("_hi").isNotNull().cast("int")
    mean = lambda c: F.round((F.col(f"_s_{c}") + F.coalesce(f"_lo.{c}", F.lit(0.0)) + F.coalesce(f"_hi.{c}", F.lit(0.0))) / n, MEAN_DIGITS)
    return out.withColumns({c: mean(c) for c in columns}).drop("_lo", "_hi", "_c", *[f"_s_{c}" for c in columns])


def _lasting(fixes: DataFrame, begins: Column, goes_on: Column, seconds: int, out: str) -> DataFrame:
    """A column `out`: fixes of runs that begin where `begins` holds, last while `goes_on` does, and are longer than `seconds`; the last fix
    of a track is never tested. A fix that begins a run must keep it up too."""
    on = goes_on & (F.col("_i") < F.col("_n") - 1)
    rows = fixes.withColumn("_on", on).withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(_upto()))
    run = W.partitionBy("flight_id", "_run")
    first = F.min(F.when(F.col("_on") & begins, F.struct("idx", "t"))).over(run)
    rows = rows.withColumn("_b", first).withColumn("_e", F.max(F.when(F.col("_on"), F.struct("idx", "t"))).over(run))
    lasts = F.col("_on") & (F.col("idx") >= F.col("_b.idx")) & (F.col("_e.t") > F.col("_b.t") + seconds)
    return rows.withColumn(out, F.coalesce(lasts, F.lit(False))).drop("_on", "_run", "_b", "_e")


def altitude_windows(fixes: DataFrame) -> DataFrame:
    """(flight_id, takeoff_idx, landing_idx) of each flight that its altitude z_dm shows: of stretches that rise and fall fast enough for long,
    from the last ground before to the first ground after, the one of the longest way; the last of equals."""
    w = in_order()
    step = flat_distance_m(F.lag("lat_e5").over(w), F.lag("lon_e5").over(w), "lat_e5", "lon_e5")
    own = fixes.select("flight_id", "idx", "t", step.alias("_step"), (F.col("t") - F.lag("t").over(w)).alias("_dt"), ((F.col("z_dm") - F.lag("z_dm").over(w)) / 10.0).alias("_dz"))
    speeds = {"h": F.when(F.col("_dt") > 0, F.col("_step") / F.col("_dt")), "v": F.when(F.col("_dt") > 0, F.abs(F.col("_dz") / F.col("_dt")))}
    own = own.withColumns(speeds).withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(_upto()), F.lit(0.0)) for c in speeds})
    own = own.withColumn("_path", F.sum(F.coalesce("_step", F.lit(0.0))).over(_upto())).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(_flight()))
    own = _smoothed(own.drop("_step", "_dt", "_dz"), "h", "v")
    above = lambda mps: (F.col("h") > mps[0]) & (F.col("v") > mps[1])
    slow = (F.col("h") < GROUND_MPS[0]) & (F.col("v") < GROUND_MPS[1])
    own = _lasting(_lasting(own, above(START_MPS), above(GO_ON_MPS), FLIGHT_S, "_flying"), slow, slow, GROUND_S, "_ground")
    # Ground before and after, the fix itself included; all flying fixes with one ground behind them are one stretch.
    here = F.struct("_i", "idx", "_path")
    own = own.withColumn("_from", F.max(F.when(F.col("_ground"), here)).over(_upto()))
    own = own.withColumn("_to", F.min(F.when(F.col("_ground"), here)).over(W.partitionBy("flight_id").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)))
    start = F.min(here).over(_flight())
    before_last = F.max(F.when(F.col("_i") == F.col("_n") - 2, here)).over(_flight())
    own = own.withColumn("_start", start).withColumn("_stop", before_last).where(F.col("_flying") & (F.col("_i") < F.col("_n") - 1))
    at = own.groupBy("flight_id", F.coalesce("_to._i", F.lit(-1)).alias("_g")).agg(F.min(F.struct("_i", here.alias("at"), "_from", "_to", "_start", "_stop")).alias("f")).select("flight_id", "f.*")
    landing = F.greatest(F.col("at"), F.least(F.coalesce("_to", "_stop"), F.col("_stop")))
    ends = at.select("flight_id", F.coalesce("_from", "_start").alias("a"), landing.alias("b"), F.col("_i"))
    best = ends.groupBy("flight_id").agg(F.max(F.struct(F.round(F.col("b._path") - F.col("a._path"), WAY_DIGITS).alias("far"), "_i", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))).alias("best"))
    return best.select("flight_id", F.col("best.a").alias("takeoff_idx"), F.col("best.b").alias("landing_idx"))


def flight_windows(fixes: DataFrame) -> DataFrame:
    """(flight_id, takeoff_idx, landing_idx, takeoff_t, landing_t) of every flight that has one: by its pressure altitude, else by its
    other, where these tell something; where they don't, or show no flight, by speeds. fixes: (flight_id, idx, t, lat_e5, lon_e5, geo_dm,
    pressure_dm)."""
    own = fixes.select("flight_id", "idx", "t", "lat_e5", "lon_e5", "geo_dm", "pressure_dm")
    tells = lambda z: (F.count(z) == F.count("*")) & (F.count("*") >= ALTITUDE_FIXES) & (F.max(z) - F.min(z) >= ALTITUDE_RANGE_DM) & (F.count_distinct(F.col(z)) >= ALTITUDE_VALUES)
    which = own.groupBy("flight_id").agg(tells("pressure_dm").alias("_p"), tells("geo_dm").alias("_g"), F.count("*").alias("_n"))
    told = settled(own.join(which.where("_n > 1").drop("_n"), "flight_id"))
    z = F.when(F.col("_p"), F.col("pressure_dm")).when(F.col("_g"), F.col("geo_dm"))
    by_altitude = altitude_windows(told.where(F.col("_p") | F.col("_g")).withColumn("z_dm", z))
    by_altitude = settled(by_altitude)
    by_speed = speed_windows(told.join(by_altitude, "flight_id", "left_anti"))
    found = by_altitude.unionByName(by_speed)
    times = told.select("flight_id", "idx", "t")
    for end in ("takeoff", "landing"):
        found = found.join(times.select("flight_id", F.col("idx").alias(f"{end}_idx"), F.col("t").alias(f"{end}_t")), ["flight_id", f"{end}_idx"])
    return found.select("flight_id", "takeoff_idx", "landing_idx", "takeoff_t", "landing_t")
