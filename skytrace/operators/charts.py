"""What a flight's charts, map lines and cursor show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.text import converted, signed
from skytrace.operators import series
from skytrace.operators.series import in_order

# Points of a speed and of a climb chart; fixes around the flight that smoothing may see.
SPEED_POINTS, CLIMB_POINTS, PAD_FIXES = 1500, 1000, 60


def _buckets(flight: DataFrame, columns: list[str], points: int) -> DataFrame:
    """Means of columns over `points` even parts of each flight's fixes."""
    numbered = flight.withColumn("_i", F.row_number().over(in_order())).withColumn("_n", F.count("*").over(W.partitionBy("flight_id")))
    bucket = F.when(F.col("_n") <= points, F.col("_i") - 1).otherwise(F.ceil(F.col("_i") * points / F.col("_n")) - 1).cast("long")
    return numbered.groupBy("flight_id", bucket.alias("bucket")).agg(*[F.avg(c).alias(c) for c in columns])


def speed_series(fixes: DataFrame, windows: DataFrame, half_s: int = 30, points: int = SPEED_POINTS) -> DataFrame:
    """(flight_id, bucket, t, ground_kmh, path_kmh, tas_kmh) between takeoff and landing; path speed and TAS are smoothed, and see
    PAD_FIXES fixes beyond both ends. windows: (flight_id, takeoff_idx, landing_idx)."""
    both = fixes.join(windows.select("flight_id", "takeoff_idx", "landing_idx"), "flight_id")
    whole = series.ground_speed_kmh(both, half_s)
    near = whole.where(F.col("idx").between(F.col("takeoff_idx") - PAD_FIXES, F.col("landing_idx") + PAD_FIXES))
    smooth = series.moving_average(series.path_speed_kmh(near), "path_kmh", half_s, "path_kmh")
    smooth = series.moving_average(smooth, "tas_kmh", half_s, "tas_kmh")
    return _buckets(smooth.where(F.col("idx").between(F.col("takeoff_idx"), F.col("landing_idx"))), ["t", "ground_kmh", "path_kmh", "tas_kmh"], points)


def altitude_series(fixes: DataFrame, windows: DataFrame, unit: str = "m", ground: str | None = None) -> DataFrame:
    """(flight_id, idx, t, gps, baro, ground) of every fix between takeoff and landing in metres or feet, single precision; baro is null
    in flights that lack a pressure, ground where no column is named. windows: (flight_id, takeoff_idx, landing_idx)."""
    inside = fixes.join(windows.select("flight_id", "takeoff_idx", "landing_idx"), "flight_id").where(F.col("idx").between(F.col("takeoff_idx"), F.col("landing_idx")))
    whole = W.partitionBy("flight_id")
    baro = F.when(F.count("pressure_dm").over(whole) == F.count("*").over(whole), F.col("pressure_dm"))
    scaled = lambda c, by: converted(c / by, "m", unit).cast("float")
    below = scaled(F.col(ground), 1) if ground else F.lit(None).cast("float")
    return inside.select("flight_id", "idx", "t", scaled(F.col("alt_dm"), 10).alias("gps"), scaled(baro, 10).alias("baro"), below.alias("ground"))


def climb_series(fixes: DataFrame, windows: DataFrame, half_s: int = 5, points: int = CLIMB_POINTS, altitude: str = "alt_dm") -> DataFrame:
    """(flight_id, bucket, t, vario)."""
    both = series.vario_ms(fixes, half_s, altitude).join(windows.select("flight_id", "takeoff_idx", "landing_idx"), "flight_id")
    return _buckets(both.where(F.col("idx").between(F.col("takeoff_idx"), F.col("landing_idx"))), ["t", "vario"], points)


def map_runs(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """(flight_id, run, colour, start_idx, end_idx): lines before takeoff, by climb bucket in flight and after landing. Neighbours
    share a fix. windows: (flight_id, n_fixes, takeoff_idx, landing_idx); segments: (flight_id, bucket, start_idx, end_idx).
    colour is the place on the ramp from 0, or -1 on the ground."""
    w = windows.select("flight_id", F.col("n_fixes").alias("_n"), F.col("takeoff_idx").alias("_a"), F.col("landing_idx").alias("_b"))
    before = w.where("_a > 0").select("flight_id", F.lit(-1).alias("colour"), F.lit(0).cast("long").alias("start_idx"), F.col("_a").alias("end_idx"))
    after = w.where("_b < _n - 1").select("flight_id", F.lit(-1).alias("colour"), F.col("_b").alias("start_idx"), (F.col("_n") - 1).alias("end_idx"))
    own = segments.join(w, "flight_id").select("flight_id", F.least(F.greatest(F.col("bucket") + 5, F.lit(0)), F.lit(10)).alias("colour"), "start_idx", F.least(F.col("end_idx") + 1, F.col("_n") - 1).alias("end_idx"))
    lines = before.withColumn("_part", F.lit(0)).unionByName(own.withColumn("_part", F.lit(1))).unionByName(after.withColumn("_part", F.lit(2)))
    in_order_ = W.partitionBy("flight_id").orderBy("_part", "start_idx", "end_idx", "colour")
    return lines.withColumn("run", F.row_number().over(in_order_)).drop("_part")


def route_legs(routes: DataFrame) -> DataFrame:
    """(flight_id, type, leg, role, from_idx, to_idx): scored legs between turnpoints, for a triangle the one that closes it, and the
    gap as an auxiliary leg. routes: rows with turns, gap_ends and type."""
    pair = lambda a, b, role: F.struct(a.cast("long").alias("from_idx"), b.cast("long").alias("to_idx"), F.lit(role).alias("role"))
    scored = F.transform(F.sequence(F.lit(0), F.size("turns") - 2), lambda i: pair(F.get("turns", i), F.get("turns", i + 1), "scored"))
    triangle = F.col("gap_ends").isNotNull()
    closing = F.when(triangle, F.array(pair(F.element_at("turns", -1), F.element_at("turns", 1), "closing"), pair(F.element_at("gap_ends", 2), F.element_at("gap_ends", 1), "auxiliary")))
    legs = F.when(triangle, F.concat(scored, F.coalesce(closing, F.array()))).otherwise(scored)
    return routes.select("flight_id", "type", F.posexplode(legs).alias("leg", "_l")).select("flight_id", "type", "leg", "_l.role", "_l.from_idx", "_l.to_idx")


def readout(fixes: DataFrame, cursors: DataFrame) -> DataFrame:
    """The fix under each cursor (flight_id, share), share from 0 at takeoff to 1 at landing; with windows' takeoff_idx, landing_idx."""
    idx = F.floor(F.col("takeoff_idx") + F.col("share") * (F.col("landing_idx") - F.col("takeoff_idx")) + 0.5).cast("long")
    at = cursors.select("flight_id", "share", F.least(F.greatest(idx, F.col("takeoff_idx")), F.col("landing_idx")).alias("idx"))
    return at.join(fixes, ["flight_id", "idx"])


def readout_texts(values: DataFrame, unit: str = "m", speed_unit: str = "km/h") -> DataFrame:
    """What a cursor shows of a row (t, alt_dm, pressure_dm, path_kmh, ground_kmh, tas_kmh, vario, offset_s, has_altitude), as texts: the
    time of day at the flight's offset, altitudes, speeds and climb; null where there is nothing to show."""
    metres = lambda dm: F.concat(F.floor(converted(dm / 10, "m", unit) + 0.5).cast("long").cast("string"), F.lit(" " + unit))
    speed = lambda kmh: F.concat(F.floor(converted(kmh, "km/h", speed_unit) + 0.5).cast("long").cast("string"), F.lit(" " + speed_unit))
    shown = lambda c: F.when(F.col("has_altitude"), c)
    kept = [c for c in values.columns if c not in ("t", "alt_dm", "pressure_dm", "path_kmh", "ground_kmh", "tas_kmh", "vario", "offset_s", "has_altitude")]
    return values.select(
        *kept, F.date_format(F.timestamp_seconds(F.col("t") + F.col("offset_s")), "HH:mm:ss").alias("time"), shown(metres(F.col("alt_dm"))).alias("gps"), shown(metres(F.col("pressure_dm"))).alias("baro"),
        speed(F.col("path_kmh")).alias("path_speed"), speed(F.col("ground_kmh")).alias("speed"), speed(F.col("tas_kmh")).alias("tas"), shown(signed(F.col("vario"), 1)).alias("vario"),
    )


def label_widths(texts: DataFrame, columns: list[str]) -> DataFrame:
    """The widest label of each column in a flight, null where it shows none."""
    return texts.groupBy("flight_id").agg(*[F.max(F.length(c)).alias(c) for c in columns])


def share_of(idx: Column, takeoff: Column, landing: Column) -> Column:
    """Where a fix lies within the flight, 0 to 1."""
    return F.when(landing > takeoff, (idx - takeoff) / (landing - takeoff)).otherwise(0.0)


#: A route's turnpoints as JSON.
TURNPOINTS = "array<struct<type:string,fix:struct<idx:bigint,lat:int,lon:int>>>"


def turnpoints_json(routes: DataFrame, fixes: DataFrame) -> DataFrame:
    """(flight_id, type, turnpoints): each route's turnpoints with their positions as JSON, which from_json reads with TURNPOINTS."""
    at = routes.select("flight_id", "type", F.posexplode("turns").alias("_k", "idx")).join(fixes.select("flight_id", "idx", "lat_e5", "lon_e5"), ["flight_id", "idx"])
    point = F.struct(F.lit("point").alias("type"), F.struct("idx", F.col("lat_e5").alias("lat"), F.col("lon_e5").alias("lon")).alias("fix"))
    listed = at.groupBy("flight_id", "type").agg(F.array_sort(F.collect_list(F.struct("_k", point.alias("p")))).alias("_l"))
    return listed.select("flight_id", "type", F.to_json(F.col("_l.p")).alias("turnpoints"))


def sliced_logs(fixes: DataFrame, windows: DataFrame) -> DataFrame:
    """(flight_id, igc): the logs of the stretches between takeoff and landing. windows: (flight_id, takeoff_t, landing_t)."""
    from skytrace.operators.cleaning import time_slice
    from skytrace.sources.igc import compose

    return compose(time_slice(fixes, windows))
