"""Per-fix series of a flight: speeds, climb, runs and downsampling, as window functions over long-form fixes.

Fixes are rows (flight_id, idx, t, lat_e5, lon_e5, alt_dm ...); t in epoch seconds. All windows are partitioned by flight, so one
shuffle on flight_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import flat_distance_m, haversine_m
from skytrace.storage import settled


def in_order() -> WindowSpec:
    """The fixes of a flight in order. A function, as windows need a session."""
    return W.partitionBy("flight_id").orderBy("idx")


def each_flight(fixes: DataFrame) -> GroupedData:
    """Fixes grouped by flight for a kernel: dealt to as many tasks as the session shuffles to, however few bytes they are, as a kernel's
    work is not in its bytes; left alone, few bytes would all go to one task."""
    n = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fixes.repartition(n, "flight_id").groupBy("flight_id")


def _around(seconds: int) -> WindowSpec:
    return W.partitionBy("flight_id").orderBy("t").rangeBetween(-seconds, seconds)


def _ends(fixes: DataFrame, half_s: int, *columns: str) -> DataFrame:
    """fixes with _a and _b (t, idx, columns), the first and the last fix of the centred window; idx decides among fixes of one time, which
    a window in the order of t alone has in any order."""
    end = F.struct("t", "idx", *columns)
    return fixes.withColumn("_a", F.min(end).over(_around(half_s))).withColumn("_b", F.max(end).over(_around(half_s)))


def path_speed_kmh(fixes: DataFrame) -> DataFrame:
    """path_kmh: speed over the step to each fix; a step of no time repeats the speed before; the first fix has the second's."""
    dt = F.col("t") - F.lag("t").over(in_order())
    step = haversine_m(F.lag("lat_e5").over(in_order()), F.lag("lon_e5").over(in_order()), "lat_e5", "lon_e5")
    own = fixes.withColumn("_own", F.when(dt > 0, step / dt * 3.6)).withColumn("_dt", dt)
    carried = F.last("_own", ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    carried = own.withColumn("_kmh", F.coalesce(carried, F.lit(0.0)))
    first = F.coalesce(F.lead("_kmh").over(in_order()), F.lit(0.0))
    return carried.withColumn("path_kmh", F.when(F.col("_dt").isNull(), first).otherwise(F.col("_kmh"))).drop("_own", "_dt", "_kmh")


def ground_speed_kmh(fixes: DataFrame, half_s: int = 30) -> DataFrame:
    """ground_kmh: displacement between the ends of the centred window over its time; 0 where the window has no time."""
    both = _ends(fixes, half_s, "lat_e5", "lon_e5")
    dt = F.col("_b.t") - F.col("_a.t")
    moved = haversine_m("_a.lat_e5", "_a.lon_e5", "_b.lat_e5", "_b.lon_e5")
    return both.withColumn("ground_kmh", F.when(dt > 0, moved / dt * 3.6).otherwise(0.0)).drop("_a", "_b")


def vario_ms(fixes: DataFrame, half_s: int = 5, altitude: str = "alt_dm") -> DataFrame:
    """vario: climb in m/s between the ends of the centred window; 0 where it has no time."""
    both = _ends(fixes, half_s, altitude)
    dt = F.col("_b.t") - F.col("_a.t")
    return both.withColumn("vario", F.when(dt > 0, (F.col(f"_b.{altitude}") - F.col(f"_a.{altitude}")) / 10 / dt).otherwise(0.0)).drop("_a", "_b")


def with_best_altitude(fixes: DataFrame, pressure: str = "pressure_dm", gps: str = "alt_dm") -> DataFrame:
    """best_dm: the barometer's altitude in flights where every fix has one, else the receiver's."""
    flight = W.partitionBy("flight_id")
    whole = F.count(pressure).over(flight) == F.count("*").over(flight)
    return fixes.withColumn("best_dm", F.when(whole, F.col(pressure)).otherwise(F.col(gps)))


def _positions(fixes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(flight_id, range_id, lo, hi, first, n): the place of each range's first fix within its flight, from 0, and how many fixes it has. Ends
    of ranges stand among the fixes in one order, so a running count places them all."""
    end = lambda c, place: F.struct(F.col(c).cast("long").alias("idx"), F.lit(place).alias("_place"))
    ends = ranges.where("lo <= hi").select("flight_id", "range_id", "lo", "hi", F.explode(F.array(end("lo", 0), end("hi", 2))).alias("_e")).select("flight_id", "range_id", "lo", "hi", "_e.*")
    rows = fixes.select("flight_id", F.col("idx").cast("long").alias("idx"), F.lit(1).alias("_place")).unionByName(ends, allowMissingColumns=True)
    before = F.count_if(F.col("_place") == 1).over(W.partitionBy("flight_id").orderBy("idx", "_place").rowsBetween(W.unboundedPreceding, 0))
    both = rows.withColumn("_before", before).where("_place <> 1").groupBy("flight_id", "range_id", "lo", "hi")
    counts = both.agg(F.min("_before").alias("first"), (F.max("_before") - F.min("_before")).alias("n"))
    return counts.where("n > 0")


def range_boxes(fixes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bounding box of the fixes of each range (flight_id, range_id, lo, hi) of idx, both ends included; a range without fixes has
    none, ranges of one id share a box.

    A sparse table: each fix knows the boxes of the 1, 2, 4 ... fixes from it on, each of two boxes of the level below, all in one order of
    the flight. A range is covered by two boxes of one level, whatever its length, so it costs two look-ups by (flight_id, place)."""
    asked = settled(_positions(fixes, ranges).withColumn("level", F.length(F.bin("n")) - 1))
    levels = asked.agg(F.max("level")).first()[0] or 0  # one number
    sides = [(f"{f.__name__}_{c}", c, f, g) for c in ("lat_e5", "lon_e5") for f, g in ((F.min, F.least), (F.max, F.greatest))]
    table = fixes.join(asked.select("flight_id").distinct(), "flight_id", "left_semi").select("flight_id", "idx", F.struct(*[F.col(c).alias(name) for name, c, _, _ in sides]).alias("_0"))
    table = table.withColumn("i", (F.row_number().over(in_order()) - 1).cast("long"))
    for k in range(1, levels + 1):
        table = table.withColumn("_far", F.lead(f"_{k - 1}", 2 ** (k - 1)).over(in_order()))
        table = table.withColumn(f"_{k}", F.struct(*[g(F.col(f"_{k - 1}.{name}"), F.col(f"_far.{name}")).alias(name) for name, _, _, g in sides])).drop("_far")
    table = table.select("flight_id", "i", F.array(*[f"_{k}" for k in range(levels + 1)]).alias("_boxes"))
    last = F.col("first") + F.col("n") - F.pow(F.lit(2.0), F.col("level")).cast("long")
    looked = asked.select("flight_id", "range_id", "level", F.explode(F.array("first", last)).alias("i")).join(table, ["flight_id", "i"])
    box = F.element_at("_boxes", F.col("level") + 1)
    return looked.withColumn("_b", box).groupBy("flight_id", "range_id").agg(*[f(f"_b.{name}").alias(name) for name, _, f, _ in sides])


def compared(fixes: DataFrame, about: DataFrame, flight_ids: list) -> DataFrame:
    """The fixes of some flights with what `about` tells of each and since_s, the time since the flight's first fix; ids that have no
    fixes give none."""
    some = fixes.where(F.col("flight_id").isin(flight_ids))
    started = F.min("t").over(W.partitionBy("flight_id"))
    return some.withColumn("since_s", F.col("t") - started).join(about, "flight_id", "left")


def moving_average(fixes: DataFrame, column: str, half_s: int = 30, out: str = "smooth") -> DataFrame:
    """The mean over the centred window, both ends included."""
    return fixes.withColumn(out, F.avg(column).over(_around(half_s)))


def vario_bucket(vario: Column) -> Column:
    return F.least(F.greatest(F.floor(vario), F.lit(-5)), F.lit(5)).cast("int")


def runs(fixes: DataFrame, value: str) -> DataFrame:
    """(flight_id, run, value, start_idx, end_idx, start_t, end_t): maximal runs of fixes with one value."""
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(in_order())) & F.lag("idx").over(in_order()).isNotNull(), 0).otherwise(1)
    numbered = fixes.withColumn("_new", changed).withColumn("run", F.sum("_new").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("flight_id", "run").agg(F.first(value).alias(value), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))


def bucket_means(fixes: DataFrame, column: str, buckets: int) -> DataFrame:
    """(flight_id, bucket, mean): a series cut into `buckets` even parts; as it is where it has no more values."""
    n = F.count("*").over(W.partitionBy("flight_id"))
    numbered = fixes.withColumn("_i", F.row_number().over(in_order())).withColumn("_n", n)
    bucket = F.when(F.col("_n") <= buckets, F.col("_i") - 1).otherwise(F.ceil(F.col("_i") * buckets / F.col("_n")) - 1).cast("long")
    return numbered.groupBy("flight_id", bucket.alias("bucket")).agg(F.avg(column).alias("mean"))


def summary(fixes: DataFrame) -> DataFrame:
    """One row per flight: bounds, altitudes in metres (halves up), peaks, path length, the upper median of sample intervals within
    1 to 65,535 s, and whether the altitude tells anything (5 fixes, 4 values, 10 m)."""
    step = flat_distance_m(F.lag("lat_e5").over(in_order()), F.lag("lon_e5").over(in_order()), "lat_e5", "lon_e5")
    dt = F.col("t") - F.lag("t").over(in_order())
    stepped = fixes.withColumn("_step", step).withColumn("_dt", dt)
    metres = lambda x: F.floor(x / 10 + 0.5).cast("long")
    intervals = F.array_sort(F.collect_list("_dt"))
    median = F.when(F.size(intervals) > 0, F.element_at(intervals, F.floor(F.size(intervals) / 2).cast("int") + 1))
    return stepped.groupBy("flight_id").agg(
        F.count("*").alias("n_fixes"),
        F.min("lat_e5").alias("min_lat_e5"), F.max("lat_e5").alias("max_lat_e5"), F.min("lon_e5").alias("min_lon_e5"), F.max("lon_e5").alias("max_lon_e5"),
        metres(F.min("alt_dm")).alias("min_alt_m"), metres(F.max("alt_dm")).alias("max_alt_m"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_m"),
        F.bool_or(F.col("alt_dm") != 0).alias("has_altitude"),
        ((F.count("alt_dm") >= 5) & (F.max("alt_dm") - F.min("alt_dm") >= 100) & (F.countDistinct("alt_dm") >= 4)).alias("altitude_usable"),
        F.least(F.greatest(F.coalesce(median, F.lit(1)), F.lit(1)), F.lit(65535)).alias("interval_s"),
    )


def peaks(fixes: DataFrame) -> DataFrame:
    """(flight_id, peak_climb, peak_sink): the extremes of vario, 0 where it never climbs or sinks."""
    return fixes.groupBy("flight_id").agg(F.greatest(F.max("vario"), F.lit(0.0)).alias("peak_climb"), F.least(F.min("vario"), F.lit(0.0)).alias("peak_sink"))


def index_at(fixes: DataFrame, times: DataFrame) -> DataFrame:
    """times (flight_id, at) with the first idx whose t is at or after `at`; the number of fixes where there is none."""
    w = W.partitionBy("flight_id").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = fixes.select("flight_id", F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("at")).unionByName(times.select("flight_id", F.col("at").alias("_t"), F.lit(0).alias("_side"), "at"))
    return marked.withColumn("idx", F.sum("_side").over(w)).where("_side = 0").select("flight_id", "at", "idx").distinct()
