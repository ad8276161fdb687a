"""A compact form of tracks: most fixes as four small differences, and only some as they are.

A fix is kept whole where it is the first or where a difference from the one before doesn't fit a signed byte; its time is kept
where it isn't one interval after the last. The interval of a track is the upper median of its time steps. Encoding and decoding
are window functions over the fixes of a flight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.operators.series import in_order

VALUES = ("lat_e5", "lon_e5", "geo_dm", "pressure_dm")
# Fixed values of the 32-bit FNV-1a digest.
FNV_START, FNV_TIMES = 0x811C9DC5, 0x01000193


def encode(fixes: DataFrame) -> DataFrame:
    """(flight_id, idx, interval_s, whole, time_fix, d_lat_e5, ... or lat_e5, ..., tas_kmh). pressure_dm and tas_kmh are null for a
    whole track or for none of its fixes; ValueError at run time otherwise."""
    flight = W.partitionBy("flight_id")
    step = F.col("t") - F.lag("t").over(in_order())
    rows = fixes.withColumn("_step", step)
    # The upper median from how often a flight has each step: no list of them is ever held.
    times = rows.where("_step is not null").groupBy("flight_id", "_step").agg(F.count("*").alias("_times"))
    upto = F.sum("_times").over(flight.orderBy("_step").rowsBetween(W.unboundedPreceding, 0))
    ranked = times.withColumn("_upto", upto).withColumn("_all", F.sum("_times").over(flight)).where(F.col("_upto") > F.floor(F.col("_all") / 2))
    medians = ranked.groupBy("flight_id").agg(F.min("_step").alias("_median"))
    rows = rows.join(medians, "flight_id", "left")
    interval = F.least(F.greatest(F.coalesce("_median", F.lit(1)), F.lit(1)), F.lit(65_535))
    for name in ("pressure_dm", "tas_kmh"):
        n = F.count(name).over(flight)
        rows = rows.withColumn(name, F.when((n > 0) & (n < F.count("*").over(flight)), F.raise_error(F.lit(f"{name} is missing from some fixes"))).otherwise(F.col(name)).cast("int"))
    rows = rows.withColumn("interval_s", interval)
    for v in VALUES:
        rows = rows.withColumn(f"d_{v}", F.col(v) - F.lag(v).over(in_order()))
    small = reduce(Column.__and__, [F.coalesce(F.col(f"d_{v}").between(-128, 127), F.lit(v == "pressure_dm")) for v in VALUES])
    rows = rows.withColumn("whole", F.col("_step").isNull() | ~small)
    kept = [F.when(F.col("whole"), F.col(v)).alias(v) for v in VALUES]
    near = [F.when(~F.col("whole"), F.col(f"d_{v}")).cast("tinyint").alias(f"d_{v}") for v in VALUES]
    time_fix = F.when(F.col("_step").isNull() | (F.col("_step") != F.col("interval_s")), F.col("t"))
    return rows.select("flight_id", "idx", F.col("interval_s").cast("int").alias("interval_s"), "whole", time_fix.alias("time_fix"), *kept, *near, "tas_kmh")


def decode(encoded: DataFrame) -> DataFrame:
    """The fixes that encode() was given: (flight_id, idx, t, lat_e5, lon_e5, geo_dm, pressure_dm, tas_kmh)."""
    up_to = in_order().rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(in_order())
    rows = encoded.withColumn("_n", place).withColumn("_run", F.sum(F.col("whole").cast("int")).over(up_to))
    anchor = F.last(F.when(F.col("time_fix").isNotNull(), F.struct("time_fix", "_n")), ignorenulls=True).over(up_to)
    rows = rows.withColumn("_anchor", anchor)
    run = W.partitionBy("flight_id", "_run").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    t = F.col("_anchor.time_fix") + (F.col("_n") - F.col("_anchor._n")) * F.col("interval_s")
    return rows.select("flight_id", "idx", t.alias("t"), *[F.sum(F.coalesce(v, F.col(f"d_{v}").cast("int"))).over(run).cast("int").alias(v) for v in VALUES], "tas_kmh")


def fnv1a(data: Column) -> Column:
    """The 32-bit FNV-1a digest of bytes, as a long."""
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_TIMES).bitwiseAND(0xFFFFFFFF))


def etag(data: Column) -> Column:
    """Sixteen hex digits that name a blob. XXH64 with Spark's seed, as Spark has no XXH3."""
    return F.lpad(F.lower(F.hex(F.xxhash64(data))), 16, "0")
