"""The entities that the operators work on, as views of the test tables: the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of flights, from events by user."""
    events = table(spark, sf_dir, "events")
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(
        F.col("user_id").alias("flight_id"), idx.cast("long").alias("idx"), "event_id", t.alias("t"),
        (4_600_000 + F.pmod(F.col("event_id") * 7919, F.lit(20_000))).cast("int").alias("lat_e5"),
        (1_300_000 + F.pmod(F.col("event_id") * 104_729, F.lit(30_000))).cast("int").alias("lon_e5"),
        F.floor(F.col("value") * 10).cast("int").alias("alt_dm"),
    )


FIXES = """fixes AS (SELECT user_id AS flight_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(4600000 + (event_id * 7919) % 20000 AS INT) AS lat_e5,
  CAST(1300000 + (event_id * 104729) % 30000 AS INT) AS lon_e5, CAST(floor(value * 10) AS INT) AS alt_dm FROM events)"""

#: SQL of the great-circle distance; arguments are E5 expressions.
HAVERSINE = "(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({c} / 1e5) - radians({a} / 1e5)) / 2), 2) + cos(radians({a} / 1e5)) * cos(radians({c} / 1e5)) * pow(sin((radians({d} / 1e5) - radians({b} / 1e5)) / 2), 2)))))"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


def flat_sql(a: str, b: str, c: str, d: str) -> str:
    return f"(6371000.0 * sqrt(pow((radians({d} / 1e5) - radians({b} / 1e5)) * cos((radians({a} / 1e5) + radians({c} / 1e5)) / 2), 2) + pow(radians({c} / 1e5) - radians({a} / 1e5), 2)))"


def igc_e5_sql(c: str) -> str:
    """SQL of an E5 value written in thousandths of a minute and read again."""
    return f"CASE WHEN {c} < 0 THEN -1 ELSE 1 END * (abs({c}) // 100000 * 100000 + (CAST(round(abs({c}) % 100000 * 0.6) AS BIGINT) * 5 + 1) // 3)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites, from suppliers."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("site_id"), (4_600_000 + F.pmod(key * 1_009, F.lit(20_000))).cast("int").alias("lat_e5"), (1_300_000 + F.pmod(key * 3_001, F.lit(30_000))).cast("int").alias("lon_e5"))


SITES = "sites AS (SELECT s_suppkey AS site_id, CAST(4600000 + (s_suppkey * 1009) % 20000 AS INT) AS lat_e5, CAST(1300000 + (s_suppkey * 3001) % 30000 AS INT) AS lon_e5 FROM supplier)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights along a path: each event of a user is a step of some 15 s, up to 250 m and 12 m of height from the fix before it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    key = F.col("event_id")
    walk = lambda times, of, less: F.sum(F.pmod(key * times, F.lit(of)) - less).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("flight_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "event_id",
        (F.lit(1_700_000_000) + F.col("user_id") * 86_400 + walk(17, 13, -9)).alias("t"),
        (4_600_000 + walk(7_919, 401, 195)).cast("int").alias("lat_e5"), (1_300_000 + walk(104_729, 601, 290)).cast("int").alias("lon_e5"), (15_000 + walk(31, 241, 119)).cast("int").alias("geo_dm"),
    )
    return rows.withColumn("pressure_dm", F.lit(None).cast("int"))


_WALK = "sum((event_id * {}) % {} - {}) OVER w"
PATHS = f"""paths AS (SELECT user_id AS flight_id, row_number() OVER w - 1 AS idx, event_id, CAST(1700000000 + user_id * 86400 + {_WALK.format(17, 13, "(-9)")} AS BIGINT) AS t, CAST(4600000 + {_WALK.format(7919, 401, 195)} AS INT) AS lat_e5,
  CAST(1300000 + {_WALK.format(104729, 601, 290)} AS INT) AS lon_e5, CAST(15000 + {_WALK.format(31, 241, 119)} AS INT) AS geo_dm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
