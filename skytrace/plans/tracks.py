"""Queries over whole tracks, codecs, tiles and sessions, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators import tiles
from skytrace.plans.tables import FIXES, fixes, igc_e5_sql, table
from skytrace.sources import codec, igc
from skytrace.streaming import live, queue

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes as the kernels want them. Test events lie hours apart: time runs a thousand times faster."""
    f = fixes(spark, sf_dir)
    return f.select("flight_id", "idx", F.expr("t div 1000").alias("t"), "lat_e5", "lon_e5", F.col("alt_dm").alias("geo_dm"), F.lit(None).cast("int").alias("pressure_dm"), F.expr("int(event_id % 90)").alias("tas_kmh"))


@query(f"WITH {FIXES} SELECT flight_id, idx, t // 1000 AS t, lat_e5, lon_e5, alt_dm AS geo_dm, CAST(NULL AS INT) AS pressure_dm, CAST(event_id % 90 AS INT) AS tas_kmh FROM fixes")
def compact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track encoded and decoded again."""
    return codec.decode(codec.encode(_tracks(spark, sf_dir)))


@query(f"""WITH {FIXES} SELECT flight_id, idx, 1_700_000_000 + t // 500 % 100_000_000 AS t, CAST({igc_e5_sql("lat_e5")} AS INT) AS lat_e5, CAST({igc_e5_sql("lon_e5")} AS INT) AS lon_e5,
CAST(alt_dm // 10 * 10 AS INT) AS geo_dm, CASE WHEN flight_id % 2 = 0 THEN CAST((alt_dm + 57) // 10 * 10 AS INT) END AS pressure_dm, CASE WHEN flight_id % 3 > 0 THEN CAST(event_id % 90 AS INT) END AS tas_kmh FROM fixes""")
def igc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track written as an IGC log and read again, over midnight where it comes, with a pressure for every other flight and TAS for
    two of three; the format keeps thousandths of a minute and whole metres."""
    pressure, tas = F.when(F.col("flight_id") % 2 == 0, F.col("alt_dm") + 57), F.when(F.col("flight_id") % 3 > 0, F.expr("int(event_id % 90)"))
    tracks = fixes(spark, sf_dir).select("flight_id", "idx", F.expr("1700000000 + t div 500 % 100000000").alias("t"), "lat_e5", "lon_e5", F.col("alt_dm").alias("geo_dm"), pressure.cast("int").alias("pressure_dm"), tas.alias("tas_kmh"))
    logs = igc.compose(tracks)
    lines = logs.select(F.col("flight_id").cast("string").alias("path"), F.posexplode(F.split("igc", "\n")).alias("n", "line"))
    return igc.parse(lines).select(F.col("path").cast("long").alias("flight_id"), "idx", "t", "lat_e5", "lon_e5", "geo_dm", "pressure_dm", "tas_kmh")


# --- tiles: each embedding is a tile of 8 x 8 pixels at zoom 10 ---------------------------------------------------------------------


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings").where("embedding is not null")
    placed = vec.select(F.lit(10).alias("z"), F.expr("int(vec_id % 1024)").alias("x"), F.expr("int(vec_id div 1024 % 1024)").alias("y"), F.transform("embedding", lambda v: F.round(v.cast("double") * 1000) + F.lit(0.0)).alias("px"), F.lit(8).alias("w"))
    return tiles.pixels(placed, "px", "w")


_PIXELS = """px AS (SELECT 10 AS z, CAST(vec_id % 1024 AS INT) AS x, CAST(vec_id // 1024 % 1024 AS INT) AS y, CAST((i - 1) // 8 AS INT) AS "row", CAST((i - 1) % 8 AS INT) AS col,
  round(embedding[i]::DOUBLE * 1000) + 0.0::DOUBLE AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) WHERE embedding IS NOT NULL)"""


@query(f"WITH {_PIXELS} SELECT z, x, y, \"row\" // 2 AS \"row\", col // 4 AS col, round(avg(value), 6) AS value FROM px GROUP BY ALL")
def tiles_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile on 4 x 2 cells."""
    return tiles.resample(_pixels(spark, sf_dir), 8, 8, 4, 2).withColumn("value", F.round("value", 6))


def _zoom_sql(below: str, name: str, z: int) -> str:
    """One zoom up from `below`: children side by side, missing ones 0."""
    return f"""{name}_cells AS (SELECT x, y, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS col FROM (SELECT DISTINCT x // 2 AS x, y // 2 AS y FROM {below}), range(64) r(i)),
{name}_up AS (SELECT x // 2 AS x, y // 2 AS y, CAST(("row" + y % 2 * 8) // 2 AS INT) AS "row", CAST((col + x % 2 * 8) // 2 AS INT) AS col, sum(value) / 4 AS value FROM {below} GROUP BY ALL),
{name} AS (SELECT {z} AS z, c.x, c.y, c."row", c.col, coalesce(u.value, 0) AS value FROM {name}_cells c LEFT JOIN {name}_up u ON u.x = c.x AND u.y = c.y AND u."row" = c."row" AND u.col = c.col)"""


@query(f"""WITH {_PIXELS}, {_zoom_sql("px", "nine", 9)}, {_zoom_sql("nine", "eight", 8)}, {_zoom_sql("eight", "seven", 7)}
SELECT z, x, y, "row", col, round(value, 6) AS value FROM (SELECT * FROM px UNION ALL SELECT * FROM nine UNION ALL SELECT * FROM eight UNION ALL SELECT * FROM seven)""")
def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles and those of three zooms up."""
    return tiles.pyramid(_pixels(spark, sf_dir), 8, 7, 10).withColumn("value", F.round("value", 6))


@query(f"""WITH {_PIXELS}, q AS (SELECT * REPLACE (greatest(CAST(round(value / 8) AS INT), 0)::DOUBLE AS value) FROM px)
SELECT z, x, y, "row", col, value - coalesce(lag(value) OVER (PARTITION BY x, y, "row" ORDER BY col), lag(value) OVER (PARTITION BY x, y, col ORDER BY "row"), 0) AS delta FROM q""")
def tile_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised elevations as differences from the neighbour."""
    quantised = _pixels(spark, sf_dir).withColumn("value", tiles.quantised(F.col("value")).cast("double"))
    return tiles.deltas(quantised).select("z", "x", "y", "row", "col", "delta")


@query(f"WITH {_PIXELS} SELECT z, x, y, count(*) AS n, sum(value) AS total FROM px GROUP BY ALL")
def tile_deltas_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of every tile after deltas and back."""
    back = tiles.undeltas(tiles.deltas(_pixels(spark, sf_dir)).drop("value"))
    return back.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- streams ----------------------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS flight_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_t, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_t, count(*) AS n FROM s GROUP BY user_id, session""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of fixes with no gap over twelve hours; the same plan serves a stream."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight_id"), F.col("ts").cast("timestamp").alias("at"))
    return live.sessions(events, "12 hours").select("flight_id", F.unix_seconds("start").alias("start_t"), F.unix_seconds("end").alias("end_t"), "n")


@query("SELECT user_id AS flight_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest job of each flight."""
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight_id"), F.struct("ts", "event_id").alias("at"), "event_type")
    return queue.newest(jobs, "flight_id", "at").select("flight_id", "event_type")
