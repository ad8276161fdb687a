"""Queries for charts, maps and lookups, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions import gliders
from skytrace.operators import charts, lookup, series, tiles
from skytrace.plans.tables import FIXES, fixes, haversine_sql, table
from skytrace.sources import catalog

QUERIES, SQL = {}, {}
DAY = 86_400


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _windows(f: DataFrame) -> DataFrame:
    """From a tenth to nine tenths of each flight."""
    return f.groupBy("flight_id").agg(F.count("*").alias("n_fixes")).select("flight_id", "n_fixes", F.expr("n_fixes div 10").alias("takeoff_idx"), F.expr("n_fixes * 9 div 10").alias("landing_idx"))


_WINDOWS = "win AS (SELECT flight_id, count(*) AS n_fixes, count(*) // 10 AS takeoff_idx, count(*) * 9 // 10 AS landing_idx FROM fixes GROUP BY 1)"


@query(f"""WITH {FIXES}, {_WINDOWS}, v AS (SELECT *, first_value(t) OVER w AS t1, first_value(alt_dm) OVER w AS z1, last_value(t) OVER w AS t2, last_value(alt_dm) OVER w AS z2 FROM fixes
  WINDOW w AS (PARTITION BY flight_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING)),
f AS (SELECT v.flight_id, v.t, CASE WHEN t2 > t1 THEN (z2 - z1)::DOUBLE / 10 / (t2 - t1) ELSE 0 END AS vario, row_number() OVER p AS i, count(*) OVER (PARTITION BY v.flight_id) AS n
  FROM v JOIN win USING (flight_id) WHERE idx BETWEEN takeoff_idx AND landing_idx WINDOW p AS (PARTITION BY v.flight_id ORDER BY idx))
SELECT flight_id, CASE WHEN n <= 20 THEN i - 1 ELSE CAST(ceil(i * 20.0 / n) - 1 AS BIGINT) END AS bucket, round(avg(t), 3) AS t, round(avg(vario), 9) AS vario FROM f GROUP BY 1, 2""")
def climb_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climb of each flight as 20 points."""
    f = fixes(spark, sf_dir)
    return charts.climb_series(f, _windows(f), DAY, 20).select("flight_id", "bucket", F.round("t", 3).alias("t"), F.round("vario", 9).alias("vario"))


_SPEEDS = f"""{FIXES}, {_WINDOWS}, e AS (SELECT f.*, event_id % 90 AS tas_kmh, takeoff_idx, landing_idx, first_value(t) OVER w AS t1, first_value(lat_e5) OVER w AS a1, first_value(lon_e5) OVER w AS o1, last_value(t) OVER w AS t2, last_value(lat_e5) OVER w AS a2, last_value(lon_e5) OVER w AS o2
  FROM fixes f JOIN win USING (flight_id) WINDOW w AS (PARTITION BY f.flight_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING)),
near AS (SELECT *, CASE WHEN t2 > t1 THEN {haversine_sql("a1", "o1", "a2", "o2")} / (t2 - t1) * 3.6 ELSE 0 END AS ground_kmh FROM e WHERE idx BETWEEN takeoff_idx - 60 AND landing_idx + 60),
lagged AS (SELECT *, t - lag(t) OVER w AS dt, {haversine_sql("lag(lat_e5) OVER w", "lag(lon_e5) OVER w", "lat_e5", "lon_e5")} AS step FROM near WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
own AS (SELECT *, coalesce(last_value(CASE WHEN dt > 0 THEN step / dt * 3.6 END IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS kmh FROM lagged),
path AS (SELECT *, CASE WHEN dt IS NULL THEN coalesce(lead(kmh) OVER (PARTITION BY flight_id ORDER BY idx), 0) ELSE kmh END AS path_kmh FROM own)"""


@query(f"""WITH {_SPEEDS}, sm AS (SELECT *, avg(path_kmh) OVER w AS path_s, avg(tas_kmh) OVER w AS tas_s FROM path WINDOW w AS (PARTITION BY flight_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING)),
i AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY flight_id) AS n FROM sm WHERE idx BETWEEN takeoff_idx AND landing_idx)
SELECT flight_id, CASE WHEN n <= 20 THEN i - 1 ELSE CAST(ceil(i * 20.0 / n) - 1 AS BIGINT) END AS bucket, round(avg(t), 3) AS t, round(avg(ground_kmh), 6) AS ground_kmh, round(avg(path_s), 6) AS path_kmh, round(avg(tas_s), 6) AS tas_kmh FROM i GROUP BY 1, 2""")
def speed_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds of each flight as 20 points."""
    f = fixes(spark, sf_dir).withColumn("tas_kmh", F.expr("event_id % 90"))
    return charts.speed_series(f, _windows(f), DAY, 20).select("flight_id", "bucket", F.round("t", 3).alias("t"), *[F.round(c, 6).alias(c) for c in ("ground_kmh", "path_kmh", "tas_kmh")])


@query(f"""WITH {FIXES}, {_WINDOWS} SELECT f.flight_id, idx, t, round(CAST(alt_dm / 10.0::DOUBLE * 3.280839895::DOUBLE AS FLOAT)::DOUBLE, 3) AS gps, CASE WHEN f.flight_id % 2 = 0 THEN round(CAST((alt_dm + 57) / 10.0::DOUBLE * 3.280839895::DOUBLE AS FLOAT)::DOUBLE, 3) END AS baro,
round(CAST(idx * 3.280839895::DOUBLE AS FLOAT)::DOUBLE, 3) AS ground FROM fixes f JOIN win USING (flight_id) WHERE idx BETWEEN takeoff_idx AND landing_idx""")
def altitude_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitudes of every fix in flight, and of the ground, in feet."""
    f = fixes(spark, sf_dir).withColumn("pressure_dm", F.when(F.col("flight_id") % 2 == 0, F.col("alt_dm") + 57)).withColumn("ground_m", F.col("idx"))
    found = charts.altitude_series(f, _windows(f), "ft", "ground_m")
    return found.select("flight_id", "idx", "t", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("gps", "baro", "ground")])


_TEXTS = f"""{_SPEEDS}, c AS (SELECT p.*, v.share FROM path p, (VALUES (0.0), (0.25), (1.0)) v(share) WHERE idx = CAST(floor(takeoff_idx + share * (landing_idx - takeoff_idx) + 0.5) AS BIGINT)),
x AS (SELECT flight_id, CAST(share AS DOUBLE) AS share, idx, strftime(to_timestamp(t + 3600) AT TIME ZONE 'UTC', '%H:%M:%S') AS time, CASE WHEN flight_id % 3 > 0 THEN floor(alt_dm / 10.0::DOUBLE + 0.5)::BIGINT || ' m' END AS gps,
  CASE WHEN flight_id % 3 > 0 AND flight_id % 2 = 0 THEN floor((alt_dm + 57) / 10.0::DOUBLE + 0.5)::BIGINT || ' m' END AS baro, floor(path_kmh + 0.5)::BIGINT || ' km/h' AS path_speed, floor(ground_kmh + 0.5)::BIGINT || ' km/h' AS speed, floor(tas_kmh + 0.5)::BIGINT || ' km/h' AS tas,
  CASE WHEN flight_id % 3 > 0 THEN CASE WHEN idx % 7 < 3 THEN '−' WHEN idx % 7 > 3 THEN '+' ELSE '' END || printf('%.1f', abs(idx % 7 - 3)::DOUBLE) END AS vario FROM c)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).withColumn("tas_kmh", F.expr("event_id % 90")).withColumn("pressure_dm", F.when(F.col("flight_id") % 2 == 0, F.col("alt_dm") + 57)).withColumn("vario", (F.col("idx") % 7 - 3).cast("double"))
    w = _windows(f)
    near = series.ground_speed_kmh(f, DAY).join(w.select("flight_id", "takeoff_idx", "landing_idx"), "flight_id").where(F.col("idx").between(F.col("takeoff_idx") - 60, F.col("landing_idx") + 60)).drop("takeoff_idx", "landing_idx")
    values = series.path_speed_kmh(near).withColumn("offset_s", F.lit(3600)).withColumn("has_altitude", F.col("flight_id") % 3 > 0)
    at = charts.readout(values, w.withColumn("share", F.explode(F.array(*map(F.lit, (0.0, 0.25, 1.0))))))
    return charts.readout_texts(at.drop("event_id", "lat_e5", "lon_e5"))


@query(f"WITH {_TEXTS} SELECT * FROM x")
def cursor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that three cursors of each flight show."""
    return _texts(spark, sf_dir)


@query(f"WITH {_TEXTS} SELECT flight_id, max(length(gps))::INT AS gps, max(length(baro))::INT AS baro, max(length(path_speed))::INT AS path_speed, max(length(vario))::INT AS vario FROM x GROUP BY 1")
def cursor_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest labels of each flight's cursors."""
    return charts.label_widths(_texts(spark, sf_dir), ["gps", "baro", "path_speed", "vario"])


@query(f"""WITH {FIXES}, {_WINDOWS}, seg AS (SELECT flight_id, CAST(k - 5 AS INT) AS bucket, takeoff_idx + k * 4 AS start_idx, takeoff_idx + k * 4 + 3 AS end_idx FROM win, range(12) r(k)),
lines AS (SELECT flight_id, -1 AS colour, 0 AS start_idx, takeoff_idx AS end_idx, 0 AS part FROM win WHERE takeoff_idx > 0 UNION ALL
  SELECT flight_id, least(greatest(bucket + 5, 0), 10), start_idx, least(end_idx + 1, n_fixes - 1), 1 FROM seg JOIN win USING (flight_id) UNION ALL SELECT flight_id, -1, landing_idx, n_fixes - 1, 2 FROM win WHERE landing_idx < n_fixes - 1)
SELECT flight_id, colour, start_idx, end_idx, (row_number() OVER (PARTITION BY flight_id ORDER BY part, start_idx, end_idx, colour))::INT AS run FROM lines""")
def map_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one colour of each flight's line."""
    w = _windows(fixes(spark, sf_dir))
    seg = w.select("flight_id", "takeoff_idx", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("flight_id", (F.col("k") - 5).alias("bucket"), (F.col("takeoff_idx") + F.col("k") * 4).alias("start_idx"), (F.col("takeoff_idx") + F.col("k") * 4 + 3).alias("end_idx"))
    return charts.map_runs(w, seg)


@query(f"""WITH {FIXES}, {_WINDOWS}, cur AS (SELECT flight_id, share, CAST(floor(takeoff_idx + share * (landing_idx - takeoff_idx) + 0.5) AS BIGINT) AS idx FROM win, (VALUES (0.0), (0.25), (1.0)) v(share))
SELECT c.flight_id, CAST(c.share AS DOUBLE) AS share, c.idx, f.t, f.alt_dm FROM cur c JOIN fixes f ON f.flight_id = c.flight_id AND f.idx = c.idx""")
def cursor_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and altitude under three cursors of each flight."""
    f = fixes(spark, sf_dir)
    cursors = _windows(f).withColumn("share", F.explode(F.array(*map(F.lit, (0.0, 0.25, 1.0)))))
    return charts.readout(f, cursors).select("flight_id", "share", "idx", "t", "alt_dm")


@query(f"""WITH {FIXES}, {_WINDOWS} SELECT f.flight_id, f.idx, round(CASE WHEN landing_idx > takeoff_idx THEN (f.idx - takeoff_idx) / (landing_idx - takeoff_idx)::DOUBLE ELSE 0 END, 9) AS share FROM fixes f JOIN win USING (flight_id) WHERE f.idx BETWEEN takeoff_idx AND landing_idx""")
def fix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each fix lies within its flight, from 0 at takeoff to 1 at landing."""
    f = fixes(spark, sf_dir)
    within = f.join(_windows(f).select("flight_id", "takeoff_idx", "landing_idx"), "flight_id").where("idx between takeoff_idx and landing_idx")
    share = charts.share_of(F.col("idx"), F.col("takeoff_idx"), F.col("landing_idx"))
    return within.select("flight_id", "idx", F.round(share, 9).alias("share"))


@query(f"""WITH {FIXES}, p AS (SELECT user_id AS flight_id, event_id AS point_id, CAST(4590000 + (event_id * 31) % 40000 AS INT) AS lat_e5, CAST(1290000 + (event_id * 57) % 50000 AS INT) AS lon_e5 FROM events)
SELECT p.point_id, p.flight_id, arg_min(f.idx, (CAST(f.lat_e5 - p.lat_e5 AS BIGINT) * (f.lat_e5 - p.lat_e5) + CAST(f.lon_e5 - p.lon_e5 AS BIGINT) * (f.lon_e5 - p.lon_e5), f.idx)) AS idx FROM p JOIN fixes f ON f.flight_id = p.flight_id GROUP BY 1, 2""")
def nearest_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix of a flight nearest to each of many points."""
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("flight_id"), F.expr("int(4590000 + event_id * 31 % 40000)").alias("lat_e5"), F.expr("int(1290000 + event_id * 57 % 50000)").alias("lon_e5"))
    return lookup.nearest_fix(fixes(spark, sf_dir), points).select("point_id", "flight_id", "idx")


@query(f"""WITH {FIXES}, g AS (SELECT *, CAST(floor((lon_e5 / 1e5 / 360 + 0.5) * 65536) AS BIGINT) AS gx, CAST(floor((0.5 - asinh(tan(radians(lat_e5 / 1e5))) / (2 * pi())) * 65536) AS BIGINT) AS gy FROM fixes)
SELECT flight_id, idx, CASE WHEN (gx // 16 + gy // 16) % 3 > 0 THEN CAST((gx * 7 + gy * 13) % 900 AS DOUBLE) END AS elevation_m FROM g""")
def ground_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground below each fix; some tiles are missing."""
    f = fixes(spark, sf_dir)
    x, y = F.sequence(F.lit(2_190), F.lit(2_204)), F.sequence(F.lit(1_446), F.lit(1_462))
    grid = spark.range(1).select(F.explode(x).alias("x"), F.lit(0).alias("_")).withColumn("y", F.explode(y)).where("(x + y) % 3 > 0")
    value = lambda i: (((F.col("x") * 16 + i % 16) * 7 + (F.col("y") * 16 + F.floor(i / 16)) * 13) % 900).cast("double")
    made = grid.select(F.lit(12).alias("z"), "x", "y", F.transform(F.sequence(F.lit(0), F.lit(255)), value).alias("px"))
    return lookup.ground_elevation(f, made, 12, 16).select("flight_id", "idx", "elevation_m")


@query("""SELECT p_partkey AS id, CASE WHEN b & 1 <> 0 THEN 'pg' WHEN b & 6 <> 0 THEN 'hg' WHEN b & 8 <> 0 THEN 'sp' WHEN b & 16 <> 0 THEN 'pg' ELSE 'other' END AS kind,
CASE WHEN b & 80 <> 0 THEN 'powered' ELSE 'free' END AS propulsion, CASE p_size % 9 WHEN 2 THEN 'winch' WHEN 4 THEN 'aerotow' ELSE 'foot' END AS launch,
CASE WHEN b & 1 <> 0 OR (b & 14 = 0 AND b & 16 <> 0) THEN CASE WHEN c & 256 <> 0 THEN 'en_d' WHEN c & 128 <> 0 THEN 'en_c' WHEN c & 64 <> 0 THEN 'en_b' WHEN c & 1 <> 0 THEN 'en_a' ELSE 'unknown' END
  WHEN b & 6 <> 0 THEN CASE WHEN b & 4 <> 0 THEN 'rigid' WHEN p_size % 3 = 1 THEN 'kingpost' WHEN p_size % 3 = 2 THEN 'topless' ELSE 'unknown' END ELSE 'unknown' END AS class
FROM (SELECT *, CAST(p_partkey % 128 AS INT) AS b, CAST(p_partkey * 7 % 512 AS INT) AS c FROM part)""")
def legacy_gliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, classes and launches from bit fields."""
    bits, cert, size = F.expr("int(p_partkey % 128)"), F.expr("int(p_partkey * 7 % 512)"), F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), gliders.legacy_kind(bits).alias("kind"), gliders.legacy_propulsion(bits).alias("propulsion"), gliders.legacy_launch(size % 9).alias("launch"), gliders.legacy_class(bits, cert, size % 3).alias("class"))


@query("""SELECT 'pg' AS kind, p_brand AS brand, CASE WHEN p_type = 'ECONOMY' THEN 'en_b' END AS class, p_name AS name, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type, p_name FROM part) GROUP BY ALL""")
def catalog_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of all brands, written as JSON and read again."""
    key = F.when(F.col("p_type") == "ECONOMY", "en-b").otherwise(F.col("p_type"))
    classes = table(spark, sf_dir, "part").groupBy("p_brand", key.alias("key")).agg(F.collect_set("p_name").alias("names")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("key", "names"))).alias("classes"))
    json = classes.select(F.lit("pg").alias("kind"), F.to_json(F.create_map("p_brand", "classes")).alias("json"))
    return catalog.models(json).groupBy("kind", "brand", "class", "name").agg(F.count("*").alias("n"))


@query(f"""WITH {FIXES}, b AS (SELECT flight_id, min(lon_e5) / 1e5 AS west, min(lat_e5) / 1e5 AS south, max(lon_e5) / 1e5 AS east, max(lat_e5) / 1e5 AS north FROM fixes GROUP BY 1),
t AS (SELECT flight_id, floor((west / 360 + 0.5) * 1024) AS x0, ceil((east / 360 + 0.5) * 1024) - 1 AS x1, floor((0.5 - asinh(tan(radians(north))) / (2 * pi())) * 1024) AS y0, ceil((0.5 - asinh(tan(radians(south))) / (2 * pi())) * 1024) - 1 AS y1 FROM b)
SELECT flight_id, 10 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM t, range(0, 1024) a(x), range(0, 1024) c(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def flight_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that each flight's bounds reach into."""
    e5 = lambda f, c: (f(c) / 1e5)
    bounds = fixes(spark, sf_dir).groupBy("flight_id").agg(e5(F.min, "lon_e5").alias("west"), e5(F.min, "lat_e5").alias("south"), e5(F.max, "lon_e5").alias("east"), e5(F.max, "lat_e5").alias("north"))
    return tiles.tiles_over(bounds, 10).select("flight_id", "z", "x", "y")
