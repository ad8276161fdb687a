"""Queries over fixes, with their SQL. Test events lie hours apart, so windows are a day wide where the defaults are seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions import geo
from skytrace.operators import cleaning, series
from skytrace.plans.tables import FIXES, fixes, flat_sql, haversine_sql, table
from skytrace.storage import drained, replayed
from skytrace.streaming import live

QUERIES, SQL = {}, {}
DAY = 86_400


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_LAG = f"""{FIXES}, stepped AS (SELECT *, t - lag(t) OVER w AS dt, {haversine_sql("lag(lat_e5) OVER w", "lag(lon_e5) OVER w", "lat_e5", "lon_e5")} AS step,
  {flat_sql("lag(lat_e5) OVER w", "lag(lon_e5) OVER w", "lat_e5", "lon_e5")} AS flat FROM fixes WINDOW w AS (PARTITION BY flight_id ORDER BY idx))"""


@query(f"WITH {_LAG} SELECT flight_id, idx, round(step, 3) AS step_m, round(flat, 3) AS flat_m FROM stepped")
def step_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle and equirectangular metres from each fix's predecessor."""
    lag = lambda c: F.lag(c).over(series.in_order())
    f = fixes(spark, sf_dir)
    return f.select("flight_id", "idx", F.round(geo.haversine_m(lag("lat_e5"), lag("lon_e5"), "lat_e5", "lon_e5"), 3).alias("step_m"), F.round(geo.flat_distance_m(lag("lat_e5"), lag("lon_e5"), "lat_e5", "lon_e5"), 3).alias("flat_m"))


@query(f"""WITH {_LAG}, own AS (SELECT *, coalesce(last_value(CASE WHEN dt > 0 THEN step / dt * 3.6 END IGNORE NULLS) OVER w, 0) AS kmh FROM stepped
  WINDOW w AS (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT flight_id, idx, round(CASE WHEN dt IS NULL THEN coalesce(lead(kmh) OVER (PARTITION BY flight_id ORDER BY idx), 0) ELSE kmh END, 6) AS path_kmh FROM own""")
def path_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.path_speed_kmh(fixes(spark, sf_dir)).select("flight_id", "idx", F.round("path_kmh", 6).alias("path_kmh"))


_RANGE = "(PARTITION BY flight_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING)"


@query(f"""WITH {FIXES}, ends AS (SELECT *, first_value(t) OVER w AS t1, first_value(lat_e5) OVER w AS a1, first_value(lon_e5) OVER w AS o1, last_value(t) OVER w AS t2,
  last_value(lat_e5) OVER w AS a2, last_value(lon_e5) OVER w AS o2 FROM fixes WINDOW w AS {_RANGE})
SELECT flight_id, idx, round(CASE WHEN t2 > t1 THEN {haversine_sql("a1", "o1", "a2", "o2")} / (t2 - t1) * 3.6 ELSE 0 END, 6) AS ground_kmh FROM ends""")
def ground_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ground_speed_kmh(fixes(spark, sf_dir), DAY).select("flight_id", "idx", F.round("ground_kmh", 6).alias("ground_kmh"))


_VARIO = f"""{FIXES}, ends AS (SELECT *, first_value(t) OVER w AS t1, first_value(alt_dm) OVER w AS z1, last_value(t) OVER w AS t2, last_value(alt_dm) OVER w AS z2 FROM fixes WINDOW w AS {_RANGE}),
vario AS (SELECT *, 3600.0::DOUBLE * CASE WHEN t2 > t1 THEN (z2 - z1)::DOUBLE / 10 / (t2 - t1) ELSE 0 END AS vario FROM ends)"""


def _vario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climb per hour, as test events lie hours apart."""
    return series.vario_ms(fixes(spark, sf_dir), DAY).withColumn("vario", F.col("vario") * 3600)


@query(f"WITH {_VARIO} SELECT flight_id, idx, round(vario, 6) AS vario, CAST(greatest(least(floor(vario), 5), -5) AS INT) AS bucket FROM vario")
def vario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vario(spark, sf_dir).select("flight_id", "idx", F.round("vario", 6).alias("vario"), series.vario_bucket(F.col("vario")).alias("bucket"))


@query(f"""WITH {_VARIO}, b AS (SELECT *, CAST(greatest(least(floor(vario), 5), -5) AS INT) AS bucket FROM vario),
n AS (SELECT *, CASE WHEN bucket IS NOT DISTINCT FROM lag(bucket) OVER w AND idx > 0 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT flight_id, run::BIGINT AS run, min(bucket) AS bucket, min(idx) AS start_idx, max(idx) AS end_idx, min(t) AS start_t, max(t) AS end_t FROM r GROUP BY 1, 2""")
def vario_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of fixes in one climb bucket."""
    return series.runs(_vario(spark, sf_dir).withColumn("bucket", series.vario_bucket(F.col("vario"))), "bucket")


@query(f"WITH {_VARIO} SELECT flight_id, round(greatest(max(vario), 0), 6) AS peak_climb, round(least(min(vario), 0), 6) AS peak_sink FROM vario GROUP BY 1")
def peak_vario(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.peaks(_vario(spark, sf_dir))
    return found.select("flight_id", F.round("peak_climb", 6).alias("peak_climb"), F.round("peak_sink", 6).alias("peak_sink"))


@query(f"WITH {FIXES} SELECT flight_id, idx, round(avg(alt_dm) OVER {_RANGE}, 6) AS smooth FROM fixes")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(fixes(spark, sf_dir), "alt_dm", DAY).select("flight_id", "idx", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {FIXES}, n AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY idx) AS i, count(*) OVER (PARTITION BY flight_id) AS n FROM fixes)
SELECT flight_id, CASE WHEN n <= 15 THEN i - 1 ELSE CAST(ceil(i * 15.0 / n) - 1 AS BIGINT) END AS bucket, round(avg(alt_dm), 6) AS mean FROM n GROUP BY 1, 2""")
def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bucket_means(fixes(spark, sf_dir), "alt_dm", 15).select("flight_id", "bucket", F.round("mean", 6).alias("mean"))


@query(f"""WITH {_LAG} SELECT flight_id, count(*) AS n_fixes, min(lat_e5) AS min_lat_e5, max(lat_e5) AS max_lat_e5, min(lon_e5) AS min_lon_e5, max(lon_e5) AS max_lon_e5,
CAST(floor(min(alt_dm) / 10.0 + 0.5) AS BIGINT) AS min_alt_m, CAST(floor(max(alt_dm) / 10.0 + 0.5) AS BIGINT) AS max_alt_m, round(coalesce(sum(flat), 0), 3) AS path_m,
bool_or(alt_dm <> 0) AS has_altitude, count(alt_dm) >= 5 AND max(alt_dm) - min(alt_dm) >= 100 AND count(DISTINCT alt_dm) >= 4 AS altitude_usable,
least(greatest(coalesce(list_sort(list(dt) FILTER (WHERE dt IS NOT NULL))[(count(dt) // 2 + 1)::BIGINT], 1), 1), 65535) AS interval_s FROM stepped GROUP BY 1""")
def flight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.summary(fixes(spark, sf_dir)).withColumn("path_m", F.round("path_m", 3))


@query(f"""WITH {FIXES}, probes AS (SELECT DISTINCT flight_id, t0 + k * 200000 AS at_t FROM (SELECT flight_id, min(t) AS t0 FROM fixes GROUP BY 1), (VALUES (0), (3), (7), (20)) v(k))
SELECT p.flight_id, p.at_t AS probe, count(*) FILTER (WHERE f.t < p.at_t) AS idx FROM probes p JOIN fixes f USING (flight_id) GROUP BY 1, 2""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fix at or after some times of each flight."""
    f = fixes(spark, sf_dir)
    probes = f.groupBy("flight_id").agg(F.min("t").alias("t0")).select("flight_id", F.explode(F.array(*map(F.lit, (0, 3, 7, 20)))).alias("k"), "t0").select("flight_id", (F.col("t0") + F.col("k") * 200_000).alias("at"))
    return series.index_at(f, probes).withColumnRenamed("at", "probe")


@query(f"""WITH {FIXES}, w AS (SELECT flight_id, min(t) + 400000 AS a, max(t) - 400000 AS b FROM fixes GROUP BY 1)
SELECT f.flight_id, f.idx, f.t FROM fixes f JOIN w USING (flight_id) WHERE t BETWEEN a AND b""")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes from a stored takeoff to a stored landing."""
    f = fixes(spark, sf_dir)
    w = f.groupBy("flight_id").agg((F.min("t") + 400_000).alias("takeoff_t"), (F.max("t") - 400_000).alias("landing_t"))
    return cleaning.time_slice(f, w).select("flight_id", "idx", "t")


@query(f"""WITH {FIXES}, w AS (SELECT flight_id, min(t) + flight_id % 5 * 200000 AS a, max(t) - flight_id % 7 * 100000 AS b FROM fixes GROUP BY 1), k AS (SELECT flight_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM fixes JOIN w USING (flight_id) WHERE t BETWEEN a AND b GROUP BY 1)
SELECT w.flight_id, first_idx, last_idx, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no fixes between takeoff and landing' END AS error FROM w LEFT JOIN k USING (flight_id)""")
def slice_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fixes lie between takeoff and landing; a flight without any has an error."""
    f = fixes(spark, sf_dir)
    w = f.groupBy("flight_id").agg((F.min("t") + F.col("flight_id") % 5 * 200_000).alias("takeoff_t"), (F.max("t") - F.col("flight_id") % 7 * 100_000).alias("landing_t"))
    return cleaning.slice_bounds(f, w)


_SHUFFLED = f"{FIXES}, raw AS (SELECT flight_id, idx, lat_e5, lon_e5, alt_dm, t // 1000 * 1000 + CASE WHEN event_id % 50 = 7 THEN -900000 ELSE 0 END AS t FROM fixes)"


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with times that repeat and run backward here and there."""
    return fixes(spark, sf_dir).withColumn("t", F.expr("t div 1000 * 1000 + if(event_id % 50 = 7, -900000, 0)"))


@query(f"""WITH {_SHUFFLED}, one AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY idx) AS i FROM (SELECT *, lag(t) OVER (PARTITION BY flight_id ORDER BY idx) AS p FROM raw) WHERE p IS NULL OR p <> t)
SELECT flight_id, idx, t FROM (SELECT *, max(t) OVER (PARTITION BY flight_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM one) WHERE top IS NULL OR t > top""")
def forward_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes without those that repeat a time or run backward."""
    return cleaning.drop_backward(cleaning.drop_same_time(_shuffled(spark, sf_dir))).select("flight_id", "idx", "t")


@query(f"""WITH {_SHUFFLED} SELECT flight_id, idx, sum(back) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
FROM (SELECT *, CASE WHEN t < lag(t) OVER (PARTITION BY flight_id ORDER BY idx) THEN 1 ELSE 0 END AS back FROM raw)""")
def monotone_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.monotone_segments(_shuffled(spark, sf_dir)).select("flight_id", "idx", "segment")


@query(f"""WITH {FIXES} SELECT flight_id, idx, sum(gap) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY flight_id ORDER BY idx) > 43200 THEN 1 ELSE 0 END AS gap FROM fixes)""")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.gap_segments(fixes(spark, sf_dir), 43_200).select("flight_id", "idx", "segment")


@query(f"""WITH {FIXES}, r AS (SELECT flight_id, idx, lat_e5 // 8000 AS lat_e5, lon_e5 // 16000 AS lon_e5 FROM fixes)
SELECT flight_id, idx, lat_e5::BIGINT AS lat_e5, lon_e5::BIGINT AS lon_e5 FROM (SELECT *, lag(lat_e5) OVER w AS a, lag(lon_e5) OVER w AS o FROM r WINDOW w AS (PARTITION BY flight_id ORDER BY idx)) WHERE a IS NULL OR a <> lat_e5 OR o <> lon_e5""")
def moving_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes without those that repeat the position before; idx stays that of the whole track."""
    f = fixes(spark, sf_dir).select("flight_id", "idx", F.expr("lat_e5 div 8000").alias("lat_e5"), F.expr("lon_e5 div 16000").alias("lon_e5"))
    return cleaning.drop_same_place(f)


@query(f"""WITH {FIXES}, m AS (SELECT *, alt_dm < 1200 AS low FROM fixes), n AS (SELECT *, CASE WHEN low IS DISTINCT FROM lag(low) OVER (PARTITION BY flight_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
d AS (SELECT *, max(t) OVER (PARTITION BY flight_id, run) - min(t) OVER (PARTITION BY flight_id, run) AS length FROM r) SELECT flight_id, idx, low AND length > 40000 AS sustained FROM d""")
def sustained_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes within a run that holds a condition for long enough."""
    return cleaning.sustained(fixes(spark, sf_dir).withColumn("low", F.col("alt_dm") < 1200), "low", 40_000).select("flight_id", "idx", "sustained")


_BARO = f"""{FIXES}, own AS (SELECT *, CASE WHEN flight_id % 2 = 0 AND (flight_id % 4 > 0 OR idx > 3) THEN alt_dm + event_id % 40 END AS pressure_dm FROM fixes),
z AS (SELECT *, CASE WHEN count(pressure_dm) OVER (PARTITION BY flight_id) = count(*) OVER (PARTITION BY flight_id) THEN pressure_dm ELSE alt_dm END AS z FROM own),
e AS (SELECT *, first_value(t) OVER w AS t1, first_value(z) OVER w AS z1, last_value(t) OVER w AS t2, last_value(z) OVER w AS z2 FROM z WINDOW w AS {_RANGE})"""


@query(f"WITH {_BARO} SELECT flight_id, idx, round(CASE WHEN t2 > t1 THEN (z2 - z1)::DOUBLE / 10 / (t2 - t1) ELSE 0 END * 3600, 6) AS vario FROM e")
def barometric_vario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climb by the barometer where a whole flight has one, else by GPS."""
    pressure = F.when((F.col("flight_id") % 2 == 0) & ((F.col("flight_id") % 4 > 0) | (F.col("idx") > 3)), F.col("alt_dm") + F.col("event_id") % 40)
    f = series.with_best_altitude(fixes(spark, sf_dir).withColumn("pressure_dm", pressure))
    return series.vario_ms(f, DAY, "best_dm").select("flight_id", "idx", F.round(F.col("vario") * 3600, 6).alias("vario"))


@query(f"""WITH {FIXES}, r AS (SELECT flight_id, k AS range_id, k * 7 AS lo, k * 11 + 5 AS hi FROM (SELECT DISTINCT flight_id FROM fixes), range(6) v(k))
SELECT r.flight_id, range_id, min(lat_e5) AS min_lat_e5, max(lat_e5) AS max_lat_e5, min(lon_e5) AS min_lon_e5, max(lon_e5) AS max_lon_e5 FROM r JOIN fixes f ON f.flight_id = r.flight_id AND idx BETWEEN lo AND hi GROUP BY ALL""")
def range_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of ranges of fixes."""
    f = fixes(spark, sf_dir)
    ranges = f.select("flight_id").distinct().withColumn("range_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).select("flight_id", "range_id", (F.col("range_id") * 7).alias("lo"), (F.col("range_id") * 11 + 5).alias("hi"))
    return series.range_boxes(f, ranges)


@query(f"""WITH {FIXES}, c AS (SELECT DISTINCT flight_id FROM fixes ORDER BY flight_id DESC LIMIT 3) SELECT f.flight_id, c_name AS pilot, idx, t - min(t) OVER (PARTITION BY f.flight_id) AS since_s, alt_dm FROM fixes f JOIN c USING (flight_id) LEFT JOIN customer ON c_custkey = f.flight_id""")
def flights_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some flights side by side: who flew, and all fixes by the time since the first."""
    f = fixes(spark, sf_dir)
    ids = [r.flight_id for r in f.select("flight_id").distinct().orderBy(F.col("flight_id").desc()).limit(3).collect()]
    pilots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("flight_id"), F.col("c_name").alias("pilot"))
    return series.compared(f, pilots, ids).select("flight_id", "pilot", "idx", "since_s", "alt_dm")


# A log in which single records run backward, and a block of a hundred has another clock now and then.
_LOG_T = "{n} * 4 - CASE WHEN event_id % 50 = 7 THEN 900 ELSE 0 END - CASE WHEN {n} // 25 % 3 = 1 THEN 100000 ELSE 0 END - CASE WHEN event_id % 11 = 3 THEN 4 ELSE 0 END"


@query(f"""WITH RECURSIVE raw AS (SELECT user_id AS flight_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, event_id FROM events), timed AS (SELECT flight_id, n, CAST({_LOG_T.format(n="n")} AS BIGINT) AS t FROM raw),
one AS (SELECT flight_id, n, t, row_number() OVER (PARTITION BY flight_id ORDER BY n) AS i FROM (SELECT *, lag(t) OVER (PARTITION BY flight_id ORDER BY n) AS p FROM timed) WHERE p IS NULL OR p <> t),
hop AS (SELECT flight_id, n, t, i, CASE WHEN t1 > t THEN i + 1 WHEN t2 > t THEN i + 2 WHEN t3 > t THEN i + 3 WHEN t4 > t THEN i + 4 WHEN t4 IS NOT NULL THEN i + 1 END AS next, coalesce(greatest(t1, t2, t3, t4) <= t, false) AS split
  FROM (SELECT *, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3, lead(t, 4) OVER w AS t4 FROM one WINDOW w AS (PARTITION BY flight_id ORDER BY i))),
walk AS (SELECT flight_id, n, t, next, split, 0::BIGINT AS segment FROM hop WHERE i = 1 UNION ALL SELECT h.flight_id, h.n, h.t, h.next, h.split, w.segment + w.split::BIGINT FROM walk w JOIN hop h ON h.flight_id = w.flight_id AND h.i = w.next)
SELECT flight_id, n, t, segment FROM walk""")
def fixes_put_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of flights as a stream of files, dealt to them out of order: what is kept, with its timeline."""
    n, event = F.col("n"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("n"), "event_id", F.col("ts").cast("timestamp").alias("sent"))
    t = n * 4 - F.when(event % 50 == 7, 900).otherwise(0) - F.when(F.expr("n div 25 % 3 = 1"), 100_000).otherwise(0) - F.when(event % 11 == 3, 4).otherwise(0)
    feed = replayed(rows.select("flight_id", "n", t.cast("long").alias("t"), "sent").repartition(8, F.hash("n")), 3)
    return drained(live.fixes_in_order(feed, late="36500 days"))  # files of all times come in any order
