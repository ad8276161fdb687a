"""Queries over whole flights (cleaning, detection, simplification, routes), with their SQL: recursion and brute force over few fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators import charts, cleaning, detection, distance, outline, scoring, segments, series, triangles
from skytrace.plans.tables import PATHS, flat_sql, haversine_sql, paths

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- cleaning ---------------------------------------------------------------------------------------------------------------------

_JUMPS = f"""{PATHS}, raw AS (SELECT flight_id, idx, CASE WHEN event_id % 29 = 3 THEN t - 40 ELSE t END AS t, CASE WHEN event_id % 23 = 5 THEN lat_e5 + 90000 ELSE lat_e5 END AS lat_e5, lon_e5 FROM paths)"""


def _jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with fixes far off and with times that run backward here and there."""
    return paths(spark, sf_dir).select("flight_id", "idx", F.expr("if(event_id % 29 = 3, t - 40, t)").alias("t"), F.expr("if(event_id % 23 = 5, lat_e5 + 90000, lat_e5)").alias("lat_e5"), "lon_e5")


_REACH = "{b}.t > {a}.t AND " + flat_sql("{a}.lat_e5", "{a}.lon_e5", "{b}.lat_e5", "{b}.lon_e5") + " / ({b}.t - {a}.t) < 277.78"


@query(f"""WITH RECURSIVE {_JUMPS}, pair AS (SELECT a.flight_id, a.idx AS i, b.idx AS j, {_REACH.format(a="a", b="b")} AS fits FROM raw a JOIN raw b ON b.flight_id = a.flight_id AND b.idx > a.idx),
head AS (SELECT r.flight_id, max(r.idx) AS last, CASE WHEN max(r.idx) > 1 AND NOT bool_or(p.i = 0 AND p.j = 1 AND p.fits) AND bool_or(p.i = 1 AND p.j = 2 AND p.fits) THEN 1 ELSE 0 END AS begin_ FROM raw r LEFT JOIN pair p ON p.flight_id = r.flight_id AND p.i < 2 AND p.j = p.i + 1 GROUP BY 1),
kept AS (SELECT flight_id, begin_::BIGINT AS idx FROM head UNION ALL SELECT k.flight_id, (SELECT min(p.j) FROM pair p WHERE p.flight_id = k.flight_id AND p.i = k.idx AND p.fits) FROM kept k WHERE k.idx IS NOT NULL)
SELECT flight_id, idx FROM kept WHERE idx IS NOT NULL""")
def plausible_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that can be reached from the last one kept."""
    return cleaning.plausible_fixes(_jumps(spark, sf_dir))


@query(f"""WITH {PATHS}, raw AS (SELECT flight_id, idx, CASE WHEN event_id % 29 < 3 THEN t - event_id % 60 ELSE t END AS t FROM paths), l AS (SELECT *, lag(t) OVER (PARTITION BY flight_id ORDER BY idx) AS p FROM raw),
runs AS (SELECT a.flight_id, a.idx, coalesce(min(b.idx) FILTER (WHERE b.t > a.p), max(b.idx) + 1) - a.idx AS n FROM l a JOIN raw b ON b.flight_id = a.flight_id AND b.idx >= a.idx WHERE a.t < a.p GROUP BY 1, 2)
SELECT f.flight_id, coalesce(max(n), 0) > 3 AS shifted FROM (SELECT DISTINCT flight_id FROM raw) f LEFT JOIN runs USING (flight_id) GROUP BY 1""")
def shifted_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights in which time runs backward for long."""
    return cleaning.shifted_flights(paths(spark, sf_dir).withColumn("t", F.expr("if(event_id % 29 < 3, t - event_id % 60, t)")))


@query()
def cleaned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks without slips and jumps, cut to the longest flight: tests hold them against a plain program."""
    f = paths(spark, sf_dir).drop("event_id").withColumn("t", F.expr("if(idx > 40, t + 2000, t)"))
    return cleaning.cleaned(f)


# --- takeoff and landing ----------------------------------------------------------------------------------------------------------

_STAY, _CHANGE, _RIGHT, _WRONG = "ln(0.9995::DOUBLE)", "ln((1 - 0.9995)::DOUBLE)", "ln(0.8::DOUBLE)", "ln((1 - 0.8)::DOUBLE)"
#: Slow stretches and stops for the detectors: every third step of some flights stands still.
_SLOW = f"""{PATHS}, f AS (SELECT flight_id, idx, t, CASE WHEN flight_id % 3 = 0 THEN lat_e5 // 4 + 3450000 WHEN idx % 40 < 12 THEN 4600000 + (idx // 40 * 900)::INT ELSE lat_e5 END AS lat_e5, CASE WHEN flight_id % 3 = 0 THEN lon_e5 // 4 + 975000 WHEN idx % 40 < 12 THEN 1300000 ELSE lon_e5 END AS lon_e5,
  CASE WHEN idx % 40 < 12 THEN 15000 + (idx % 2)::INT ELSE geo_dm END AS geo_dm, max(idx) OVER (PARTITION BY flight_id) AS last FROM paths)"""


def _slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, stop = "flight_id % 3 = 0", "idx % 40 < 12"
    return paths(spark, sf_dir).select("flight_id", "idx", "t", F.expr(f"int(case when {third} then lat_e5 div 4 + 3450000 when {stop} then 4600000 + idx div 40 * 900 else lat_e5 end)").alias("lat_e5"), F.expr(f"int(case when {third} then lon_e5 div 4 + 975000 when {stop} then 1300000 else lon_e5 end)").alias("lon_e5"), F.expr(f"int(if({stop}, 15000 + idx % 2, geo_dm))").alias("geo_dm"), "pressure_dm")


_SPEED = f"""s AS (SELECT *, t - lag(t) OVER w AS dt, {haversine_sql("lag(lat_e5) OVER w", "lag(lon_e5) OVER w", "lat_e5", "lon_e5")} AS m FROM f WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
e0 AS (SELECT flight_id, idx, t, last, dt > 0 AND m * 3.6 > 15.0 * greatest(dt, 1) AS fast FROM s), e AS (SELECT flight_id, idx, t, last, coalesce(fast, lead(fast) OVER (PARTITION BY flight_id ORDER BY idx)) AS fast FROM e0),
v AS (SELECT flight_id, idx, last, ln(0.8::DOUBLE) + CASE WHEN fast THEN {_WRONG} ELSE {_RIGHT} END AS a, ln(0.2::DOUBLE) + CASE WHEN fast THEN {_RIGHT} ELSE {_WRONG} END AS b, 0 AS ca, 0 AS cb FROM e WHERE idx = 0 AND last > 0
  UNION ALL SELECT v.flight_id, e.idx, e.last, greatest(a + {_STAY}, b + {_CHANGE}) + CASE WHEN fast THEN {_WRONG} ELSE {_RIGHT} END, greatest(a + {_CHANGE}, b + {_STAY}) + CASE WHEN fast THEN {_RIGHT} ELSE {_WRONG} END,
  CASE WHEN a + {_STAY} < b + {_CHANGE} THEN 1 ELSE 0 END, CASE WHEN a + {_CHANGE} < b + {_STAY} THEN 1 ELSE 0 END FROM v JOIN e ON e.flight_id = v.flight_id AND e.idx = v.idx + 1),
p AS (SELECT flight_id, idx, CASE WHEN b >= a THEN 1 ELSE 0 END AS state FROM v WHERE idx = last UNION ALL SELECT p.flight_id, p.idx - 1, CASE WHEN p.state = 1 THEN v.cb ELSE v.ca END FROM p JOIN v ON v.flight_id = p.flight_id AND v.idx = p.idx WHERE p.idx > 0),
st AS (SELECT p.flight_id, p.idx, p.state, e.t, e.last, CASE WHEN p.state IS DISTINCT FROM lag(p.state) OVER w THEN 1 ELSE 0 END AS new FROM p JOIN e USING (flight_id, idx) WINDOW w AS (PARTITION BY p.flight_id ORDER BY p.idx)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM st),
ru AS (SELECT flight_id, run, min(idx) AS lo, min(t) AS t0, any_value(state) AS state, lead(min(t)) OVER (PARTITION BY flight_id ORDER BY run) AS t1 FROM rn GROUP BY 1, 2),
fl AS (SELECT rn.flight_id, rn.idx, rn.last, CASE WHEN ru.state = 0 AND ru.run > 1 AND ru.t1 IS NOT NULL AND ru.t1 - ru.t0 < 300 THEN 1 ELSE rn.state END AS up FROM rn JOIN ru USING (flight_id, run)),
ed AS (SELECT *, lag(up) OVER (PARTITION BY flight_id ORDER BY idx) AS was FROM fl),
by_speed AS (SELECT flight_id, min(idx) FILTER (WHERE up = 1) AS takeoff_idx, coalesce(max(idx) FILTER (WHERE up = 0 AND was = 1), any_value(last)) AS landing_idx FROM ed GROUP BY 1 HAVING bool_or(up = 1))"""


@query(f"WITH RECURSIVE {_SLOW}, {_SPEED} SELECT flight_id, takeoff_idx, landing_idx FROM by_speed")
def speed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takeoff and landing by the likeliest states of a hidden Markov model of speeds."""
    return detection.speed_windows(_slow(spark, sf_dir))


_ALTITUDE = f"""st0 AS (SELECT *, t - lag(t) OVER w AS dt, coalesce({flat_sql("lag(lat_e5) OVER w", "lag(lon_e5) OVER w", "lat_e5", "lon_e5")}, 0) AS m, (geo_dm / 10.0::DOUBLE - lag(geo_dm) OVER w / 10.0::DOUBLE) AS dz FROM f WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
sp AS (SELECT flight_id, idx, t, last, m, coalesce(last_value(CASE WHEN dt > 0 THEN m / dt END IGNORE NULLS) OVER u, 0) AS h, abs(coalesce(last_value(CASE WHEN dt > 0 THEN dz / dt END IGNORE NULLS) OVER u, 0)) AS vv, sum(m) OVER u AS path FROM st0 WINDOW u AS (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT a.flight_id, a.idx, coalesce(max(b.idx) FILTER (WHERE b.t <= a.t - 5), 0) AS lo, coalesce(min(b.idx) FILTER (WHERE b.t >= a.t + 5), any_value(a.last)) AS hi FROM sp a JOIN sp b USING (flight_id) GROUP BY 1, 2),
sm AS (SELECT a.flight_id, a.idx, any_value(a.t) AS t, any_value(a.last) AS last, any_value(a.path) AS path, round(avg(b.h), 9) AS h, round(avg(b.vv), 9) AS v FROM sp a JOIN ra USING (flight_id, idx) JOIN sp b ON b.flight_id = a.flight_id AND b.idx BETWEEN ra.lo AND ra.hi GROUP BY 1, 2),
mk AS (SELECT *, idx < last AND h > 1.5 AND v > 0.05 AS goes, h > 5.0 AND v > 0.9 AS begins, idx < last AND h < 2.5 AND v < 0.1 AS slow FROM sm),
i1 AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER w AS grp, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER w AS sgrp FROM mk WINDOW w AS (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
g1 AS (SELECT flight_id, grp, min(idx) FILTER (WHERE begins) AS b, arg_min(t, idx) FILTER (WHERE begins) AS tb, max(idx) AS e, max(t) AS te FROM i1 WHERE goes GROUP BY 1, 2),
fly AS (SELECT i1.flight_id, i1.idx FROM i1 JOIN g1 USING (flight_id, grp) WHERE goes AND b IS NOT NULL AND te > tb + 60 AND idx >= b),
g2 AS (SELECT flight_id, sgrp FROM i1 WHERE slow GROUP BY 1, 2 HAVING max(t) > min(t) + 20), gr AS (SELECT i1.flight_id, i1.idx FROM i1 JOIN g2 USING (flight_id, sgrp) WHERE slow),
nx AS (SELECT m.flight_id, m.idx AS i, min(fly.idx) AS up FROM mk m JOIN fly ON fly.flight_id = m.flight_id AND fly.idx >= m.idx AND fly.idx < m.last GROUP BY 1, 2),
cand AS (SELECT nx.flight_id, nx.i, nx.up, coalesce((SELECT max(g.idx) FROM gr g WHERE g.flight_id = nx.flight_id AND g.idx <= nx.up), 0) AS takeoff, greatest(nx.up, least(coalesce((SELECT min(g.idx) FROM gr g WHERE g.flight_id = nx.flight_id AND g.idx >= nx.up), mk.last - 1), mk.last - 1)) AS landing FROM nx JOIN mk ON mk.flight_id = nx.flight_id AND mk.idx = nx.i),
wi AS (SELECT flight_id, takeoff, landing FROM cand WHERE i = 0 UNION ALL SELECT c.flight_id, c.takeoff, c.landing FROM wi JOIN cand c ON c.flight_id = wi.flight_id AND c.i = wi.landing + 1),
by_altitude AS (SELECT wi.flight_id, arg_max(takeoff, (round(b.path - a.path, 6), takeoff)) AS takeoff_idx, arg_max(landing, (round(b.path - a.path, 6), takeoff)) AS landing_idx FROM wi JOIN sm a ON a.flight_id = wi.flight_id AND a.idx = wi.takeoff JOIN sm b ON b.flight_id = wi.flight_id AND b.idx = wi.landing GROUP BY 1),
usable AS (SELECT flight_id, count(*) >= 5 AND max(geo_dm) - min(geo_dm) >= 100 AND count(DISTINCT geo_dm) >= 4 AS usable FROM f GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_SLOW}, {_SPEED}, {_ALTITUDE}, w AS (SELECT flight_id, CASE WHEN usable AND a.takeoff_idx IS NOT NULL THEN a.takeoff_idx ELSE s.takeoff_idx END AS takeoff_idx, CASE WHEN usable AND a.takeoff_idx IS NOT NULL THEN a.landing_idx ELSE s.landing_idx END AS landing_idx
  FROM usable LEFT JOIN by_altitude a USING (flight_id) LEFT JOIN by_speed s USING (flight_id))
SELECT w.*, x.t AS takeoff_t, y.t AS landing_t FROM w JOIN f x ON x.flight_id = w.flight_id AND x.idx = w.takeoff_idx JOIN f y ON y.flight_id = w.flight_id AND y.idx = w.landing_idx""")
def flight_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takeoff and landing of each flight, by altitudes where they tell, else by speeds."""
    return detection.flight_windows(_slow(spark, sf_dir))


# --- climb segments ---------------------------------------------------------------------------------------------------------------

_RUN = "{{'b': {b}, 's': {s}, 'e': {e}, 'st': {st}, 'et': {et}}}"


@query(f"""WITH RECURSIVE {PATHS}, e AS (SELECT *, first_value(t) OVER w AS t1, first_value(geo_dm) OVER w AS z1, last_value(t) OVER w AS t2, last_value(geo_dm) OVER w AS z2 FROM paths WINDOW w AS (PARTITION BY flight_id ORDER BY t RANGE BETWEEN 16 PRECEDING AND 16 FOLLOWING)),
b AS (SELECT *, CAST(greatest(least(floor(CASE WHEN t2 > t1 THEN (z2 - z1)::DOUBLE / 10 / (t2 - t1) ELSE 0 END * 2), 5), -5) AS INT) AS bucket FROM e),
n AS (SELECT *, CASE WHEN bucket IS NOT DISTINCT FROM lag(bucket) OVER w AND idx > 0 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY flight_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
l AS (SELECT flight_id, list({_RUN.format(b="bucket", s="s", e="e", st="st", et="et")} ORDER BY run) AS l FROM (SELECT flight_id, run, any_value(bucket) AS bucket, min(idx) AS s, max(idx) AS e, min(t) AS st, max(t) AS et FROM r GROUP BY 1, 2) GROUP BY 1),
ab AS (SELECT flight_id, l, 1 AS k, l[1:0] AS o FROM l UNION ALL SELECT flight_id, l, CASE WHEN joins THEN k + 2 ELSE k + 1 END, CASE WHEN joins THEN list_concat(o[1:len(o) - 1], [{_RUN.format(b="o[len(o)].b", s="o[len(o)].s", e="l[k + 1].e", st="o[len(o)].st", et="l[k + 1].et")}]) ELSE list_append(o, l[k]) END
  FROM (SELECT *, coalesce(len(o) > 0 AND k < len(l) AND o[len(o)].b = l[k + 1].b AND l[k].et - l[k].st <= 8, false) AS joins FROM ab WHERE k <= len(l))),
ds AS (SELECT flight_id, o AS l FROM ab WHERE k > len(l) UNION ALL SELECT flight_id, list_concat(list_concat(l[1:lo - 1 - p], [{_RUN.format(b="l[i].b", s="l[lo - p].s", e="l[hi + q].e", st="l[lo - p].st", et="l[hi + q].et")}]), l[hi + 1 + q:]) FROM (
  SELECT *, CASE WHEN lo > 1 AND l[lo - 1].b = l[i].b THEN 1 ELSE 0 END AS p, CASE WHEN hi < len(l) AND l[hi + 1].b = l[i].b THEN 1 ELSE 0 END AS q FROM (
  SELECT *, least(k, i) AS lo, greatest(k, i) AS hi FROM (SELECT *, CASE WHEN (CASE WHEN k > 1 THEN l[k - 1].et - l[k - 1].st ELSE -1 END) >= (CASE WHEN k < len(l) THEN l[k + 1].et - l[k + 1].st ELSE -1 END) THEN k - 1 ELSE k + 1 END AS i FROM (
  SELECT flight_id, l, list_position(list_transform(l, lambda x: x.et - x.st < 15), true) AS k FROM ds) WHERE k > 0 AND len(l) > 1)))),
done AS (SELECT flight_id, l FROM ds WHERE len(l) = 1 OR coalesce(list_position(list_transform(l, lambda x: x.et - x.st < 15), true), 0) = 0)
SELECT flight_id, x.b AS bucket, x.s AS start_idx, x.e AS end_idx, x.st AS start_t, x.et AS end_t FROM (SELECT flight_id, unnest(l) AS x FROM done)""")
def climb_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of climb without odd and short ones."""
    f = series.vario_ms(paths(spark, sf_dir), 16, "geo_dm")
    return segments.climb_segments(series.runs(f.withColumn("bucket", series.vario_bucket(F.col("vario") * 2)), "bucket"))


# --- simplification and hulls -----------------------------------------------------------------------------------------------------

_PLANE = f"""{PATHS}, rad AS (SELECT flight_id, idx, radians(lat_e5 / 1e5) AS a, radians(lon_e5 / 1e5) AS o FROM paths),
xy AS (SELECT flight_id, idx, 6371000.0::DOUBLE * (o - avg(o) OVER w) * cos(a) AS x, 6371000.0::DOUBLE * (a - avg(a) OVER w) AS y FROM rad WINDOW w AS (PARTITION BY flight_id))"""


def _rdp(tolerance: float, chord: float | None) -> str:
    """The ends of all stretches that a simplification halves."""
    mid = f"WHEN len2 > {chord}::DOUBLE * {chord} THEN (lo + hi) // 2" if chord else ""
    return f"""seg AS (SELECT flight_id, 0::BIGINT AS lo, max(idx)::BIGINT AS hi FROM xy GROUP BY 1 UNION ALL
  SELECT flight_id, unnest([lo, cut]), unnest([cut, hi]) FROM (SELECT flight_id, lo, hi, CASE WHEN far > {tolerance}::DOUBLE * {tolerance} THEN pos {mid} END AS cut FROM (
    SELECT flight_id, lo, hi, max(off) AS far, arg_max(idx, (off, -idx)) AS pos, any_value(len2) AS len2 FROM (
      SELECT *, pow(px - al * dx, 2) + pow(py - al * dy, 2) AS off FROM (SELECT *, CASE WHEN len2 > 0 THEN greatest(0, least(1, (px * dx + py * dy) / len2)) ELSE 0 END AS al FROM (
        SELECT s.flight_id, s.lo, s.hi, p.idx, p.x - a.x AS px, p.y - a.y AS py, b.x - a.x AS dx, b.y - a.y AS dy, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS len2
        FROM seg s JOIN xy p ON p.flight_id = s.flight_id AND p.idx > s.lo AND p.idx < s.hi JOIN xy a ON a.flight_id = s.flight_id AND a.idx = s.lo JOIN xy b ON b.flight_id = s.flight_id AND b.idx = s.hi))) GROUP BY 1, 2, 3)) WHERE cut IS NOT NULL),
kept AS (SELECT flight_id, lo AS idx FROM seg UNION SELECT flight_id, hi FROM seg)"""


@query(f"WITH RECURSIVE {_PLANE}, {_rdp(400.0, 3000.0)} SELECT flight_id, idx FROM kept")
def simplified_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that a simplification to 400 m with a chord cap of 3 km keeps."""
    return outline.simplified(paths(spark, sf_dir), 400.0, 3_000.0)


@query(f"""WITH RECURSIVE {_PLANE}, {_rdp(100.0, None)}, pt AS (SELECT DISTINCT flight_id, x, y FROM kept JOIN xy USING (flight_id, idx)),
edge AS (SELECT p.flight_id, p.x AS px, p.y AS py, q.x - p.x AS dx, q.y - p.y AS dy FROM pt p JOIN pt q ON q.flight_id = p.flight_id AND (q.x, q.y) <> (p.x, p.y) JOIN pt r ON r.flight_id = p.flight_id GROUP BY p.flight_id, p.x, p.y, q.x, q.y HAVING min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) >= -1e-6),
side AS (SELECT e.flight_id, e.dx, e.dy, (max(r.x * e.dx + r.y * e.dy) - min(r.x * e.dx + r.y * e.dy)) / sqrt(e.dx * e.dx + e.dy * e.dy) AS w, (max(r.y * e.dx - r.x * e.dy) - min(r.y * e.dx - r.x * e.dy)) / sqrt(e.dx * e.dx + e.dy * e.dy) AS h FROM edge e JOIN pt r USING (flight_id) GROUP BY e.flight_id, e.px, e.py, e.dx, e.dy)
SELECT f.flight_id, s.ratio AS aspect_ratio FROM (SELECT DISTINCT flight_id FROM paths) f LEFT JOIN (SELECT flight_id, round(arg_min(greatest(w, h) / least(w, h), w * h), 6) AS ratio FROM side GROUP BY 1) s USING (flight_id)""")
def aspect_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides' ratio of the smallest rectangle around each flight."""
    return outline.aspect_ratios(paths(spark, sf_dir)).withColumn("aspect_ratio", F.round("aspect_ratio", 6))


# --- routes -----------------------------------------------------------------------------------------------------------------------

_FCC = "sqrt(pow((111.13209 - 0.566605 * cos(2 * radians((a.lat_e5 + b.lat_e5) / 2e5)) + 0.0012 * cos(4 * radians((a.lat_e5 + b.lat_e5) / 2e5))) * (b.lat_e5 - a.lat_e5) / 1e5, 2) + pow((111.41513 * cos(radians((a.lat_e5 + b.lat_e5) / 2e5)) - 0.09455 * cos(3 * radians((a.lat_e5 + b.lat_e5) / 2e5)) + 0.00012 * cos(5 * radians((a.lat_e5 + b.lat_e5) / 2e5))) * (b.lon_e5 - a.lon_e5) / 1e5, 2))"
_WAYS = f"""{PATHS}, d AS (SELECT a.flight_id, a.idx AS i, b.idx AS j, {_FCC} AS d, {haversine_sql("a.lat_e5", "a.lon_e5", "b.lat_e5", "b.lon_e5")} AS m FROM paths a JOIN paths b ON b.flight_id = a.flight_id AND b.idx > a.idx),
w0 AS (SELECT flight_id, idx AS j, 0.0::DOUBLE AS v, [idx] AS way FROM paths), """ + ", ".join(f"w{k} AS (SELECT d.flight_id, d.j, max(v + d) AS v, list_append(arg_max(way, v + d), d.j) AS way FROM w{k - 1} w JOIN d ON d.flight_id = w.flight_id AND d.i = w.j GROUP BY 1, 2)" for k in range(1, 5)) + """,
fd AS (SELECT flight_id, arg_max(way, v) AS turns FROM w4 GROUP BY 1), fdm AS (SELECT flight_id, any_value(turns) AS turns, sum(floor(m + 0.5)) AS total FROM fd JOIN d USING (flight_id) WHERE list_position(turns, i) > 0 AND list_position(turns, j) = list_position(turns, i) + 1 GROUP BY 1)"""


@query(f"WITH {_WAYS} SELECT flight_id, array_to_string(turns, '-') AS turns, CAST(floor(total / 10 + 0.5) * 10 AS BIGINT) AS distance_m FROM fdm")
def free_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest way over five fixes of each flight; as every flight here has few fixes, the search has them all. Of equally long ones the
    SQL's arg_max takes the last on one thread, and any on several."""
    found = distance.free_distances(paths(spark, sf_dir), latest=True)
    return found.select("flight_id", F.array_join(F.transform("turns", lambda x: x.cast("string")), "-").alias("turns"), "distance_m")


_TRIANGLES = f"""{PATHS}, d AS (SELECT a.flight_id, a.idx AS i, b.idx AS j, {haversine_sql("a.lat_e5", "a.lon_e5", "b.lat_e5", "b.lon_e5")} / 1000 AS d FROM paths a JOIN paths b ON b.flight_id = a.flight_id AND b.idx >= a.idx),
c1 AS (SELECT *, min((d, i, j)) OVER (PARTITION BY flight_id, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS g FROM d), c2 AS (SELECT flight_id, i, j, d, min(g) OVER (PARTITION BY flight_id, j ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c1),
kinds AS (SELECT * FROM (VALUES ('free_triangle', 'olc_open', 0.2::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('free_triangle', 'olc_closed', 0.05, 0, 0), ('fai_triangle', 'olc_open', 0.2, 0.28, 1.4), ('fai_triangle', 'olc_closed', 0.05, 0.28, 1.4)) k(type, sub_type, most, share, km)),
tri AS (SELECT ab.flight_id, ab.i, ab.j, bc.j AS k, ab.d + bc.d + ca.d AS total, least(ab.d, bc.d, ca.d) AS least_, ca.g AS g FROM d ab JOIN d bc ON bc.flight_id = ab.flight_id AND bc.i = ab.j JOIN c2 ca ON ca.flight_id = ab.flight_id AND ca.i = ab.i AND ca.j = bc.j WHERE ab.j > ab.i AND bc.j > bc.i),
ok AS (SELECT flight_id, type, sub_type, i, j, k, total, g[1] AS gap, g FROM tri, kinds WHERE g[1] <= most * total AND least_ >= share * total AND least_ >= km AND total > g[1]),
best AS (SELECT flight_id, type, sub_type, arg_max({{'i': i, 'j': j, 'k': k, 'total': total, 'gap': gap, 'q': g[2], 'w': g[3]}}, total - gap) AS b FROM ok GROUP BY 1, 2, 3)"""
_TRIANGLES = _TRIANGLES.replace("min((d, i, j))", "min({'d': d, 'i': i, 'j': j})").replace("g[1]", "g.d").replace("g[2]", "g.i").replace("g[3]", "g.j")


@query(f"WITH {_TRIANGLES} SELECT flight_id, type, sub_type, round(b.total, 6) AS perimeter_km, round(b.gap, 6) AS gap_km FROM best")
def best_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best triangle of each flight, shape and gap."""
    found = triangles.best_triangles(paths(spark, sf_dir))
    return found.select("flight_id", "type", "sub_type", F.round("perimeter_km", 6).alias("perimeter_km"), F.round("gap_km", 6).alias("gap_km"))


@query(f"""WITH {_TRIANGLES}, o AS (SELECT flight_id, b FROM best WHERE type = 'free_triangle' AND sub_type = 'olc_open')
SELECT flight_id, 'free_triangle' AS type, leg, role, from_idx, to_idx FROM (SELECT flight_id, unnest([0, 1, 2, 3]) AS leg, unnest(['scored', 'scored', 'closing', 'auxiliary']) AS role, unnest([b.i, b.j, b.k, b.w]) AS from_idx, unnest([b.j, b.k, b.i, b.q]) AS to_idx FROM o)""")
def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of each flight's best open triangle."""
    return charts.route_legs(triangles.best_triangles(paths(spark, sf_dir), {"olc_open": 0.2}, {"free_triangle": (0.0, 0.0)}))


@query(f"""WITH {_TRIANGLES}, o AS (SELECT flight_id, b FROM best WHERE type = 'free_triangle' AND sub_type = 'olc_open'), p AS (SELECT flight_id, unnest([0, 1, 2]) AS k, unnest([b.i, b.j, b.k]) AS idx FROM o)
SELECT flight_id, 'free_triangle' AS type, '[' || string_agg('{{"type":"point","fix":{{"idx":' || idx || ',"lat":' || lat_e5 || ',"lon":' || lon_e5 || '}}}}', ',' ORDER BY k) || ']' AS turnpoints FROM p JOIN paths USING (flight_id, idx) GROUP BY 1""")
def route_turnpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnpoints of each flight's best open triangle as JSON."""
    f = paths(spark, sf_dir)
    return charts.turnpoints_json(triangles.best_triangles(f, {"olc_open": 0.2}, {"free_triangle": (0.0, 0.0)}), f)


@query()
def scored_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free distance and triangles of each flight as they score; tests hold them against a plain program."""
    return scoring.scored_routes(paths(spark, sf_dir)).withColumn("score", F.round("score", 6))
