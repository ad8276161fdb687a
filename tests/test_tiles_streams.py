import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.operators import lookup, sites, tiles
from skytrace.streaming import live, queue
from tests.sequential_routes import haversine_km


def long_form(spark, arrays):
    rows = [(z, x, y, i, j, float(a[i, j])) for (z, x, y), a in arrays.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "z int, x int, y int, row int, col int, value double")


def back(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault((r.z, r.x, r.y), np.full(shape, np.nan))[r.row, r.col] = r.value
    return out


def test_pyramid(spark):
    rng = np.random.default_rng(1)
    leaf = {(2, x, y): rng.random((4, 4)) for x, y in ((0, 0), (1, 0), (0, 1), (3, 3))}
    got = back(tiles.pyramid(long_form(spark, leaf), 4, 0, 2), (4, 4))
    whole = np.zeros((16, 16))
    for (_, x, y), a in leaf.items():
        whole[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = a
    halve = lambda a: a.reshape(len(a) // 2, 2, -1, 2).mean(axis=(1, 3))
    one = halve(whole)
    assert set(got) == {(0, 0, 0), (1, 0, 0), (1, 1, 1), *leaf}
    assert np.allclose(got[1, 0, 0], one[:4, :4]) and np.allclose(got[1, 1, 1], one[4:, 4:]) and np.allclose(got[0, 0, 0], halve(one))


def test_resample_by_area(spark):
    a = np.random.default_rng(2).random((6, 10))
    w = lambda n, m: np.array([[max(0, min((i + 1) * m / n, j + 1) - max(i * m / n, j)) for i in range(n)] for j in range(m)])
    want = w(6, 4) @ a @ w(10, 3).T
    got = back(tiles.resample(long_form(spark, {(0, 0, 0): a}), 6, 10, 4, 3), (4, 3))[0, 0, 0]
    assert np.allclose(got, want)


def test_deltas_round_trip(spark):
    a = np.random.default_rng(3).integers(0, 300, (5, 7)).astype(float)
    df = long_form(spark, {(0, 0, 0): a, (1, 0, 1): a * 2})
    d = tiles.deltas(df)
    first = {(r.row, r.col): r.delta for r in d.where("z = 0").collect()}
    assert first[0, 0] == a[0, 0] and first[2, 0] == a[2, 0] - a[1, 0] and first[2, 3] == a[2, 3] - a[2, 2]
    got = back(tiles.undeltas(d.drop("value")), (5, 7))
    assert np.allclose(got[0, 0, 0], a) and np.allclose(got[1, 0, 1], a * 2)


def test_samples(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, -5.0), (3, None), (4, 40_000.0), (5, 20.0)], "i int, v double")
    assert [r.e for r in df.orderBy("i").select(tiles.elevation(F.col("v")).alias("e")).collect()] == [0, 0, 0, 32_767, 20]
    df = spark.createDataFrame([(128, 0, 128, 255, 0.5), (0, 0, 0, 0, -32_768.0)], "r int, g int, b int, a int, want double")
    assert all(r.m == r.want for r in df.select(tiles.terrarium(*map(F.col, "rgba")).alias("m"), "want").collect())


def test_nearest_sites_over_the_date_line_and_poles(spark):
    import random

    from tests.sequential_routes import haversine_km

    r = random.Random(5)
    place = lambda k: (k, r.choice([8_990_000, -8_950_000, 0, 4_600_000]) + r.randint(-9_000, 9_000), r.choice([17_999_000, -17_999_000, 0]) + r.randint(-999, 999))
    points, there = [place(k) for k in range(150)], [place(k) for k in range(60)]
    got = sites.nearest_site(spark.createDataFrame(points, "id long, lat_e5 int, lon_e5 int"), spark.createDataFrame(there, "site_id long, lat_e5 int, lon_e5 int"), "id", 5_000)
    for row in got.collect():
        _, a, o = points[row.id]
        best = min((float(haversine_km(a, o, b, p)) * 1000, s) for s, b, p in there)
        assert row.site_id == (best[1] if best[0] <= 5_000 else None)


def test_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 1800), (1, 3601), (2, 100)]
    df = spark.createDataFrame(rows, "flight_id long, s long").select("flight_id", F.timestamp_seconds("s").alias("at"))
    got = sorted((r.flight_id, r.n) for r in live.sessions(df).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
    df.unionByName(spark.createDataFrame([(9, 10_000_000)], "flight_id long, s long").select("flight_id", F.timestamp_seconds("s").alias("at"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.flight_id, r.n) for r in spark.table("sessions").where("flight_id < 9").collect()) == got


def test_rollover_stream(spark, tmp_path):
    times = [86_000, 86_399, 5, 100, 86_399, 3]
    for k in (0, 3):
        spark.createDataFrame([(1, i, times[i]) for i in range(k, k + 3)], "flight_id long, n long, s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("flight_id long, n long, s long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.rolled_over(stream).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.t for r in spark.table("rolled").orderBy("n").collect()]
    assert got == [86_000, 86_399, 86_405, 86_500, 86_400 + 86_399, 2 * 86_400 + 3]


def test_queue_scores_each_file_once(spark, tmp_path):
    schema = "flight_id long, at long, v long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: queue.score_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: queue.newest(b, "flight_id", "at")).awaitTermination(120)
    put([(1, 1, 10), (1, 2, 20), (2, 1, 5)])
    go()
    put([(3, 1, 7)])
    go()
    go()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.flight_id, r.v, r.batch) for r in got.collect()) == [(1, 20, 0), (2, 5, 0), (3, 7, 1)]


def test_regions_and_bounds(spark):
    rows = [(0.5, 2.5, 0, 3), (1.0000000001, 2.0, 1, 1), (-0.1, 1.0, None, None), (9.0, 10.5, None, None)]
    df = spark.createDataFrame(rows, "low double, high double, first long, count long")
    got = df.select(tiles.pixel_region(F.col("low"), F.col("high"), F.lit(0.0), F.lit(1.0), F.lit(10)).alias("r"), "first", "count").collect()
    assert [None if r.r is None else (r.r[0], r.r[1]) for r in got] == [(0, 3), (1, 1), None, None]
    b = spark.range(1).select(tiles.tile_bounds(F.lit(1), F.lit(1), F.lit(0)).alias("b")).first().b
    assert (round(b.west, 6), round(b.south, 6), round(b.east, 6)) == (0, 0, 180) and 85 < b.north < 85.1
    assert [r.z for r in spark.createDataFrame([(0.30,), (1.5,), (400.0,)], "p double").select(tiles.leaf_zoom(F.col("p")).alias("z")).collect()] == [2, 0, 0]


def test_written_tiles_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(z, x, 3, "p") for z in (1, 2) for x in range(70)], "z int, x int, y int, p string")
    tiles.write_tiles(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 140 and back.where("z = 2 and block_x = 1").count() == 6


def put_in_order(spark, folder, name, batches, **how):
    """What fixes_in_order tells of batches of (flight_id, n, t, sent in s), each a file."""
    schema = "flight_id long, n long, t long, sent timestamp"
    for batch in batches:
        rows = spark.createDataFrame(batch, "flight_id long, n long, t long, s long")
        rows.select("flight_id", "n", "t", F.timestamp_seconds("s").alias("sent")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    live.fixes_in_order(stream, **how).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return sorted((r.flight_id, r.n, r.t, r.segment) for r in spark.table(name).collect())


def kept_by_a_loop(times):
    """(n, t, segment): from each kept record the next one is the first later one of the four behind it, or the very next on a new timeline."""
    rows = [(n, t) for n, t in enumerate(times) if n == 0 or t != times[n - 1]]
    at, segment, out = 0, 0, []
    while at < len(rows):
        out.append((*rows[at], segment))
        behind = range(at + 1, min(at + 5, len(rows)))
        later = [k for k in behind if rows[k][1] > rows[at][1]]
        if not later and len(behind) < 4:
            break
        at, segment = (later[0], segment) if later else (at + 1, segment + 1)
    return out


def test_fixes_in_any_order_by_brute_force(spark, tmp_path):
    r = random.Random(4)
    logs = {f: [r.choice([k, k, k, k - 3]) - 200 * (k // 20 % 3 == 1) for k in range(n)] for f, n in ((1, 120), (2, 5), (3, 1), (4, 60))}
    rows = [(f, n, t, 1_000 + n) for f, log in logs.items() for n, t in enumerate(log)]
    r.shuffle(rows)
    got = put_in_order(spark, tmp_path, "any_order", [rows[:90], rows[90:] + rows[:20] + [(None, 0, 1, 1), (1, None, 1, 1)]], late="10 hours")
    assert got == sorted((f, *x) for f, log in logs.items() for x in kept_by_a_loop(log))
    assert max(x[3] for x in got) > 0


def test_missing_fixes_are_waited_for_and_given_up(spark, tmp_path):
    first = [(1, 0, 10, 100), (1, 2, 30, 102), (2, 1, 20, 101)]
    second = [(1, 1, 20, 103), (1, 3, 40, 104), (9, 0, 1, 5_000)]
    third = [(1, 4, 50, 4_990), (9, 1, 2, 5_001)]
    fourth = [(2, 0, 10, 4_991), (2, 2, 30, 4_992), (9, 2, 3, 9_000)]
    got = put_in_order(spark, tmp_path, "waited", [first, second, third, fourth], wait_s=600, late="1 minute")
    assert [x[:3] for x in got if x[0] == 1] == [(1, n, 10 * n + 10) for n in range(5)]
    assert [x[:3] for x in got if x[0] == 2] == [(2, 1, 20), (2, 2, 30)]  # its record 0 came when it had been given up


def test_neighbouring_flights_share_a_row_of_state(spark, tmp_path):
    """A call costs Spark far more than a flight's records, so 64 ids share one; each flight is told as if alone."""
    r = random.Random(6)
    logs = {f: [r.choice([k, k, k - 3]) for k in range(r.randrange(1, 9))] for f in range(-70, 130)}
    rows = [(f, n, t, 1_000 + n) for f, log in logs.items() for n, t in enumerate(log)]
    r.shuffle(rows)
    for part in (rows[:500], rows[500:]):
        df = spark.createDataFrame(part, "flight_id long, n long, t long, s long")
        df.select("flight_id", "n", "t", F.timestamp_seconds("s").alias("sent")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/shared")
    stream = spark.readStream.schema("flight_id long, n long, t long, sent timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/shared")
    query = live.fixes_in_order(stream, late="10 hours").writeStream.format("memory").queryName("shared").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((x.flight_id, x.n, x.t, x.segment) for x in spark.table("shared").collect())
    assert got == sorted((f, *x) for f, log in logs.items() for x in kept_by_a_loop(log))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({f >> 6 for f in logs}) == 5


def test_a_scorer_that_raises_fails_its_flight_alone(spark, tmp_path):
    schema, bad = "flight_id long, v long", {7, 23}

    def raising(batch):
        def one(pdf):
            if set(pdf.flight_id) & bad:
                raise ValueError(f"no route for {pdf.flight_id[0]}")
            return pdf

        return batch.groupBy("flight_id").applyInPandas(one, schema)

    spark.createDataFrame([(f, v) for f in range(30) for v in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    queue.score_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), raising).awaitTermination(300)
    assert sorted((r.flight_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(f, v) for f in range(30) if f not in bad for v in range(3)]
    failed = {r.flight_id: (r.attempts, r.error, r.batch) for r in spark.read.parquet(str(tmp_path / "out_failed")).collect()}
    assert failed == {f: (2, f"ValueError: no route for {f}", 0) for f in bad}


def test_job_lifecycle_timers(spark, tmp_path):
    batches = [
        [(1, 1, "queued"), (1, 1, "queued"), (1, 5, "running"), (2, 1, "running"), (3, 2, "queued"), (3, 3, "running")],
        [(1, 9, "failed"), (3, 4, "done"), (9, 500, "queued")],
        [(9, 501, "running")],
        [(1, 520, "running"), (1, 521, "failed"), (9, 1_200, "done")],
        [(9, 9_000, "queued")],
    ]
    for k, batch in enumerate(batches):
        rows = spark.createDataFrame([(f, s, 10 * k + i, e, f"at {s}" if e == "failed" else None) for i, (f, s, e) in enumerate(batch)], "flight_id long, s long, n long, event string, error string")
        rows.select("flight_id", F.timestamp_seconds("s").alias("at"), "n", "event", "error").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("flight_id long, at timestamp, n long, event string, error string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    queue.lifecycle(stream, most_attempts=2, retry_s=60, stall_s=600, late="10 seconds").writeStream.format("memory").queryName("jobs").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    got = [(r.flight_id, r.s, r.state, r.attempts, r.error) for r in spark.table("jobs").withColumn("s", F.unix_seconds("at")).orderBy("flight_id", "s").collect()]
    assert [x for x in got if x[0] == 1] == [(1, 1, "queued", 0, None), (1, 5, "running", 1, None), (1, 9, "failed", 1, "at 9"), (1, 69, "queued", 1, "at 9"), (1, 520, "running", 2, "at 9"), (1, 521, "failed", 2, "at 521")]
    assert [x for x in got if x[0] in (2, 3)] == [(3, 2, "queued", 0, None), (3, 3, "running", 1, None), (3, 4, "done", 1, None)]
    assert [x[1:4] for x in got if x[0] == 9] == [(500, "queued", 0), (501, "running", 1), (1_101, "queued", 1), (1_200, "done", 1)]


def test_nearest_site_where_sites_are_crowded(spark, monkeypatch):
    """Crowded sites are met within parts of the radius; far points still find theirs, and places with several sites give the smallest id."""
    rng = random.Random(8)
    there = [(i, 4_600_000 + rng.randrange(0, 300), 1_300_000 + rng.randrange(0, 300)) for i in range(3_000)]
    points = [(i, 4_600_000 + rng.randrange(-3_000, 3_000), 1_300_000 + rng.randrange(-4_000, 4_000)) for i in range(150)] + [(1_000 + i, *there[-1 - i][1:]) for i in range(50)]
    radii, within = [], sites._within
    monkeypatch.setattr(sites, "_within", lambda points, places, key, radius_m, site_key: radii.append(radius_m) or within(points, places, key, radius_m, site_key))
    got = {r.id: (r.site_id, r.distance_m) for r in sites.nearest_site(spark.createDataFrame(points, "id long, lat_e5 int, lon_e5 int"), spark.createDataFrame(there, "site_id long, lat_e5 int, lon_e5 int"), "id", 2_500).collect()}
    assert len(radii) > 2 and radii == sorted(radii) and radii[-1] == 2_500
    for k, lat, lon in points:
        d = haversine_km(*(np.array(x) for x in (lat, lon, [s[1] for s in there], [s[2] for s in there]))) * 1000
        if d.min() <= 2_500:
            assert got[k][1] == pytest.approx(d.min(), abs=1e-6) and got[k][0] == int(np.flatnonzero(d <= d.min() + 1e-9)[0])
        else:
            assert got[k] == (None, None)


def test_nearest_fix_of_short_and_long_flights(spark):
    """Points of short flights are sent once, those of long ones go by the grid; a flight without fixes has none."""
    rng = random.Random(9)
    own = [(f, i, 4_600_000 + rng.randrange(0, 500), 1_300_000 + rng.randrange(0, 900)) for f, n in ((1, 5), (2, lookup.WHOLE_FIXES), (3, 700)) for i in range(n)]
    points = [(k, k % 4 + 1, 4_600_000 + rng.randrange(-200, 700), 1_300_000 + rng.randrange(-200, 1_100)) for k in range(400)]
    fixes = spark.createDataFrame([*own, (1, 99, None, None)], "flight_id long, idx long, lat_e5 int, lon_e5 int")
    found = lookup.nearest_fix(fixes, spark.createDataFrame(points, "point_id long, flight_id long, lat_e5 int, lon_e5 int"))
    got = {r.point_id: r.idx for r in found.collect()}
    for k, f, lat, lon in points:
        assert got[k] == min(((a - lat) ** 2 + (o - lon) ** 2, i) for g, i, a, o in own if g == f)[1] if f < 4 else got[k] is None
    short = lookup.nearest_fix(fixes.where("flight_id < 3"), spark.createDataFrame(points, "point_id long, flight_id long, lat_e5 int, lon_e5 int"))
    assert "Generate" not in short._jdf.queryExecution().optimizedPlan().toString()
