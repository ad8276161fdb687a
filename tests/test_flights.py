"""Cleaning, detection, climb segments and routes, against documented cases and brute force."""

import itertools
import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from skytrace import plans
from skytrace.operators import charts, cleaning, detection, distance, outline, scoring, segments, series, triangles
from skytrace.plans.tables import PATHS
from tests import sequential
from tests import sequential_routes as routes

FIXES = "flight_id long, idx long, t long, lat_e5 int, lon_e5 int, geo_dm int, pressure_dm int"


def frame(t, lat, lon, geo=None):
    n = len(t)
    return pd.DataFrame({"idx": range(n), "t": t, "lat_e5": lat, "lon_e5": lon, "geo_dm": geo if geo is not None else [0] * n, "pressure_dm": [None] * n})


def leg(t0, n, lon0=0, step=20):
    """1 Hz at about 15 m/s."""
    return frame(list(range(t0, t0 + n)), [4_700_000] * n, [lon0 + step * i for i in range(n)])


def glue(*parts):
    f = pd.concat(parts, ignore_index=True)
    return f.assign(idx=range(len(f)))


def still(t0, n, lon=0):
    return leg(t0, n, lon, 0)


def tracks():
    """Tracks by name, each with what is known of it."""
    out = {"steady": leg(1000, 400)}
    out["slips"] = leg(1000, 400)
    out["slips"].loc[100, "t"] = out["slips"].loc[99, "t"]
    out["slips"].loc[200, "t"] = 1010
    out["far"] = leg(1000, 400)
    out["far"].loc[50:54, "lat_e5"] = 5_500_000
    out["odd start"] = leg(1000, 400)
    out["odd start"].loc[0, "lat_e5"] = 5_500_000
    out["never back"] = leg(1000, 60)
    out["never back"].loc[40:, "lat_e5"] = [5_500_000 + 1_000_000 * (k % 3) for k in range(20)]
    out["shifted"] = glue(leg(5000, 300, 8_000), leg(1000, 400))
    out["pieces"] = glue(*[leg(9000 - 900 * k, 100) for k in range(7)])
    out["wide gap"], out["gap"] = (glue(leg(1000, 200), leg(t, 600, 4_000)) for t in (1200 + 1801, 1199 + 1800))
    out["speed"] = glue(still(0, 400), leg(400, 900), still(1300, 400, 18_000))
    out["still"], out["one"] = still(0, 600), still(0, 1)
    out["stop"] = glue(leg(0, 600), still(600, 200, 12_000), leg(800, 600, 12_000))
    out["long stop"] = glue(leg(0, 600), still(600, 400, 12_000), leg(1000, 600, 12_000))
    climb = [10_000] * 300 + [10_000 + 15 * i for i in range(600)] + [19_000 - 20 * i for i in range(400)] + [11_000] * 300
    out["altitude"] = glue(still(0, 300), leg(300, 1000), still(1300, 300, 20_000)).assign(geo_dm=climb)
    rng = np.random.default_rng(11)
    for k in range(12):  # bursts of noise, jumps, slips, gaps and climbs
        n = int(rng.integers(2, 400))
        t = 1000 + np.cumsum(rng.choice([0, 1, 1, 1, 2, 9, 900 if k % 3 else 1900], n, p=[0.02, 0.3, 0.3, 0.2, 0.1, 0.07, 0.01]))
        for at in rng.integers(0, n, k % 4):
            t[at:] -= int(rng.integers(1, 400))
        lat, lon = (4_700_000 + np.cumsum(rng.integers(-30, 31, n) * (np.arange(n) // 60 % 2)) for _ in range(2))
        lat[rng.random(n) < 0.04] += 400_000
        out[f"random {k}"] = frame(t.tolist(), lat.tolist(), lon.tolist(), (15_000 + np.cumsum(rng.integers(-40, 41, n))).tolist() if k % 2 else None)
    return out


@pytest.fixture(scope="module")
def found(spark):
    """(tracks, their cleaned fixes, their flights): all tracks in one table."""
    own = tracks()
    rows = [(name, int(r.idx), int(r.t), int(r.lat_e5), int(r.lon_e5), int(r.geo_dm), None) for name, f in own.items() for r in f.itertuples()]
    df = spark.createDataFrame(rows, FIXES.replace("flight_id long", "flight_id string")).repartition(3)
    clean = {name: [] for name in own}
    for r in cleaning.cleaned(df).orderBy("flight_id", "idx").collect():
        clean[r.flight_id].append(r)
    windows = {r.flight_id: (r.takeoff_idx, r.landing_idx) for r in detection.flight_windows(df).collect()}
    assert cleaning.cleaned(df.limit(0)).count() == 0 and detection.flight_windows(df.limit(0)).count() == 0
    return own, clean, windows


def test_relations_do_what_a_plain_program_does(found):
    own, clean, windows = found
    for name, f in own.items():
        assert [r.raw_idx for r in clean[name]] == sequential.clean(f)["idx"].tolist(), name
        assert [r.idx for r in clean[name]] == list(range(len(clean[name])))
        if (np.diff(f["t"]) > 0).all():
            assert windows.get(name) == sequential.flight_window(f), name


def test_a_mean_that_is_just_a_limit(spark):
    """Climbing 5 cm a second is too little to go on flying, though the mean of three such speeds is a little more in doubles."""
    climb = np.cumsum([0] + [80] * 3 + [4] * 16).tolist()
    df = spark.createDataFrame([(climbs, i, 8 * i, 4_700_000 + 72 * i, 1_300_000, z + climbs * i) for climbs in (0, 1) for i, z in enumerate(climb)], "flight_id long, idx long, t long, lat_e5 int, lon_e5 int, z_dm int")
    assert [r.flight_id for r in detection.altitude_windows(df).collect()] == [1]


def test_fixes_that_go(found):
    _, clean, _ = found
    n = {k: len(v) for k, v in clean.items()}
    assert n["steady"] == 400 and n["slips"] == 398 and n["far"] == 395 and n["never back"] == 40
    assert clean["odd start"][0].t == 1001
    assert all(a.t < b.t for v in clean.values() for a, b in zip(v, v[1:]))


def test_shifted_pieces_are_joined_or_dropped(found):
    _, clean, _ = found
    assert len(clean["shifted"]) in (400, 700) and not clean["pieces"]


def test_longest_segment_by_gap(found):
    _, clean, _ = found
    assert clean["wide gap"][0].t == 3001 and len(clean["gap"]) == 800


def test_windows(found):
    _, _, windows = found
    takeoff, landing = windows["speed"]
    assert abs(takeoff - 400) < 20 and abs(landing - 1300) < 20
    assert "still" not in windows and "one" not in windows and windows["stop"] == (0, 1399)
    takeoff, landing = windows["altitude"]
    assert 285 <= takeoff <= 310 and 1290 <= landing <= 1320


def test_states_are_the_likeliest(spark):
    rng = random.Random(3)
    stay, right = np.log([detection.STAY, 1 - detection.STAY]), np.log([detection.RIGHT, 1 - detection.RIGHT])
    signs = {k: [rng.random() < 0.5 for _ in range(rng.choice((1, 2, 3, 8, 10)))] for k in range(30)}
    df = spark.createDataFrame([(k, i, s) for k, own in signs.items() for i, s in enumerate(own)], "flight_id long, idx long, s boolean")
    paths = {k: [0] * len(own) for k, own in signs.items()}
    for r in detection.likeliest_states(df, "s", detection.rounds_for(df)).collect():
        paths[r.flight_id][r.idx] = r.state
    for k, own in signs.items():

        def chance(path):
            p = np.log(detection.START_CHANCES[path[0]]) + sum(right[0 if s == x else 1] for s, x in zip(own, path))
            return p + sum(stay[0 if a == b else 1] for a, b in zip(path, path[1:]))

        assert chance(paths[k]) == pytest.approx(max(map(chance, itertools.product((0, 1), repeat=len(own)))))


@pytest.mark.parametrize("tolerance,chord", [(400.0, None), (30.0, 900.0), (0.5, None)])
def test_simplification_level_by_level(spark, tolerance, chord):
    """All stretches at once keep what halving one after the other keeps; hulls have the same rectangles."""
    own = {k: wander(n, k) for k, n in enumerate((1, 2, 3, 40, 130))}
    df = spark.createDataFrame([(k, i, int(a), int(o)) for k, (lat, lon) in own.items() for i, (a, o) in enumerate(zip(lat, lon))], "flight_id long, idx long, lat_e5 int, lon_e5 int")
    kept = {k: [] for k in own}
    for r in outline.simplified(df, tolerance, chord).orderBy("flight_id", "idx").collect():
        kept[r.flight_id].append(r.idx)
    assert kept == {k: routes.simplify(routes.plane_m(*x), tolerance, chord).tolist() for k, x in own.items()}
    if chord is None:
        got = {r.flight_id: r.aspect_ratio for r in outline.aspect_ratios(df).collect()}
        assert got == {k: pytest.approx(routes.aspect_ratio(*x)) if len(x[0]) > 2 else None for k, x in own.items()}


def test_of_equally_large_rectangles_the_one_of_the_sql(spark):
    """The rectangles on the sides of an acute triangle are equally large but for their last bits, by which the SQL tells them apart."""
    own = [
        [(4601716, 1304379), (4601512, 1302610), (4600514, 1304222)], [(4600275, 1301710), (4601804, 1301329), (4600450, 1302785)], [(4600110, 1304326), (4601220, 1300745), (4602851, 1302139)],
        [(4601456, 1300237), (4600114, 1302288), (4601934, 1302123)], [(4600112, 1301238), (4602419, 1303812), (4602686, 1301197)], [(4601304, 1300755), (4602957, 1302997), (4600079, 1302768)],
    ]
    rows = [(k, i, a, o) for k, places in enumerate(own) for i, (a, o) in enumerate(places)]
    c = duckdb.connect(config={"threads": 1})
    c.execute("CREATE TABLE own (flight_id BIGINT, idx BIGINT, lat_e5 INT, lon_e5 INT)")
    c.executemany("INSERT INTO own VALUES (?, ?, ?, ?)", rows)
    want = c.execute(plans.SQL["aspect_ratios"].replace(PATHS, "paths AS (SELECT * FROM own)")).fetchall()
    got = outline.aspect_ratios(spark.createDataFrame(rows, "flight_id long, idx long, lat_e5 int, lon_e5 int").repartition(3)).collect()
    assert {r.flight_id: round(r.aspect_ratio, 6) for r in got} == dict(want)


# --- climb segments ---------------------------------------------------------------------------------------------------------------


def run(bucket, start, end):
    return [bucket, start, end, start, end]


def test_odd_runs_are_absorbed():
    got = segments.absorb_odd([run(1, 0, 20), run(2, 21, 25), run(1, 26, 50), run(3, 51, 55), run(1, 56, 90)])
    assert got == [run(1, 0, 90)]
    kept = [run(1, 0, 20), run(2, 21, 30), run(1, 31, 50)]
    assert segments.absorb_odd(kept) == kept


def test_short_runs_dissolve():
    assert segments.dissolve_short([run(1, 0, 40), run(2, 41, 50), run(3, 51, 80)]) == [run(1, 0, 50), run(3, 51, 80)]
    assert segments.dissolve_short([run(1, 0, 20), run(2, 21, 30), run(1, 31, 60)]) == [run(1, 0, 60)]
    assert segments.dissolve_short([run(1, 0, 3)]) == [run(1, 0, 3)]
    assert segments.dissolve_short([]) == []


# --- routes -----------------------------------------------------------------------------------------------------------------------


def wander(n, seed):
    rng = np.random.default_rng(seed)
    return 4_700_000.0 + np.cumsum(rng.integers(-6000, 6000, n)), 1_000_000.0 + np.cumsum(rng.integers(-9000, 9000, n))


@pytest.mark.parametrize("seed", range(6))
def test_routes_against_brute_force(seed):
    lat, lon = wander(22, seed)
    length = lambda c: sum(float(routes.fcc_km(lat[a], lon[a], lat[b], lon[b])) for a, b in zip(c, c[1:]))
    assert length(routes.free_distance(lat, lon)) == pytest.approx(max(map(length, itertools.combinations(range(22), 5))))
    d = routes.haversine_km(lat[:, None], lon[:, None], lat[None], lon[None])
    for gap, side in ((0.2, 0), (0.05, 0), (0.2, 0.28)):
        best = 0.0
        for i, j, k in itertools.combinations(range(22), 3):
            legs, close = (d[i, j], d[j, k], d[k, i]), d[: i + 1, k:].min()
            if close <= gap * sum(legs) and min(legs) >= side * sum(legs):
                best = max(best, sum(legs) - close)
        found = routes.best_triangle(lat, lon, gap, side)
        assert (found.perimeter_km - found.gap_km if found else 0.0) == pytest.approx(best)


def test_few_points():
    assert routes.evaluate(np.array([1.0]), np.array([2.0])) == []
    five = (np.array([0, 0, 100_000, 100_000, 200_000.0]), np.array([0, 100_000, 100_000, 0, 0.0]))
    assert routes.free_distance(*five).tolist() == [0, 1, 2, 3, 4]
    same = (np.zeros(9), np.zeros(9))
    assert routes.free_distance(*same) is None


def test_long_triangle_is_found_within_tolerance():
    rng = np.random.default_rng(0)
    corners, n = np.array([[4_600_000, 1_300_000], [4_640_000, 1_330_000], [4_600_000, 1_370_000], [4_600_500, 1_300_500]]), 6_000
    u = np.linspace(0, 3, n)
    k = np.minimum(u.astype(int), 2)
    xy = corners[k] * (1 - u + k)[:, None] + corners[k + 1] * (u - k)[:, None] + rng.normal(0, 3, (n, 2)).cumsum(axis=0)
    found = {r["type"]: r for r in routes.evaluate(*xy.round().T)}
    assert set(found) == {"free_distance", "free_triangle", "fai_triangle"}
    assert found["fai_triangle"]["sub_type"] == "olc_closed" and found["fai_triangle"]["factor"] == 1.6
    assert abs(found["fai_triangle"]["distance_m"] - 157_700) < 1_000


def test_simplification():
    xy = np.array([[0, 0], [10, 1], [20, 0], [30, 9], [40, 0.0]])
    assert routes.simplify(xy, 2).tolist() == [0, 2, 3, 4]
    assert routes.simplify(xy, 100).tolist() == [0, 4]
    assert routes.simplify(xy, 100, chord_m=25).tolist() == [0, 2, 4]
    assert routes.simplify(xy, 0.1, most=3) is None
    assert routes.simplify(np.zeros((1, 2)), 1).tolist() == [0]
    assert len(routes.hull(np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1]]))) == 4
    a, o = np.array([0, 0, 1000, 1000, 0.0]), np.array([0, 5000, 5000, 0, 0.0])
    assert routes.aspect_ratio(a, o) == pytest.approx(5, rel=0.01)
    assert routes.aspect_ratio(a[:2], o[:2]) is None


@pytest.mark.parametrize("seed", range(8))
def test_blocks_find_the_best_triangle(monkeypatch, seed):
    """Tracks beyond the exhaustive search give what it would find."""
    lat, lon = wander(90 + 7 * seed, seed)
    for gap in (0.2, 0.05):
        for side, km in ((0.0, 0.0), (routes.FAI_SIDE, 0.2)):
            want = routes.best_triangle(lat, lon, gap, side, km)
            with monkeypatch.context() as m:
                m.setattr(routes, "CORNERS", 12)
                m.setattr(routes, "BLOCK_FIXES", 4)
                got = routes.best_triangle(lat, lon, gap, side, km)
            assert (got is None) == (want is None)
            if want is not None:
                assert got.optimal and got.perimeter_km - got.gap_km == pytest.approx(want.perimeter_km - want.gap_km, abs=1e-9)


def test_long_tracks_are_searched_to_the_end():
    """An hour at 1 Hz: optimal, and no worse than its every tenth fix searched exhaustively."""
    t = np.arange(3_600)
    lat = 4_700_000 + 18_000 * np.sin(t / 570) + 1_500 * np.sin(t / 31) + t * 0.4
    lon = 1_300_000 + 26_000 * np.cos(t / 575) + 2_100 * np.cos(t / 37)
    lat, lon = np.round(lat), np.round(lon)
    for gap in (0.2, 0.05):
        found = routes.best_triangle(lat, lon, gap, routes.FAI_SIDE, routes.FAI_SIDE_KM)
        coarse = routes.best_triangle(lat[::24], lon[::24], gap, routes.FAI_SIDE, routes.FAI_SIDE_KM)
        assert found is not None and found.optimal
        assert coarse is None or found.perimeter_km - found.gap_km >= coarse.perimeter_km - coarse.gap_km - 1e-9


# --- routes of all flights, as relations --------------------------------------------------------------------------------------------


def steps(n, seed):
    rng = np.random.default_rng(seed)
    return 4_700_000.0 + np.cumsum(rng.integers(-300, 301, n)), 1_000_000.0 + np.cumsum(rng.integers(-400, 401, n))


def circle(n):
    t = np.arange(n)
    return np.round(4_700_000 + 18_000 * np.sin(t / (n / 6.3))), np.round(1_300_000 + 26_000 * np.cos(t / (n / 6.3)))


def as_table(spark, own):
    rows = [(k, 3 * i, int(a), int(o)) for k, (lat, lon) in own.items() for i, (a, o) in enumerate(zip(lat, lon))]
    return spark.createDataFrame(rows, "flight_id long, idx long, lat_e5 int, lon_e5 int").repartition(3)


def test_free_distance_is_the_longest(spark):
    """At any length the way is that of all fixes, also where many are nearly as long (a circle); idx need not be dense."""
    own = {n: steps(n, n) for n in (4, 5, 64, 65, 300, 900)} | {1_000: circle(600), 1_001: (np.zeros(9), np.zeros(9))}
    got = {r.flight_id: r for r in distance.free_distances(as_table(spark, own)).collect()}
    assert set(got) == set(own) - {4, 1_001} and all(r.optimal for r in got.values())
    for k, r in got.items():
        lat, lon = own[k]
        moved = np.flatnonzero(np.append(True, (np.diff(lat) != 0) | (np.diff(lon) != 0)))
        way = routes.longest_way(lat, lon, moved)
        assert r.turns == (3 * way).tolist() and (r.legs_m, r.distance_m) == routes.free_distance_m(lat, lon, way)


def test_of_equal_ways_the_first_or_the_last(spark):
    """Turns whose place comes again, at once (fixes 3 and 4, the end) or later (6 and 8)."""
    places = [(4_600_000, 1_300_000), (4_600_010, 1_300_500), (4_600_300, 1_301_000), (4_600_100, 1_309_000), (4_600_100, 1_309_000), (4_603_000, 1_308_000), (4_608_000, 1_300_000), (4_607_000, 1_300_500), (4_608_000, 1_300_000), (4_607_500, 1_309_000), (4_600_500, 1_300_200), (4_600_500, 1_300_200)]
    fixes = spark.createDataFrame([(1, i, a, o) for i, (a, o) in enumerate(places)], "flight_id long, idx long, lat_e5 int, lon_e5 int")
    first, last = (distance.free_distances(fixes, latest).first() for latest in (False, True))
    assert first.turns == [0, 3, 6, 9, 10] and last.turns == [0, 4, 8, 9, 11]
    assert first.distance_m == last.distance_m and first.legs_m == last.legs_m


def test_triangles_are_the_best(spark, monkeypatch):
    own = {n: steps(n, n) for n in (2, 3, 24, 25, 130, 400)} | {1_000: circle(260)}
    sides = {"free_triangle": (0.0, 0.0), "fai_triangle": (0.28, 0.2)}
    got = {(r.flight_id, r.type, r.sub_type): r for r in triangles.best_triangles(as_table(spark, own), sides=sides).collect()}
    monkeypatch.setattr(routes, "CORNERS", 400)
    for k, (lat, lon) in own.items():
        for shape, side in sides.items():
            for sub_type, gap in triangles.GAPS.items():
                want, r = routes.best_triangle(lat, lon, gap, *side), got.pop((k, shape, sub_type), None)
                assert (r is None) == (want is None)
                if want is not None:
                    assert r.perimeter_km - r.gap_km == pytest.approx(want.perimeter_km - want.gap_km, abs=1e-9)
                    a, b, c, q, w = (x // 3 for x in (*r.turns, *r.gap_ends))
                    assert q <= a < b < c <= w and r.gap_km == pytest.approx(float(routes.haversine_km(lat[q], lon[q], lat[w], lon[w])), abs=1e-9)
    assert not got


@pytest.mark.parametrize("whole_fixes", [triangles.WHOLE_FIXES, 2])
def test_of_equal_triangles_the_one_of_the_sql(spark, monkeypatch, whole_fixes):
    """Each turn's place comes twice: the SQL takes the later one for the second turn, the earlier one for the first; for the third it takes either."""
    monkeypatch.setattr(triangles, "WHOLE_FIXES", whole_fixes)
    way = [(0, 0)] * 2 + [(0, 90_000)] * 2 + [(77_942, 45_000)] * 2 + [(0, 10_000)]
    fixes = spark.createDataFrame([(1, i, *p) for i, p in enumerate(way)], "flight_id long, idx long, lat_e5 int, lon_e5 int")
    assert {(tuple(r.turns), tuple(r.gap_ends)) for r in triangles.best_triangles(fixes).collect()} == {((0, 3, 4), (0, 6))}


def test_turnpoints_of_equal_triangles(spark):
    """The later of two fixes at the second turn's place is named, the earlier one at the others'."""
    way = [(0, 0)] * 2 + [(0, 90_000)] * 2 + [(77_942, 45_000)] * 2 + [(0, 10_000)]
    fixes = spark.createDataFrame([(1, i, *p) for i, p in enumerate(way)], "flight_id long, idx long, lat_e5 int, lon_e5 int")
    told = charts.turnpoints_json(triangles.best_triangles(fixes, {"olc_open": 0.2}, {"free_triangle": (0.0, 0.0)}), fixes).first().turnpoints
    assert [x["fix"] for x in json.loads(told)] == [{"idx": i, "lat": way[i][0], "lon": way[i][1]} for i in (0, 3, 4)]


def kind_by_force(lat, lon, kind, fd):
    """The better triangle of a kind, with a probe over all fixes."""
    side, side_km = 0.0, 0.0
    if kind == "fai_triangle":
        ratio = routes.aspect_ratio(lat, lon)
        if fd < scoring.FAI_LEAST_FD_M or (ratio is not None and ratio >= scoring.FAI_MOST_ASPECT):
            return None
        probe = routes.best_triangle(lat, lon, scoring.PROBE_GAP, routes.FAI_SIDE, routes.FAI_SIDE_KM)
        if probe is None or routes.triangle_distance_m(lat, lon, probe)[2] < max(scoring.FAI_LEAST_M, scoring.FAI_TO_FD * fd):
            return None
        side, side_km = routes.FAI_SIDE, max(routes.FAI_SIDE_KM, fd / 1000 * scoring.FAI_TO_FD * routes.FAI_SIDE)
    else:
        probe = routes.best_triangle(lat, lon, scoring.PROBE_GAP)
        if (routes.triangle_distance_m(lat, lon, probe)[2] if probe else 0) < scoring.FREE_PROBE_TO_FD * fd:
            return None
    best = None
    for sub_type, gap in routes.GAPS.items():
        found = routes.best_triangle(lat, lon, gap, side, side_km)
        if found is None:
            break
        legs, gap_m, metres = routes.triangle_distance_m(lat, lon, found)
        if kind == "free_triangle" and sub_type == "olc_open" and metres < scoring.FREE_TO_FD * fd:
            return None
        score = metres / 1000 * scoring.FACTORS[kind, sub_type]
        best = (sub_type, legs, metres, gap_m, score) if best is None or score > best[-1] else best
    return best


def test_scored_routes(spark):
    own = {k: tuple(4 * x - 3 * x[0] for x in steps(n, n + k)) for k, n in enumerate((30, 60, 90))} | {9: circle(90), 10: steps(3, 1)}
    got = {(r.flight_id, r.type): r for r in scoring.scored_routes(as_table(spark, own)).collect()}
    for k, (lat, lon) in own.items():
        way = routes.longest_way(lat, lon, np.flatnonzero(np.append(True, (np.diff(lat) != 0) | (np.diff(lon) != 0))))
        if way is None:
            continue
        fd = routes.free_distance_m(lat, lon, way)[1]
        assert got.pop((k, "free_distance")).distance_m == fd
        for kind in ("free_triangle", "fai_triangle"):
            want, r = kind_by_force(lat, lon, kind, fd), got.pop((k, kind), None)
            assert want == (None if r is None else (r.sub_type, r.legs_m, r.distance_m, r.gap_m, pytest.approx(r.score)))
    assert not got


def test_range_boxes_by_brute_force(spark):
    r = random.Random(11)
    fixes = [(f, i, r.randint(-9_000_000, 9_000_000), r.choice([None, r.randint(-18_000_000, 18_000_000)])) for f, n in ((1, 1), (2, 70), (3, 300)) for i in sorted(r.sample(range(2 * n), n))]
    ranges = [(f, k, lo, lo + r.choice([0, 1, 2, 3, 8, 63, 64, 65, 700, -1])) for f in (1, 2, 3, 4) for k, lo in enumerate(r.choices(range(-5, 620), k=120))] + [(2, None, 3, 30), (2, 999, None, 30), (2, 5, 0, 10), (2, 5, 0, 10)]
    got = series.range_boxes(spark.createDataFrame(fixes, "flight_id long, idx long, lat_e5 int, lon_e5 int"), spark.createDataFrame(ranges, "flight_id long, range_id long, lo long, hi long"))
    want = {}
    for f, k, lo, hi in ranges:
        if lo is not None:
            want.setdefault((f, k), []).extend(x for x in fixes if x[0] == f and lo <= x[1] <= hi)
    ends = lambda v: (min(v, default=None), max(v, default=None))
    want = {(*k, *ends([x[2] for x in v]), *ends([x[3] for x in v if x[3] is not None])) for k, v in want.items() if v}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert series.range_boxes(spark.createDataFrame([], "flight_id long, idx long, lat_e5 int, lon_e5 int"), spark.createDataFrame(ranges, "flight_id long, range_id long, lo long, hi long")).count() == 0


def test_short_flights_are_searched_whole(spark, monkeypatch):
    """Flights of up to WHOLE_FIXES fixes need no frontier, and both ways find the same; fixes without a place take no part."""
    own = {n: steps(n, n) for n in (2, 3, 40, 128)} | {1_000: circle(90)}
    told = as_table(spark, own).unionByName(spark.createDataFrame([(40, 4, None, 0)], "flight_id long, idx long, lat_e5 int, lon_e5 int"))
    keyed = lambda df: {(r.flight_id, r.type, r.sub_type): r for r in df.collect()}
    with monkeypatch.context() as m:
        m.setattr(triangles, "_by_blocks", None)
        whole = keyed(triangles.best_triangles(told))
    monkeypatch.setattr(triangles, "WHOLE_FIXES", 2)
    blocks = keyed(triangles.best_triangles(told))
    assert whole and set(whole) == set(blocks)
    for key, r in whole.items():
        assert r.perimeter_km - r.gap_km == pytest.approx(blocks[key].perimeter_km - blocks[key].gap_km, abs=1e-9)


def test_equal_ways_go_by_the_sums_in_order(spark):
    """Of ways through the states that are equally likely, the sums of the SQL, taken fix by fix, decide."""
    rng, (stay, change, right, wrong) = np.random.default_rng(5), np.log([0.9995, 0.0005, 0.8, 0.2])
    signs = {k: np.repeat(rng.random(20) < 0.5, rng.integers(1, 9, 20)).tolist() for k in range(60)}
    df = spark.createDataFrame([(k, i, s) for k, own in signs.items() for i, s in enumerate(own)], "flight_id long, idx long, s boolean").repartition(3)
    got = {k: [0] * len(own) for k, own in signs.items()}
    for r in detection.likeliest_states(df, "s").collect():
        got[r.flight_id][r.idx] = r.state
    for k, own in signs.items():
        a, b, came = np.log(0.8) + (wrong if own[0] else right), np.log(0.2) + (right if own[0] else wrong), []
        for s in own[1:]:
            came.append((a + stay < b + change, a + change < b + stay))
            a, b = max(a + stay, b + change) + (wrong if s else right), max(a + change, b + stay) + (right if s else wrong)
        want = [int(b >= a)]
        for to in came[::-1]:
            want.append(int(to[want[-1]]))
        assert got[k] == want[::-1]


def test_ends_of_a_window_among_fixes_of_one_time(spark):
    """The first and the last fix of a window are those by idx where several have its time, in whatever order rows come."""
    rows = [(1, 2, 9, 0, 30, 900), (1, 3, 9, 0, 90, 500), (1, 0, 0, 0, 0, 100), (1, 1, 0, 0, 50, 300)]
    for own in (rows, rows[::-1], [rows[k] for k in (3, 0, 2, 1)]):
        df = spark.createDataFrame(own, "flight_id long, idx long, t long, lat_e5 int, lon_e5 int, alt_dm int").coalesce(1)
        peak = series.peaks(series.vario_ms(df, 10)).first()
        assert peak.peak_climb == pytest.approx((500 - 100) / 10 / 9) and peak.peak_sink == 0
        assert {round(r.ground_kmh, 6) for r in series.ground_speed_kmh(df, 10).collect()} == {round(float(routes.haversine_km(0, 0, 0, 90)) / 9 * 3600, 6)}
