import gzip
import io
import random
import zipfile

import pytest

from skytrace.sources import codec, igc, ingest, stored, xmltracks

FIXES = "flight_id long, idx long, t long, lat_e5 int, lon_e5 int, geo_dm int, pressure_dm int, tas_kmh int"


def track(n, seed=1, tas=True, pressure=True):
    r = random.Random(seed)
    t, lat, lon, z, rows = 1_714_550_000 + seed, 4_650_000, -1_300_000, 5_000, []
    for i in range(n):
        jump = 5_000 if i in (100, 200) else 0
        t, lat, lon, z = t + (7 if i % 150 == 149 else 1), lat + r.randint(-80, 80) + jump, lon + r.randint(-80, 80), z + r.randint(-12, 12) * 10
        rows.append((seed, i, t, lat, lon, z, z + 30 if pressure else None, 30 + i % 5 if tas else None))
    return rows


@pytest.mark.parametrize("tas,pressure", [(True, True), (False, False)])
def test_compact_round_trip(spark, tas, pressure):
    rows = track(500, 1, tas, pressure) + track(3, 2, tas, pressure) + track(1, 3, tas, pressure)
    encoded = codec.encode(spark.createDataFrame(rows, FIXES))
    assert encoded.where("whole").count() < 20
    assert sorted(map(tuple, codec.decode(encoded).collect())) == sorted(rows)


def test_compact_needs_whole_channels(spark):
    rows = [list(r) for r in track(5)]
    rows[2][7] = None
    with pytest.raises(Exception, match="tas_kmh is missing"):
        codec.encode(spark.createDataFrame(rows, FIXES)).collect()


def test_fnv(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(codec.fnv1a(F.lit("foobar").cast("binary")).alias("h")).first().h == 0xBF9CF968


def test_etag(spark):
    from pyspark.sql import functions as F
    from xxhash import xxh64

    blobs = [b"", b"foobar", bytes(range(256)) * 40, b"12263"]
    got = spark.createDataFrame([(bytearray(b),) for b in blobs], "data binary").select(codec.etag(F.col("data")).alias("tag")).collect()
    assert [r.tag for r in got] == [f"{xxh64(b, seed=42).intdigest():016x}" for b in blobs]


def read_igc(spark, tmp_path, text, name="a.igc"):
    (tmp_path / name).write_text(text)
    return ingest.read(spark, str(tmp_path)).orderBy("idx").collect()


def test_igc_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = track(60)
    text = igc.compose(spark.createDataFrame(rows, FIXES)).first().igc
    assert text.splitlines()[2] == "I013638TAS"
    got = read_igc(spark, tmp_path, text)
    assert [(r.t, r.geo_dm, r.pressure_dm, r.tas_kmh) for r in got] == [(r[2], r[5], r[6], r[7]) for r in rows]
    assert all(abs(r.lat_e5 - w[3]) <= 1 and abs(r.lon_e5 - w[4]) <= 1 for r, w in zip(got, rows))


B = "B{}4646349N01308989EA0100001010"


def test_igc_days(spark, tmp_path):
    text = "AXXX\nHFDTEDATE:310524,01\n" + "\n".join(B.format(t) for t in ("235958", "235959", "000001")) + "\nHFDTE010624\n" + B.format("000500") + "\n"
    got = read_igc(spark, tmp_path, text)
    day = 19_874 * 86_400
    assert [r.t - day for r in got] == [86_398, 86_399, 86_401, 86_400 + 300]


def test_igc_v_records_count_days(spark, tmp_path):
    text = "HFDTE310524\n" + B.format("235959") + "\n" + B.format("000001").replace("EA", "EV") + "\n" + B.format("000002") + "\n"
    assert [r.t % 86_400 for r in read_igc(spark, tmp_path, text)] == [86_399, 2]
    assert len({r.t // 86_400 for r in read_igc(spark, tmp_path, text)}) == 2


def test_igc_fields(spark, tmp_path):
    text = B.format("120000").replace("01000", "00000") + "\n" + B.format("120001").replace("0100001010", "00000-0010").replace("N", "S").replace("E", "W") + "\n"
    one, two = read_igc(spark, tmp_path, text)
    assert (one.t, one.lat_e5, one.lon_e5, one.geo_dm, one.pressure_dm, one.tas_kmh) == (43_200, 4_677_248, 1_314_982, 10_100, None, None)
    assert (two.lat_e5, two.lon_e5, two.geo_dm) == (-4_677_248, -1_314_982, -100)


@pytest.mark.parametrize("bad", ["B12", B.format("250000"), B.format("120000").replace("EA", "EX"), "HFDTE320524"])
def test_igc_broken_file(spark, tmp_path, bad):
    got = read_igc(spark, tmp_path, B.format("120000") + "\n" + bad + "\n")
    assert [(r.error, r.t) for r in got] == [("line 2", None)]


GPX = '<gpx xmlns="x"><trk><trkseg><trkpt lat="46.5" lon="-13.1"><ele>1000.25</ele><time>2024-05-01T12:00:00Z</time></trkpt><trkpt lat="46.6" lon="-13.2"><time>2024-05-01T12:00:01+00:00</time></trkpt></trkseg></trk></gpx>'
OFFSETS = '<kml><Placemark><Metadata type="track"><FsInfo time_of_first_point="2024-05-01T12:00:00Z"><SecondsFromTimeOfFirstPoint>0 5</SecondsFromTimeOfFirstPoint></FsInfo></Metadata><LineString><coordinates>13.1,46.5,900 13.2,46.6,901</coordinates></LineString></Placemark></kml>'
GX = '<kml xmlns:gx="g"><gx:Track><when>2024-05-01T12:00:00Z</when><gx:coord>13.1 46.5 900</gx:coord></gx:Track></kml>'
POINTS = '<kml><Folder><name>track_points</name>' + "".join(f'<Placemark><ExtendedData><SchemaData><SimpleData name="track_fid">{k}</SimpleData><SimpleData name="ele">90{k}</SimpleData><SimpleData name="time">2024/05/01 12:00:0{k}+00</SimpleData></SchemaData></ExtendedData><Point><coordinates>13.1,46.5</coordinates></Point></Placemark>' for k in (0, 0, 1)) + "</Folder></kml>"


def kmz(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.txt", "x")
        z.writestr(name, text)
    return out.getvalue()


def test_xml_files(spark, tmp_path):
    files = {"a.GPX": GPX.encode(), "b.gpx.gz": gzip.compress(GPX.encode()), "c.kml": OFFSETS.encode(), "d.kml": GX.encode(), "e.kml": POINTS.encode(), "f.kmz": kmz("doc.kml", GX), "g.kmz": kmz("x.kml", GX), "h.kmz": kmz("x.txt", GX), "i.gpx": b"<gpx>", "j.gpx": b"<gpx/>", "k.txt": b"", "l.gpx.gz": gzip.compress(GPX.encode())[:-9]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in ingest.read(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2][0], []).append(r)
    assert {k: len(v) for k, v in got.items()} == {**dict.fromkeys("abce", 2), **dict.fromkeys("dfghijl", 1)}
    assert {k for k, v in got.items() if v[0].error} == set("hijl")
    first = min(got["a"], key=lambda r: r.idx)
    assert (first.t, first.lat_e5, first.lon_e5, first.geo_dm) == (1_714_564_800, 4_650_000, -1_310_000, 10_003)
    assert [r.t - 1_714_564_800 for r in sorted(got["c"], key=lambda r: r.idx)] == [0, 5]
    assert {r.geo_dm for r in got["e"]} == {9_000}


def test_no_file_ends_a_job(spark):
    """Each broken file is one row with an error, and the good ones beside it are read whole."""
    log = gzip.compress(b"HFDTE010524\nB1200004646349N01308989EA0010000200\n" * 500)
    bad = {
        "a.igc.gz": log[:20] + b"\xff" * 40 + log[60:], "b.gpx.gz": b"\x1f\x8b" + b"junk" * 9, "c.gpx": GPX.replace("1000.25", "inf").encode(), "d.gpx": GPX.replace("1000.25", "1e12").encode(),
        "e.gpx": GPX.replace("1000.25", "nan").encode(), "f.kml": OFFSETS.replace("0 5", "0 99999999999999999999").encode(), "g.gpx": b'<?xml version="1.0" encoding="nope"?><gpx/>', "h.kmz": b"PK\x03\x04" + b"x" * 40,
        "i.gpx": GPX.replace("46.5", "1e400").encode(), "j.gpx": GPX.replace("2024-05-01T12:00:00Z", "99999-01-01T00:00:00Z").encode(), "k.kml": b"<kml><Placemark><Metadata type='track'><FsInfo/></Metadata></Placemark></kml>", "l.igc": b"\x00\xff" * 10,
    }
    files = [*bad.items(), ("ok.gpx", GPX.encode()), ("ok.igc.gz", log)]
    got = ingest.fixes_of(spark.createDataFrame(files, "path string, content binary").repartition(1)).collect()
    assert {p: [r.t for r in got if r.path == p] for p in bad} == {p: [None] for p in bad}
    assert all(r.error for r in got if r.path in bad)
    assert sum(r.path == "ok.gpx" for r in got) == 2 and sum(r.path == "ok.igc.gz" and r.error is None for r in got) == 500


def test_inflation_is_bounded():
    with pytest.raises(ValueError):
        xmltracks.inflated(gzip.compress(bytes(1000)), 999)
    assert xmltracks.inflated(gzip.compress(bytes(1000)), 1000) == bytes(1000)


def test_one_way_in_for_all_files(spark):
    """Logs in windows-1251, gzipped ones, and files that are refused, each with its reason."""

    log = "AXCT\nHFDTE010524\nHFPLTПилот\nB1200004646349N01308989EA0010000200\nB1200014646350N01308990EA0010100201\n"
    files = [("a.IGC", log.encode("cp1251")), ("b.igc.gz", gzip.compress(log.encode())), ("c.igc", b"AXCT\n"), ("d.igc", b"x" * (ingest.MOST_BYTES + 1)), ("e.txt", b""), ("f.gpx", b"<gpx"), ("g.igc.gz", gzip.compress(log.encode())[:-9])]
    got = ingest.fixes_of(spark.createDataFrame(files, "path string, content binary")).collect()
    read = {p: sorted((r.idx, r.geo_dm, r.pressure_dm) for r in got if r.path == p and r.error is None) for p in ("a.IGC", "b.igc.gz")}
    assert read["a.IGC"] == read["b.igc.gz"] == [(0, 2000, 1000), (1, 2010, 1010)]
    errors = {r.path: r.error for r in got if r.error is not None}
    assert set(errors) == {"c.igc", "d.igc", "e.txt", "f.gpx", "g.igc.gz"}
    assert errors["c.igc"] == "no fixes" and errors["d.igc"] == "the file is too large" and errors["e.txt"] == "unknown format"
    assert ingest.decoded("Пилот".encode("cp1251")) == "Пилот"
    assert all(r.t is None and r.lat_e5 is None for r in got if r.error is not None)


def test_long_flights_are_encoded_in_proportion(spark):
    """A flight of 60,000 fixes comes back; with a list of all steps in each row it would hold 3.6 billion numbers."""
    fixes = spark.range(60_000).selectExpr("1L flight_id", "id idx", "1700000000 + id + id div 1000 t", "int(4700000 + id % 90) lat_e5", "int(1300000 + id) lon_e5", "int(10000 + id % 50) geo_dm", "cast(null as int) pressure_dm", "cast(null as int) tas_kmh")
    back = codec.decode(codec.encode(fixes))
    assert back.select(fixes.columns).exceptAll(fixes).count() == 0 and back.count() == 60_000


def test_a_zoom_reads_the_one_below(spark):
    """Every zoom of a pyramid is computed once: its plan holds the scans of its own zoom, not of all below it."""
    from skytrace.operators import tiles

    px = spark.range(64).selectExpr("6 z", "int(id % 8) x", "int(id div 8) y").selectExpr("z", "x", "y", "explode(sequence(0, 15)) i").selectExpr("z", "x", "y", "int(i div 4) row", "int(i % 4) col", "double(x + y) value")
    out = tiles.pyramid(px, 4, 0, 6)
    counts = {r.z: r["count"] for r in out.groupBy("z").count().collect()}
    assert counts == {6: 1024, 5: 256, 4: 64, 3: 16, 2: 16, 1: 16, 0: 16}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 6


def test_buckets_that_an_upsert_touches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, kind string, v long"
    rows = [(i, "a", i) for i in range(500)] + [(None, "n", 1)]
    stored.write(spark.createDataFrame(rows, schema), path, ["id"], 16)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(7, "b", 70), (1000, "b", 71)], schema)
    done = stored.upsert_into(spark, path, new, ["id"], ["v"], 16)
    assert sorted((r.id, r.outcome) for r in done.collect()) == [(7, "updated"), (1000, "inserted")]
    want = {(i, "a", 70 if i == 7 else i) for i in range(500)} | {(None, "n", 1), (1000, "b", 71)}
    found = [tuple(r) for r in stored.read(spark, path, ["id"]).collect()]
    assert len(found) == 502 and set(found) == want
    buckets = {b for (b,) in new.select(stored.bucket_of(["id"], 16)).collect()}
    gone = {f.split("bucket=")[1].split("/")[0] for f in before.keys() - files().keys()}
    assert gone <= {str(b) for b in buckets} and len(buckets) <= 2 and before.keys() & files().keys()
    asked = stored.read(spark, path, ["id"], spark.createDataFrame([(7,), (7,), (9999,)], "id long"), 16)
    assert [tuple(r) for r in asked.collect()] == [(7, "a", 70)]
    scan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert stored.upsert_into(spark, path, new.limit(0), ["id"], ["v"], 16).count() == 0 and stored.read(spark, path, ["id"]).count() == 502
    with pytest.raises(ValueError):
        stored.write(spark.range(3).withColumnRenamed("id", "bucket"), path, ["bucket"])


def test_of_equally_new_sources_the_first_stays(spark):
    rows = spark.createDataFrame([(1, 7, "a", 2), (1, 7, "z", 3), (1, 7, "n", 1), (1, 6, "q", 0), (2, None, "x", 0), (2, 1, "y", 5), (3, 1, "o", 1)], "flight_id long, version int, note string, at long").repartition(3)
    got = {r.flight_id: (r.version, r.note) for r in ingest.by_flight(rows, [1, 2], ["at"]).collect()}
    assert got == {1: (7, "n"), 2: (1, "y")}
    assert {(r.flight_id, r.note) for r in ingest.by_flight(rows.drop("at"), [1, 3]).collect()} == {(1, "z"), (3, "o")}
