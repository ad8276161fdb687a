"""Queries over track files, digests, logs and rasters, with their SQL."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.functions import geo
from skytrace.operators import charts, tiles
from skytrace.plans.tables import FIXES, fixes, haversine_sql, igc_e5_sql, table
from skytrace.sources import codec, igc, ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as the bytes of a file: logs in windows-1251, zipped for .kmz, gzipped for .gz, cut short for x.igc.gz."""
    for batch in batches:
        out = []
        for path, text in batch[["path", "text"]].itertuples(index=False):
            data = text.encode("cp1251" if path.endswith(".igc") else "utf-8")
            if path.endswith(".kmz"):
                made = io.BytesIO()
                with zipfile.ZipFile(made, "w") as z:
                    z.writestr("doc.kml", data)
                data = made.getvalue()
            data = gzip.compress(data) if path.endswith(".gz") else data
            out.append((path, data[: len(data) // 2] if path.endswith("x.igc.gz") else data))
        yield pd.DataFrame(out, columns=["path", "content"])


#: File names by flight_id % 11: the last three are a log, one that is gzipped, and one that breaks off; i.gpx has an infinite elevation.
ENDINGS = ("a.gpx", "b.KML", "c.kml", "d.kml", "e.kmz", "f.gpx.gz", "g.txt", "i.gpx", "j.igc", "k.igc.gz", "x.igc.gz")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per flight, in all layouts of GPX and KML and as logs."""
    f = fixes(spark, sf_dir)
    lat, lon, ele = (F.format_string(form, F.col(c) / by) for form, c, by in (("%.5f", "lat_e5", 1e5), ("%.5f", "lon_e5", 1e5), ("%.1f", "alt_dm", 10.0)))
    at = F.timestamp_seconds("t")
    rfc, babel = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy/MM/dd HH:mm:ss'+00'")
    place = F.concat(lon, F.lit(","), lat, F.lit(","), ele)
    gpx = F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), lon, F.lit('"><ele>'), ele, F.lit("</ele><time>"), rfc, F.lit("</time></trkpt>"))
    track = F.concat(F.lit("<when>"), rfc, F.lit("</when><gx:coord>"), F.translate(place, ",", " "), F.lit("</gx:coord>"))
    point = F.concat(F.lit('<Placemark><SchemaData><SimpleData name="track_fid">0</SimpleData><SimpleData name="ele">'), ele, F.lit('</SimpleData><SimpleData name="time">'), babel, F.lit("</SimpleData></SchemaData><Point><coordinates>"), place, F.lit("</coordinates></Point></Placemark>"))
    rows = f.select("flight_id", "idx", "t", gpx.alias("gpx"), track.alias("track"), point.alias("point"), place.alias("place"))
    listed = rows.groupBy("flight_id").agg(F.min(F.struct("idx", "t"))["t"].alias("t0"), F.array_sort(F.collect_list(F.struct("idx", "t", "gpx", "track", "point", "place"))).alias("l"))
    body = lambda c, by="": F.array_join(F.col(f"l.{c}"), by)
    kml = lambda inner: F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'), inner, F.lit("</Document></kml>"))
    seconds = F.array_join(F.transform("l", lambda x: (x["t"] - F.col("t0")).cast("string")), " ")
    dump = kml(F.concat(F.lit('<Placemark><Metadata type="track"><FsInfo time_of_first_point="'), F.date_format(F.timestamp_seconds("t0"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"><SecondsFromTimeOfFirstPoint>'), seconds, F.lit("</SecondsFromTimeOfFirstPoint></FsInfo></Metadata><LineString><coordinates>"), body("place", " "), F.lit("</coordinates></LineString></Placemark>")))
    gx, folder = kml(F.concat(F.lit("<Placemark><gx:Track>"), body("track"), F.lit("</gx:Track></Placemark>"))), kml(F.concat(F.lit("<Folder><name>track_points</name>"), body("point"), F.lit("</Folder>")))
    whole = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'), body("gpx"), F.lit("</trkseg></trk></gpx>"))
    which = F.col("flight_id") % 11
    logged = f.where("flight_id % 11 > 7").select("flight_id", "idx", F.expr("1700000000 + t div 500 % 100000000").alias("t"), "lat_e5", "lon_e5", F.col("alt_dm").alias("geo_dm"), F.lit(None).cast("int").alias("pressure_dm"), F.lit(None).cast("int").alias("tas_kmh"))
    listed = listed.join(igc.compose(logged, "AXSKYTRACE\nHFPLTПилот"), "flight_id", "left")
    odd = F.regexp_replace(whole, "<ele>[^<]*</ele>", "<ele>inf</ele>")
    text = F.when(which.isin(1, 4), dump).when(which == 2, gx).when(which == 3, folder).when(which == 7, odd).when(which > 7, F.col("igc")).otherwise(whole)
    path = F.concat(F.lit("flights/"), F.col("flight_id").cast("string"), F.element_at(F.array(*map(F.lit, ENDINGS)), (which + 1).cast("int")))
    return listed.select(path.alias("path"), text.alias("text")).mapInPandas(_wrapped, "path string, content binary")


_PATH = f"'flights/' || flight_id || {list(ENDINGS)}[(flight_id % 11 + 1)::INT]"


@query(f"""WITH {FIXES} SELECT {_PATH} AS path, idx, t, lat_e5, lon_e5, alt_dm AS geo_dm, CAST(NULL AS VARCHAR) AS error FROM fixes WHERE flight_id % 11 < 6
UNION ALL SELECT {_PATH}, idx, 1_700_000_000 + t // 500 % 100_000_000, CAST({igc_e5_sql("lat_e5")} AS INT), CAST({igc_e5_sql("lon_e5")} AS INT), CAST(alt_dm // 10 * 10 AS INT), NULL FROM fixes WHERE flight_id % 11 IN (8, 9)
UNION ALL SELECT DISTINCT {_PATH}, NULL, NULL, NULL, NULL, NULL, CASE flight_id % 11 WHEN 6 THEN 'unknown format' WHEN 7 THEN 'an elevation out of range' ELSE 'gzip data ends early' END FROM fixes WHERE flight_id % 11 IN (6, 7, 10)""")
def track_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flight written as a GPX, KML, KMZ or IGC file of some layout, zipped or not, broken ones among them, and read again by the
    ending of its name."""
    return ingest.fixes_of(_files(spark, sf_dir)).select("path", "idx", "t", "lat_e5", "lon_e5", "geo_dm", "error")


@query(f"""WITH {FIXES} SELECT regexp_replace({_PATH}, '\\.kmz$', '.kml') AS path, idx, t, lat_e5, lon_e5, alt_dm AS geo_dm FROM fixes WHERE flight_id % 11 = 4""")
def archives_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped tracks as they are kept, read again."""
    kept = ingest.stored_form(_files(spark, sf_dir).where(F.endswith("path", F.lit(".kmz"))))
    return ingest.fixes_of(kept).select("path", "idx", "t", "lat_e5", "lon_e5", "geo_dm")


_LOG = f"""{FIXES}, g AS (SELECT flight_id, idx, 1_700_000_000 + t // 500 % 100_000_000 AS t, alt_dm FROM fixes), w AS (SELECT flight_id, min(t) + 1000 AS a, max(t) - 1000 AS b FROM g GROUP BY 1)"""


@query(f"""WITH {_LOG} SELECT g.flight_id, (row_number() OVER (PARTITION BY g.flight_id ORDER BY idx) - 1) AS idx, t, CAST(alt_dm // 10 * 10 AS INT) AS geo_dm FROM g JOIN w USING (flight_id) WHERE t BETWEEN a AND b""")
def sliced_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of the stretches between takeoff and landing, read again."""
    t = F.expr("1700000000 + t div 500 % 100000000")
    f = fixes(spark, sf_dir).select("flight_id", "idx", t.alias("t"), "lat_e5", "lon_e5", F.col("alt_dm").alias("geo_dm"), F.lit(None).cast("int").alias("pressure_dm"), F.lit(None).cast("int").alias("tas_kmh"))
    w = f.groupBy("flight_id").agg((F.min("t") + 1_000).alias("takeoff_t"), (F.max("t") - 1_000).alias("landing_t"))
    lines = charts.sliced_logs(f, w).select(F.col("flight_id").cast("string").alias("path"), F.posexplode(F.split("igc", "\n")).alias("n", "line"))
    return igc.parse(lines).select(F.col("path").cast("long").alias("flight_id"), "idx", "t", "geo_dm")


@query("""SELECT c_custkey AS user_id, list_reduce([2166136261] || list_transform(range(1, len(c_name) + 1), lambda i: ascii(substr(c_name, i::INT, 1))::BIGINT), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS digest FROM customer""")
def blob_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of names' bytes."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), codec.fnv1a(F.col("c_name").cast("binary")).alias("digest"))


@query("""SELECT l_orderkey AS flight_id, max(l_linenumber) AS version, arg_max(l_returnflag, l_linenumber) AS note FROM lineitem WHERE l_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) GROUP BY 1""")
def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stored source of some flights; of equals the first in the table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flight_id"), F.col("l_linenumber").alias("version"), F.col("l_returnflag").alias("note"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return ingest.by_flight(rows, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], ["file", "row"])


# --- rasters ----------------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 12 AS INT) AS z, p_partkey * 7 % (1 << (p_partkey % 12)::INT) AS x, p_partkey * 13 % (1 << (p_partkey % 12)::INT) AS y, p_size, p_retailprice AS price FROM part)
SELECT id, round((x / pow(2.0::DOUBLE, z) - 0.5) * 360, 6) AS west, round(degrees(atan(sinh((0.5 - (y + 1) / pow(2.0::DOUBLE, z)) * 2 * pi()))), 6) AS south, round(((x + 1) / pow(2.0::DOUBLE, z) - 0.5) * 360, 6) AS east, round(degrees(atan(sinh((0.5 - y / pow(2.0::DOUBLE, z)) * 2 * pi()))), 6) AS north,
CASE WHEN floor(360.0 / (p_size / 1000.0::DOUBLE) / 256) >= 1 THEN floor(log2(floor(360.0 / (p_size / 1000.0::DOUBLE) / 256)))::INT ELSE 0 END AS leaf,
CASE WHEN id % 5 = 0 THEN 0 WHEN id % 5 = 1 THEN 0 WHEN id % 5 = 2 THEN greatest(price - 1200, 0) ELSE least(price * 30, 32767) END AS metres, CASE WHEN id % 9 = 0 THEN -32768 ELSE (id % 200) * 256 + id % 100 + (id % 77) / 256.0::DOUBLE - 32768 END AS sample FROM p""")
def tile_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of tiles, leaf zooms of sources, and elevations from samples."""
    key = F.col("p_partkey")
    z = (key % 12).cast("int")
    n = F.pow(F.lit(2.0), z).cast("long")
    part = table(spark, sf_dir, "part").select(key.alias("id"), z.alias("z"), (key * 7 % n).alias("x"), (key * 13 % n).alias("y"), "p_size", "p_retailprice")
    which, price = F.col("id") % 5, F.col("p_retailprice")
    sample = F.when(which == 0, F.lit(None).cast("double")).when(which == 1, F.lit(float("nan"))).when(which == 2, price - 1200).otherwise(price * 30)
    by = lambda m: (F.col("id") % m).cast("double")
    out = part.select("id", tiles.tile_bounds(F.col("z"), F.col("x"), F.col("y")).alias("b"), tiles.leaf_zoom(F.col("p_size") / 1000.0).alias("leaf"), tiles.elevation(sample).alias("metres"), tiles.terrarium(by(200), by(100), by(77), F.when(F.col("id") % 9 == 0, 0).otherwise(255)).alias("sample"))
    return out.select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")], "leaf", "metres", "sample")


_CHUNK = """chunk AS (SELECT vec_id % 12 AS cx, vec_id // 12 AS cy, CAST((i - 1) // 8 AS INT) AS r, CAST((i - 1) % 8 AS INT) AS c, embedding[i]::DOUBLE * 1000 AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i) WHERE embedding IS NOT NULL),
px AS (SELECT CAST(cx * 8 + c AS INT) AS gx, CAST(cy * 8 + r AS INT) AS gy, CASE WHEN isfinite(v) AND round(v) > 0 THEN least(round(v), 32767) ELSE 0 END AS v FROM chunk),
reg AS (SELECT * FROM (VALUES (1, 3, 5, 20, 12), (2, 0, 0, 96, 96), (3, 40, 17, 33, 50)) t(region_id, x0, y0, w, h))"""


@query(f"""WITH {_CHUNK} SELECT region_id, CAST(gy - y0 AS INT) AS "row", CAST(gx - x0 AS INT) AS col, v AS value FROM px, reg WHERE gx >= x0 AND gx < x0 + w AND gy >= y0 AND gy < y0 + h""")
def regions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a tiled raster source, put together from the chunks that they touch."""
    chunks = table(spark, sf_dir, "embeddings").where("embedding is not null").select((F.col("vec_id") % 12).cast("int").alias("chunk_x"), F.expr("int(vec_id div 12)").alias("chunk_y"), F.transform("embedding", lambda v: v.cast("double") * 1000).alias("px"))
    regions = spark.createDataFrame([(1, 3, 5, 20, 12), (2, 0, 0, 96, 96), (3, 40, 17, 33, 50)], "region_id int, x0 int, y0 int, w int, h int")
    return tiles.region(chunks, regions, 8, 8)


@query(f"""WITH {_CHUNK}, r AS (SELECT region_id, CAST(gy - y0 AS INT) // 24 AS "row", CAST(gx - x0 AS INT) // 32 AS col, v FROM px, reg WHERE region_id = 2 AND gx >= x0 AND gx < x0 + w AND gy >= y0 AND gy < y0 + h)
SELECT region_id AS x, "row", col, round(avg(v)) AS value FROM r GROUP BY ALL""")
def regions_downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of 96 x 96 pixels on 3 x 4 cells, by area."""
    read = regions_read(spark, sf_dir).where("region_id = 2").select(F.lit(0).alias("z"), F.col("region_id").alias("x"), F.lit(0).alias("y"), "row", "col", "value")
    return tiles.resample(read, 96, 96, 4, 3).select("x", "row", "col", F.round("value").alias("value"))


@query("""WITH p AS (SELECT s_suppkey AS id, s_suppkey % 17 / 8.0::DOUBLE AS lo, s_suppkey % 17 / 8.0 + s_suppkey % 5 / 3.0::DOUBLE AS hi FROM supplier), s AS (SELECT id, (lo - 0.25) / 0.125 AS a, (hi - 0.25) / 0.125 AS b FROM p),
q AS (SELECT id, floor(CASE WHEN abs(a - round(a)) < 1e-6 THEN round(a) ELSE a END)::BIGINT AS f, ceil(CASE WHEN abs(b - round(b)) < 1e-6 THEN round(b) ELSE b END)::BIGINT AS l FROM s)
SELECT id, CASE WHEN f >= 0 AND l <= 20 AND l > f THEN f END AS first, CASE WHEN f >= 0 AND l <= 20 AND l > f THEN l - f END AS n FROM q""")
def pixel_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels along an axis that a range of degrees touches; none where it leaves the source."""
    key = F.col("s_suppkey")
    low, high = key % 17 / 8.0, key % 17 / 8.0 + key % 5 / 3.0
    region = tiles.pixel_region(low, high, F.lit(0.25), F.lit(0.125), F.lit(20))
    return table(spark, sf_dir, "supplier").select(key.alias("id"), region.alias("r")).select("id", F.col("r.first").alias("first"), F.col("r.count").alias("n"))


def _cross(*c: Column) -> Column:
    return geo.cross(*c)


@query(f"""WITH {FIXES}, l AS (SELECT flight_id, idx, lon_e5::DOUBLE AS px, lat_e5::DOUBLE AS py, lag(lon_e5, 1) OVER w::DOUBLE AS bx, lag(lat_e5, 1) OVER w::DOUBLE AS "by", lag(lon_e5, 2) OVER w::DOUBLE AS ax, lag(lat_e5, 2) OVER w::DOUBLE AS ay,
  lag(lat_e5, 1) OVER w AS la, lag(lon_e5, 1) OVER w AS lo, lat_e5, lon_e5 FROM fixes WINDOW w AS (PARTITION BY flight_id ORDER BY idx)),
d AS (SELECT *, bx - ax AS dx, "by" - ay AS dy, radians((lat_e5 + la) / 2e5) AS mid FROM l), t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS al FROM d)
SELECT flight_id, idx, round(dx * (py - ay) - dy * (px - ax), 3) AS twice_area, round(sqrt(pow(px - ax - al * dx, 2) + pow(py - ay - al * dy, 2)), 6) AS off,
round(sqrt(pow((111.13209 - 0.566605 * cos(2 * mid) + 0.0012 * cos(4 * mid)) * (lat_e5 - la) / 1e5, 2) + pow((111.41513 * cos(mid) - 0.09455 * cos(3 * mid) + 0.00012 * cos(5 * mid)) * (lon_e5 - lo) / 1e5, 2)), 6) AS fcc_km FROM t""")
def plane_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed areas, distances from a segment and FCC kilometres of neighbouring fixes."""
    from skytrace.operators.series import in_order

    lag = lambda c, k: F.lag(c, k).over(in_order())
    x, y = F.col("lon_e5").cast("double"), F.col("lat_e5").cast("double")
    ax, ay, bx, by = (lag(c, k).cast("double") for k in (2, 1) for c in ("lon_e5", "lat_e5"))
    f = fixes(spark, sf_dir)
    return f.select("flight_id", "idx", F.round(_cross(ax, ay, bx, by, x, y), 3).alias("twice_area"), F.round(geo.segment_distance_m(x, y, ax, ay, bx, by), 6).alias("off"), F.round(geo.fcc_distance_km(lag("lat_e5", 1), lag("lon_e5", 1), "lat_e5", "lon_e5"), 6).alias("fcc_km"))


@query(f"""WITH {FIXES}, l AS (SELECT *, lag(lat_e5) OVER w AS la, lag(lon_e5) OVER w AS lo FROM fixes WINDOW w AS (PARTITION BY flight_id ORDER BY idx))
SELECT flight_id, idx, CAST(round({haversine_sql("la", "lo", "lat_e5", "lon_e5")}) AS BIGINT) AS leg_m, CAST(round((lat_e5 - 4610000) / 7 * 1e5) AS INT) AS e5, CAST(round((alt_dm - 5000) / 3 * 10) AS INT) AS dm FROM l""")
def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs between neighbouring fixes in whole metres; degrees and metres in the units that tracks are kept in."""
    from skytrace.operators.series import in_order

    lag = lambda c: F.lag(c).over(in_order())
    leg = geo.leg_m(lag("lat_e5"), lag("lon_e5"), "lat_e5", "lon_e5")
    e5, dm = geo.to_e5((F.col("lat_e5") - 4_610_000) / 7), geo.decimetres((F.col("alt_dm") - 5_000) / 3)
    return fixes(spark, sf_dir).select("flight_id", "idx", leg.alias("leg_m"), e5.alias("e5"), dm.alias("dm"))
