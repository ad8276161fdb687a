"""One way in for track files of every format: a row per file in, a row per fix out, a row with an error for a file that is refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.sources import igc, xmltracks
from skytrace.sources.xmltracks import BROKEN, MOST_BYTES, MOST_FIXES, inflated, kml_of_kmz

FIX = ["path", "idx", "t", "lat_e5", "lon_e5", "geo_dm", "pressure_dm", "tas_kmh", "error"]


def decoded(data: bytes) -> str:
    """The text of a log: UTF-8, else windows-1251."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp1251", errors="replace")


def _log_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in batch[["path", "content"]].itertuples(index=False):
            lines, error = [None], None
            try:
                if len(data) > MOST_BYTES:
                    raise ValueError("the file is too large")
                lines = decoded(inflated(bytes(data))).replace("\r\n", "\n").split("\n")
                if sum(x.startswith("B") for x in lines) > MOST_FIXES:
                    raise ValueError("too many fixes")
            except BROKEN as e:
                lines, error = [None], str(e) or type(e).__name__
            yield pd.DataFrame({"path": path, "n": range(len(lines)), "line": lines, "error": error})


def fixes_of(files: DataFrame) -> DataFrame:
    """(path, idx, t, lat_e5, lon_e5, geo_dm, pressure_dm, tas_kmh, error) of files (path, content), each by the ending of its path; of a
    file that breaks its format or a limit, has no fixes or an unknown ending, one row with an error."""
    files = files.select("path", xmltracks.format_of(F.regexp_replace("path", r"\.gz$", "")).alias("kind"), "content")
    lines = files.where("kind = 'igc'").select("path", "content").mapInPandas(_log_lines, "path string, n long, line string, error string")
    logs = igc.parse(lines.where("error is null").drop("error"))
    refused = lines.where("error is not null").select("path", "error")
    empty = lines.where("error is null").select("path").distinct().join(logs.select("path").distinct(), "path", "left_anti").withColumn("error", F.lit("no fixes"))
    unknown = files.where("kind is null").select("path", F.lit("unknown format").alias("error"))
    marked = files.where("kind in ('gpx', 'kml', 'kmz')").mapInPandas(xmltracks._parse_files, xmltracks.FIX)
    out = logs.select(FIX).unionByName(marked, allowMissingColumns=True)
    return out.unionByName(refused.unionByName(empty).unionByName(unknown), allowMissingColumns=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The fixes of every file below path."""
    return fixes_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, data in batch[["path", "content"]].itertuples(index=False):
            if path.lower().endswith(".kmz"):
                try:
                    path, data = path[:-4] + ".kml", kml_of_kmz(bytes(data))
                except BROKEN:
                    pass  # as it came; fixes_of() tells what is wrong with it
            out.append((path, bytes(data)))
        yield pd.DataFrame(out, columns=["path", "content"])


def stored_form(files: DataFrame) -> DataFrame:
    """files (path, content) as they are kept: a KMZ as the KML within."""
    return files.select("path", "content").mapInPandas(_stored, "path string, content binary")


def by_flight(sources: DataFrame, flight_ids: list[int], order: list[str] | None = None) -> DataFrame:
    """The newest stored source of some flights; of equals the first in `order`, or else the one of the greatest values. sources: (flight_id,
    version, ...), versions numbers."""
    order = order or []
    rest = [c for c in sources.columns if c not in ("flight_id", *order)]
    if order:
        newest = F.min(F.struct(F.col("version").isNull(), -F.col("version"), *order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_s")
    else:
        newest = F.max(F.struct("version", *[F.col(c).alias(f"_{c}") for c in rest if c != "version"], F.col("version").alias("_version"))).alias("_s")
    found = sources.where(F.col("flight_id").isin(flight_ids)).groupBy("flight_id").agg(newest)
    return found.select("flight_id", *[F.col(f"_s._{c}").alias(c) for c in rest])
