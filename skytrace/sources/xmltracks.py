"""GPX, KML and KMZ tracks, gzipped or not: a row per file in, a row per fix out."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F

# Most bytes of an upload and of what it inflates to, and most fixes of a track.
MOST_BYTES, MOST_INFLATED, MOST_FIXES = 2 << 20, 32 << 20, 300_000
#: The last second of year 9999, and the most decimetres that a column holds.
LAST_T, MOST_DM = 253_402_300_799, (1 << 31) - 1
#: What parsing raises on a file that is broken in whatever way: it is one row with an error, and the files beside it are read.
BROKEN = (ValueError, LookupError, ArithmeticError, EOFError, OSError, RuntimeError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error)
FORMATS = {"igc": "igc", "gpx": "gpx", "kml": "kml", "kmz": "kmz"}
#: What _parse_files gives.
FIX = "path string, idx long, t long, lat_e5 int, lon_e5 int, geo_dm int, error string"


def format_of(path: F.Column) -> F.Column:
    """A file's format by its ending, whatever its case; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), ending)


def inflated(data: bytes, most: int = MOST_INFLATED) -> bytes:
    """Gzipped bytes inflated, others as they are; ValueError beyond `most`."""
    if data[:2] != b"\x1f\x8b":
        return data
    inflate = zlib.decompressobj(31)
    out = inflate.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError("inflates to too much")
    if not inflate.eof:
        raise ValueError("gzip data ends early")
    return out


def kml_of_kmz(data: bytes, most: int = MOST_INFLATED) -> bytes:
    """doc.kml of the archive's root, else its first .kml."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        name = next((n for n in names if n.lower() == "doc.kml"), next(iter(names), None))
        if name is None:
            raise ValueError("no KML in the archive")
        with z.open(name) as f:
            out = f.read(most + 1)
    if len(out) > most:
        raise ValueError("inflates to too much")
    return out


def instant(text: str) -> int:
    """Epoch seconds of an RFC 3339 time or of GPSBabel's 2024/05/01 12:00:00+00."""
    text = re.sub(r"^(\d{4})/(\d\d)/(\d\d) ", r"\1-\2-\3T", text.strip())
    text = re.sub(r"([+-]\d\d)(\d\d)?$", lambda m: f"{m[1]}:{m[2] or '00'}", text) if not re.search(r"[+-]\d\d:\d\d$", text) and "T" in text and re.search(r"T.*[+-]\d\d(\d\d)?$", text) else text
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def _away(x: float) -> int:
    """Rounded, halves away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def _fix(t: int, lat: str, lon: str, ele: str | None) -> tuple[int, int, int, int]:
    a, o = float(lat), float(lon)
    if not (abs(a) <= 90 and abs(o) <= 180):
        raise ValueError("a position off the globe")
    z = float(ele or 0) * 10
    if not abs(z) <= MOST_DM - 1:
        raise ValueError("an elevation out of range")
    if not abs(t) <= LAST_T:
        raise ValueError("a time out of range")
    return t, _away(a * 1e5), _away(o * 1e5), _away(z)


def _named(node: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    """Descendants by local name, in document order."""
    return (x for x in node.iter() if isinstance(x.tag, str) and x.tag.rpartition("}")[2] in names)


def _text(node: ElementTree.Element, name: str) -> str | None:
    found = next(_named(node, name), None)
    return None if found is None else (found.text or "").strip()


def parse_gpx(data: bytes) -> list[tuple[int, int, int, int]]:
    """Every trkpt; each needs a position and a time, the elevation is 0 where there is none."""
    return [_fix(instant(_text(p, "time") or ""), p.attrib["lat"], p.attrib["lon"], _text(p, "ele")) for p in _named(ElementTree.fromstring(data), "trkpt")]


def _seconds_kml(root: ElementTree.Element) -> list[tuple[int, int, int, int]]:
    for mark in _named(root, "Placemark"):
        meta = next((m for m in _named(mark, "Metadata") if m.get("type") == "track"), None)
        info = None if meta is None else next(_named(meta, "FsInfo"), None)
        if info is None:
            continue
        start, offsets = instant(info.attrib["time_of_first_point"]), (_text(info, "SecondsFromTimeOfFirstPoint") or "").split()
        places = [c.split(",") for c in (_text(mark, "coordinates") or "").split()]
        if len(places) != len(offsets):
            raise ValueError("as many times as places are needed")
        return [_fix(start + int(s), p[1], p[0], p[2] if len(p) > 2 else None) for s, p in zip(offsets, places)]
    return []


def _track_kml(root: ElementTree.Element) -> list[tuple[int, int, int, int]]:
    out = []
    for track in _named(root, "Track"):
        times, places = [w.text or "" for w in _named(track, "when")], [(c.text or "").split() for c in _named(track, "coord")]
        if len(times) != len(places):
            raise ValueError("as many times as places are needed")
        out += [_fix(instant(t), p[1], p[0], p[2] if len(p) > 2 else None) for t, p in zip(times, places)]
    return out


def _points_kml(root: ElementTree.Element) -> list[tuple[int, int, int, int]]:
    out, first = [], None
    for folder in _named(root, "Folder"):
        if _text(folder, "name") != "track_points":
            continue
        for mark in _named(folder, "Placemark"):
            data = {d.get("name"): (d.text or "").strip() for d in _named(mark, "SimpleData")}
            first = data.get("track_fid") if first is None else first
            if data.get("track_fid") == first:
                place = (_text(mark, "coordinates") or "").split(",")
                out.append(_fix(instant(data["time"]), place[1], place[0], data.get("ele") or (place[2] if len(place) > 2 else None)))
    return out


def parse_kml(data: bytes) -> list[tuple[int, int, int, int]]:
    """The first of three layouts that has fixes: offsets from the first point, gx:Track, a folder of track points (first track)."""
    root = ElementTree.fromstring(data)
    return next((found for read in (_seconds_kml, _track_kml, _points_kml) if (found := read(root))), [])


def parse(kind: str, data: bytes) -> list[tuple[int, int, int, int]]:
    if len(data) > MOST_BYTES:
        raise ValueError("the file is too large")
    data = inflated(data)
    fixes = parse_gpx(data) if kind == "gpx" else parse_kml(kml_of_kmz(data) if kind == "kmz" else data)
    if not fixes or len(fixes) > MOST_FIXES:
        raise ValueError("no fixes" if not fixes else "too many fixes")
    return fixes


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, kind, data in batch[["path", "kind", "content"]].itertuples(index=False):
            try:
                rows = parse(kind, bytes(data))
            except BROKEN as e:
                yield pd.DataFrame({"path": [path], "idx": [None], "t": [None], "lat_e5": [None], "lon_e5": [None], "geo_dm": [None], "error": [str(e) or type(e).__name__]})
                continue
            yield pd.DataFrame(rows, columns=["t", "lat_e5", "lon_e5", "geo_dm"]).assign(path=path, idx=range(len(rows)), error=None)
