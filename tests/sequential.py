"""The detector and the filters told fix by fix, as a plain program would: what the relations of cleaning and detection are held against."""

from __future__ import annotations

import numpy as np
import pandas as pd

from skytrace.operators.cleaning import GAP_S, MOST_MPS, MOST_PIECES, SLIP_FIXES
from skytrace.operators.detection import ALTITUDE_FIXES, ALTITUDE_RANGE_DM, ALTITUDE_VALUES, FLIGHT_S, GO_ON_MPS, GROUND_MPS, GROUND_S, HALF_PERIOD_S, PLAIN_KMH, RIGHT, SHORT_STOP_S, START_CHANCES, START_MPS, STAY


def haversine_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a1, o1, a2, o2 = (np.radians(np.asarray(x) / 1e5) for x in (lat1, lon1, lat2, lon2))
    half = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(half, 1)))


def flat_steps_m(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres between neighbours, equirectangular."""
    a, o = np.radians(lat / 1e5), np.radians(lon / 1e5)
    return 6_371_000.0 * np.hypot(np.diff(a), np.diff(o) * np.cos((a[1:] + a[:-1]) / 2))


def plausible(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Which fixes can be reached from the last one kept at less than MOST_MPS. If only the first step is out of reach, the first
    fix is the odd one. Runs of fixes that fit their neighbours are taken at once."""
    n, keep = len(t), np.ones(len(t), dtype=bool)
    if n < 2:
        return keep
    reach = lambda i, j: t[j] > t[i] and flat_steps_m(lat[[i, j]], lon[[i, j]])[0] / (t[j] - t[i]) < MOST_MPS
    dt = np.diff(t)
    fits = (dt > 0) & (flat_steps_m(lat, lon) < MOST_MPS * np.maximum(dt, 1))
    at = 1 if n > 2 and not fits[0] and fits[1] else 0
    keep[:at] = False
    breaks = np.flatnonzero(~fits)
    while True:
        k = np.searchsorted(breaks, at)
        if k == len(breaks):
            return keep
        at, i = int(breaks[k]), int(breaks[k]) + 1
        while i < n and not reach(at, i):
            keep[i] = False
            i += 1
        if i == n:
            return keep
        at = i


def has_shift(t: np.ndarray) -> bool:
    """Whether more than SLIP_FIXES fixes in a row lie at or before a time that ran backward."""
    i = 1
    while i < len(t):
        if t[i] >= t[i - 1]:
            i += 1
            continue
        later = np.flatnonzero(t[i:] > t[i - 1])
        run = int(later[0]) if len(later) else len(t) - i
        if run > SLIP_FIXES:
            return True
        i += run
    return False


def clean(fixes: pd.DataFrame) -> pd.DataFrame:
    """One flight's fixes (idx, t, lat_e5, lon_e5, geo_dm, pressure_dm), in order, without repeated times, slips, jumps and all but
    the longest flight. A track of more than MOST_PIECES shifted pieces, or without a flight among them, has no rows."""
    f = fixes.sort_values("idx", ignore_index=True)
    t = f["t"].to_numpy()
    f = f[np.append(True, t[1:] != t[:-1])[: len(f)]].reset_index(drop=True)
    t = f["t"].to_numpy()
    if not has_shift(t):
        forward = np.append(True, t[1:] > np.maximum.accumulate(t)[:-1])[: len(t)]
        return _longest_flight(f[forward].reset_index(drop=True))
    starts = np.append(0, np.flatnonzero(np.diff(t) < 0) + 1)
    pieces = [f.iloc[lo:hi] for lo, hi in zip(starts, np.append(starts[1:], len(f)))]
    if len(pieces) > MOST_PIECES:
        return f.iloc[:0]
    pieces.sort(key=lambda p: p["t"].iloc[0])
    best, longest = f.iloc[:0], -1
    for k in range(len(pieces)):
        chain = [pieces[k]]
        for piece in pieces[k + 1 :]:
            if piece["t"].iloc[0] > chain[-1]["t"].iloc[-1]:
                chain.append(piece)
        one = _longest_flight(pd.concat(chain, ignore_index=True))
        window = flight_window(one)
        if window is not None and (length := one["t"].iloc[window[1]] - one["t"].iloc[window[0]]) > longest:
            best, longest = one, length
    return best


def _longest_flight(f: pd.DataFrame) -> pd.DataFrame:
    f = f[plausible(*(f[c].to_numpy() for c in ("t", "lat_e5", "lon_e5")))].reset_index(drop=True)
    cuts = np.flatnonzero(np.diff(f["t"].to_numpy()) > GAP_S) + 1
    if not len(cuts):
        return f
    best, longest = f, -1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(f))):
        part = f.iloc[lo:hi].reset_index(drop=True)
        window = flight_window(part)
        if window is not None and (length := part["t"].iloc[window[1]] - part["t"].iloc[window[0]]) > longest:
            best, longest = part, length
    return best


def flight_window(f: pd.DataFrame) -> tuple[int, int] | None:
    """(takeoff, landing) rows of the flight in one track, or None."""
    if len(f) < 2:
        return None
    t, lat, lon = (f[c].to_numpy() for c in ("t", "lat_e5", "lon_e5"))
    for name in ("pressure_dm", "geo_dm"):
        z = f[name]
        if z.notna().all() and len(z) >= ALTITUDE_FIXES and z.max() - z.min() >= ALTITUDE_RANGE_DM and z.nunique() >= ALTITUDE_VALUES:
            found = _by_altitude(t, lat, lon, z.to_numpy(dtype=float) / 10)
            return found if found is not None else _by_speed(t, lat, lon)
    return _by_speed(t, lat, lon)


def _smooth(t: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Means from the last fix HALF_PERIOD_S or more before each to the first as much after it, by prefix sums."""
    n = len(t)
    lo = np.maximum(np.searchsorted(t, t - HALF_PERIOD_S, side="right") - 1, 0)
    hi = np.minimum(np.searchsorted(t, t + HALF_PERIOD_S, side="left"), n - 1)
    return [(np.append(0, np.cumsum(v))[hi + 1] - np.append(0, np.cumsum(v))[lo]) / (hi - lo + 1) for v in values]


def _lasting(t: np.ndarray, begins: np.ndarray, goes_on: np.ndarray, seconds: int) -> np.ndarray:
    """Fixes of runs that begin where `begins` holds, last while `goes_on` does, and are longer than `seconds`; the last fix of a
    track is never tested. A fix that begins a run must keep it up too."""
    on, out = goes_on.copy(), np.zeros(len(t), dtype=bool)
    on[-1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    for lo, hi in zip(edges[::2], edges[1::2]):
        first = np.flatnonzero(begins[lo:hi])
        if len(first) and t[hi - 1] > t[lo + first[0]] + seconds:
            out[lo + first[0] : hi] = True
    return out


def _by_altitude(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, z: np.ndarray) -> tuple[int, int] | None:
    dt, steps = np.diff(t), flat_steps_m(lat, lon)
    with np.errstate(divide="ignore", invalid="ignore"):
        speeds = pd.DataFrame({"h": steps / dt, "v": np.diff(z) / dt})
    speeds[dt <= 0] = np.nan
    h, v = (np.append(0.0, speeds[c].ffill().fillna(0).to_numpy()) for c in ("h", "v"))
    h, v = _smooth(t, h, np.abs(v))
    flying = _lasting(t, (h > START_MPS[0]) & (v > START_MPS[1]), (h > GO_ON_MPS[0]) & (v > GO_ON_MPS[1]), FLIGHT_S)
    slow = (h < GROUND_MPS[0]) & (v < GROUND_MPS[1])
    ground = np.flatnonzero(_lasting(t, slow, slow, GROUND_S))
    path, n, best, i = np.append(0, np.cumsum(steps)), len(t), None, 0
    while len(up := np.flatnonzero(flying[i : n - 1])):
        at = i + int(up[0])
        k = np.searchsorted(ground, at, side="right")
        takeoff = int(ground[k - 1]) if k else 0
        k = np.searchsorted(ground, at)
        landing = max(at, min(int(ground[k]) if k < len(ground) else n - 2, n - 2))
        far = path[landing] - path[takeoff]
        if best is None or far >= best[0]:
            best = (far, takeoff, landing)
        i = landing + 1
    return best and best[1:]


def likeliest_states(signs: np.ndarray) -> np.ndarray:
    """The likeliest path through two states that tend to stay and mostly show their own sign. A state keeps its predecessor's
    unless changing pays; of equal ends the second."""
    stay, change, right, wrong = np.log([STAY, 1 - STAY, RIGHT, 1 - RIGHT])
    a, b = np.log(START_CHANCES[0]) + (wrong if signs[0] else right), np.log(START_CHANCES[1]) + (right if signs[0] else wrong)
    came = np.zeros((len(signs), 2), dtype=np.int8)
    for i, s in enumerate(signs[1:].tolist(), 1):
        ra, rb = (wrong, right) if s else (right, wrong)
        came[i] = (a + stay < b + change, a + change < b + stay)
        a, b = max(a + stay, b + change) + ra, max(a + change, b + stay) + rb
    out = np.zeros(len(signs), dtype=np.int8)
    out[-1] = b >= a
    for i in range(len(signs) - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def _by_speed(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[int, int] | None:
    dt = np.diff(t)
    km = haversine_km(lat[:-1], lon[:-1], lat[1:], lon[1:])
    fast = (dt > 0) & (km * 3600 > PLAIN_KMH * np.maximum(dt, 1))
    flying = likeliest_states(np.append(fast[0], fast)).astype(bool)
    edges = np.flatnonzero(np.diff(flying.astype(np.int8))) + 1
    for lo, hi in zip(edges, edges[1:]):
        if not flying[lo] and t[hi] - t[lo] < SHORT_STOP_S:
            flying[lo:hi] = True
    up, down = np.flatnonzero(flying), np.flatnonzero(flying[:-1] & ~flying[1:]) + 1
    if not len(up):
        return None
    return int(up[0]), int(down[-1]) if len(down) else len(t) - 1
