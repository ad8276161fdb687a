"""Simplification, hulls and routes of one flight, as a plain program would: what the relations of outline, distance, triangles and
scoring are held against.

Free distance is the longest way over five fixes in order. A triangle is three fixes in order whose perimeter, less the gap between
the closest fixes before the first and after the last, is largest. Triangles of short tracks are searched exhaustively, with matrices over
all pairs of turnpoints. Of long ones a first is found over a simplified track; then all triples of blocks of fixes whose bounds could
hold a better one are halved, down to small blocks that are searched exhaustively. `optimal` tells whether that came to its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RADIUS_M = 6_371_000.0


def haversine_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a1, o1, a2, o2 = (np.radians(np.asarray(x) / 1e5) for x in (lat1, lon1, lat2, lon2))
    half = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * RADIUS_M / 1000 * np.arcsin(np.sqrt(np.minimum(half, 1)))


def fcc_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Kilometres by FCC rule 73.208."""
    mid = np.radians((np.asarray(lat1) + lat2) / 2e5)
    # Kilometres per degree as a cosine series of the mean latitude.
    dy = (111.13209 - 0.566605 * np.cos(2 * mid) + 0.0012 * np.cos(4 * mid)) * (lat2 - np.asarray(lat1)) / 1e5
    dx = (111.41513 * np.cos(mid) - 0.09455 * np.cos(3 * mid) + 0.00012 * np.cos(5 * mid)) * (lon2 - np.asarray(lon1)) / 1e5
    return np.hypot(dx, dy)


def plane_m(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Fixes on a local plane in metres, each with its own cosine."""
    a, o = np.radians(lat / 1e5), np.radians(lon / 1e5)
    return RADIUS_M * np.stack([(o - o.mean()) * np.cos(a), a - a.mean()], axis=1)


# --- simplification and hulls -----------------------------------------------------------------------------------------------------


def simplify(xy: np.ndarray, tolerance_m: float, chord_m: float | None = None, most: int | None = None) -> np.ndarray | None:
    """Rows that a Ramer-Douglas-Peucker pass keeps, with the chord cap: a longer chord is halved by index. None where more than
    `most` rows would be kept."""
    n = len(xy)
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    kept, todo = 2, [(0, n - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        base = xy[hi] - xy[lo]
        rel = xy[lo + 1 : hi] - xy[lo]
        length = base @ base
        along = np.clip(rel @ base / length, 0, 1) if length > 0 else np.zeros(len(rel))
        off = ((rel - along[:, None] * base) ** 2).sum(axis=1)
        far = int(off.argmax())
        if off[far] > tolerance_m**2:
            at = lo + 1 + far
        elif chord_m is not None and length > chord_m**2:
            at = (lo + hi) // 2
        else:
            continue
        keep[at] = True
        kept += 1
        if most is not None and kept > most:
            return None
        todo += [(lo, at), (at, hi)]
    return np.flatnonzero(keep)


def simplify_to(xy: np.ndarray, fewest: int, most: int, low_m: float, high_m: float) -> np.ndarray:
    """Rows of a simplification that keeps from fewest to most, by twelve bisections of the tolerance; else the fullest that keeps
    fewer; else all rows."""
    best = None
    for _ in range(12 if len(xy) > 2 else 0):
        tolerance = (low_m + high_m) / 2
        rows = simplify(xy, tolerance, most=most)
        if rows is None:
            low_m = tolerance
        elif len(rows) >= min(fewest, len(xy)):
            return rows
        else:
            high_m = tolerance
            best = rows if best is None or len(rows) > len(best) else best
    return best if best is not None else np.arange(len(xy))


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, without points on its sides."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(xy) + chain(xy[::-1]))


def aspect_ratio(lat: np.ndarray, lon: np.ndarray) -> float | None:
    """Sides' ratio of the smallest rectangle, at any angle, around a track simplified to 100 m; None for a point."""
    if len(lat) < 3:
        return None
    xy = plane_m(lat, lon)
    corners = hull(xy[simplify(xy, 100.0)])
    if len(corners) < 2:
        return None
    edges = np.roll(corners, -1, axis=0) - corners
    unit = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    across = np.stack([-unit[:, 1], unit[:, 0]], axis=1)
    sides = np.stack([np.ptp(corners @ unit.T, axis=0), np.ptp(corners @ across.T, axis=0)])
    one, two = sides[:, sides.prod(axis=0).argmin()]
    return float("inf") if min(one, two) <= 1e-9 * max(one, two) else float(max(one, two) / min(one, two))


# --- free distance ----------------------------------------------------------------------------------------------------------------

# Points to search among, the spread allowed, tolerances of the simplification in metres; the first window around
# turnpoints in percent of the track; from how few fixes on the search is the last.
FD_POINTS, FD_SPREAD, FD_LOW_M, FD_HIGH_M, FD_WINDOW, FD_LAST = 500, 0.1, 25.0, 500.0, 1.5, 150


def longest_way(lat: np.ndarray, lon: np.ndarray, rows: np.ndarray, turns: int = 5) -> np.ndarray | None:
    """The rows of the longest way over `turns` of them in order: best ways to each row, one leg more at a time."""
    if len(rows) < turns:
        return None
    a, o = lat[rows], lon[rows]
    legs = fcc_km(a[:, None], o[:, None], a[None], o[None])
    legs[np.tril_indices(len(rows))] = -np.inf  # a leg goes forward
    best, came = np.zeros(len(rows)), []
    for _ in range(turns - 1):
        ways = best[:, None] + legs
        came.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    at = len(best) - 1 - int(best[::-1].argmax())
    if not best[at] > 0:
        return None
    way = [at]
    for back in reversed(came):
        way.append(int(back[way[-1]]))
    return rows[way[::-1]]


def free_distance(lat: np.ndarray, lon: np.ndarray) -> np.ndarray | None:
    """Rows of the five turnpoints: searched on a simplified track, then again within ever narrower windows around them."""
    moved = np.flatnonzero(np.append(True, (np.diff(lat) != 0) | (np.diff(lon) != 0)))
    a, o = lat[moved], lon[moved]
    fewest, most = int(FD_POINTS * (1 - FD_SPREAD)), int(FD_POINTS * (1 + FD_SPREAD))
    if 5 <= len(moved) < FD_LAST:  # few enough for the last search at once
        way = longest_way(a, o, np.arange(len(moved)))
        return None if way is None else moved[way]
    thinned = lambda rows: rows[simplify_to(plane_m(a[rows], o[rows]), fewest, most, FD_LOW_M, FD_HIGH_M)]
    if len(moved) < 5:
        return None
    way, window = longest_way(a, o, thinned(np.arange(len(moved)))), FD_WINDOW
    while way is not None:
        reach = max(1, int(np.ceil(len(moved) * window / 100)))
        rows = np.unique(np.concatenate([np.arange(max(0, w - reach), min(len(moved), w + reach + 1)) for w in way]))
        if len(rows) < FD_LAST:
            way = longest_way(a, o, rows)
            return None if way is None else moved[way]
        way, window = longest_way(a, o, thinned(rows)), window / 2
    return None


# --- triangles --------------------------------------------------------------------------------------------------------------------

# Largest gap of an open and of a closed triangle and of a probe, as shares of the perimeter; factors of each kind;
# least side of an FAI triangle as a share, and in km; what makes each kind worth a search.
GAPS = {"olc_open": 0.2, "olc_closed": 0.05}
PROBE_GAP = 0.25
FACTORS = {("fai_triangle", "olc_open"): 1.4, ("fai_triangle", "olc_closed"): 1.6, ("free_triangle", "olc_open"): 1.2, ("free_triangle", "olc_closed"): 1.4}
FAI_SIDE, FAI_SIDE_KM, FAI_LEAST_FD_M, FAI_MOST_ASPECT, FAI_LEAST_M, FAI_TO_FD = 0.28, 1.4, 5_000, 7.0, 10_000, 0.25
FREE_PROBE_TO_FD, FREE_TO_FD = 0.5, 0.25
#: Turnpoints of an exhaustive search, and fixes among which the first gap is searched; the least fixes of a block, the most blocks of a
#: track, and the most triples of blocks that are held at once.
CORNERS, GAP_FIXES = 160, 1_200
BLOCK_FIXES, MOST_BLOCKS, MOST_TRIPLES = 16, 2_048, 1 << 21


@dataclass
class Triangle:
    turns: tuple[int, int, int]
    gap: tuple[int, int]
    perimeter_km: float
    gap_km: float
    optimal: bool = True


def _pairs_km(lat: np.ndarray, lon: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return haversine_km(lat[a][:, None], lon[a][:, None], lat[b][None], lon[b][None])


def _gaps(lat: np.ndarray, lon: np.ndarray, corners: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For corners i and k: the least distance from a row up to i to a row from k on."""
    d = _pairs_km(lat, lon, rows, rows)
    d = np.minimum.accumulate(np.minimum.accumulate(d, axis=0)[:, ::-1], axis=1)[:, ::-1]
    at = np.searchsorted(rows, corners)
    return d[np.ix_(at, at)]


def best_triangle(lat: np.ndarray, lon: np.ndarray, most_gap: float, side: float = 0.0, side_km: float = 0.0) -> Triangle | None:
    """The triangle of largest perimeter less gap whose gap is at most a share of the perimeter and whose sides are long enough."""
    n = len(lat)
    if n < 3:
        return None
    xy = plane_m(lat, lon)
    corners = np.arange(n) if n <= CORNERS else simplify_to(xy, CORNERS * 9 // 10, CORNERS, 0.0, 5_000.0)
    if len(corners) > CORNERS:
        corners = corners[np.unique(np.linspace(0, len(corners) - 1, CORNERS).astype(int))]
    rows = np.arange(n) if n <= GAP_FIXES else np.union1d(corners, np.linspace(0, n - 1, GAP_FIXES - CORNERS).astype(int))
    legs, gaps = _pairs_km(lat, lon, corners, corners), _gaps(lat, lon, corners, rows)
    # A larger gap may be allowed while moving the corners than in the end, as corners are coarse.
    slack = 1.0 if n <= CORNERS else 1.15
    best, found = 0.0, None
    m, after = len(corners), np.triu(np.ones((len(corners), len(corners)), dtype=bool), 1)
    for i in range(m - 2):
        ab, bc, ca = legs[i, i + 1 :, None], legs[i + 1 :, i + 1 :], legs[i, None, i + 1 :]
        total, gap = ab + bc + ca, gaps[i, None, i + 1 :]
        least = np.minimum(np.minimum(ab, bc), ca) * slack
        fits = after[i + 1 :, i + 1 :] & (gap <= most_gap * total * slack) & (least >= side * total) & (least >= side_km)
        value = np.where(fits, total - gap, 0.0)
        at = int(value.argmax())
        if value.flat[at] > best:
            best, (j, k) = float(value.flat[at]), np.unravel_index(at, value.shape)
            found = (i, i + 1 + int(j), i + 1 + int(k))
    first = None
    if found is not None:
        turns = [int(corners[x]) for x in found]
        if n > CORNERS:
            turns = _moved(lat, lon, turns, corners, rows, most_gap, side, side_km)
        first = _measured(lat, lon, turns, most_gap, side, side_km)
    return first if n <= CORNERS else _improved(lat, lon, first, most_gap, side, side_km)


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Fixes on the unit sphere: the closer two are, the larger their product."""
    a, o = np.radians(lat / 1e5), np.radians(lon / 1e5)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def _product_km(product: np.ndarray) -> np.ndarray:
    return 2 * RADIUS_M / 1000 * np.arcsin(np.minimum(np.sqrt(np.maximum(2 - 2 * product, 0)) / 2, 1))


def _measured(lat: np.ndarray, lon: np.ndarray, turns: list[int], most_gap: float, side: float, side_km: float) -> Triangle | None:
    """The triangle over these fixes with its closest gap over all fixes, if it is valid."""
    a, b, c = turns
    legs = [float(haversine_km(lat[x], lon[x], lat[y], lon[y])) for x, y in ((a, b), (b, c), (c, a))]
    unit, least, pair = _unit(lat, lon), np.inf, (a, c)
    late = unit[c:]
    for lo in range(0, a + 1, 512):
        near = unit[lo : min(a + 1, lo + 512)] @ late.T
        q, w = np.unravel_index(int(near.argmax()), near.shape)
        d = float(haversine_km(lat[lo + q], lon[lo + q], lat[c + w], lon[c + w]))
        if d < least:
            least, pair = d, (int(lo + q), int(c + w))
    total = sum(legs)
    valid = least <= most_gap * total and min(legs) >= side * total and min(legs) >= side_km
    return Triangle((a, b, c), pair, total, least) if valid and total > least else None


class _Blocks:
    """Blocks of a track's fixes, and on every level above pairs of them: boxes, and the closest fixes before and after."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        n = len(lat)
        self.size = max(BLOCK_FIXES, -(-n // MOST_BLOCKS))
        self.unit, self.starts = _unit(lat, lon), np.arange(0, n, self.size)
        self.n = len(self.starts)
        # closest[a, c]: the largest product of a fix up to the end of block a with one from the start of block c on.
        self.closest, so_far = np.empty((self.n, self.n)), np.full(n, -2.0)
        for k, lo in enumerate(self.starts):
            so_far = np.maximum(so_far, (self.unit[lo : lo + self.size] @ self.unit.T).max(axis=0))
            self.closest[k] = np.maximum.accumulate(so_far[::-1])[::-1][self.starts]
        a, o = np.radians(lat / 1e5), np.radians(lon / 1e5)
        boxes = [f.reduceat(x, self.starts) for x in (a, o) for f in (np.minimum, np.maximum)]
        self.levels = [boxes]
        while len(self.levels[-1][0]) > 1:
            heads = np.arange(0, len(self.levels[-1][0]), 2)
            self.levels.append([f.reduceat(x, heads) for x, f in zip(self.levels[-1], (np.minimum, np.maximum) * 2)])

    def most_km(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """No two fixes of blocks p and q are further apart: a straight line in degrees, at the widest parallel between."""
        south, north, west, east = self.levels[level]
        dy = np.maximum(north[p] - south[q], north[q] - south[p])
        dx = np.maximum(east[p] - west[q], east[q] - west[p])
        lo, hi = np.minimum(south[p], south[q]), np.maximum(north[p], north[q])
        widest = np.cos(np.where((lo < 0) & (hi > 0), 0, np.minimum(np.abs(lo), np.abs(hi))))
        return RADIUS_M / 1000 * np.hypot(dy, dx * widest)

    def least_gap_km(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """No gap of a triangle from block p to block q is smaller, but for a metre of rounding."""
        last = np.minimum((p + 1) << level, self.n) - 1
        return np.maximum(_product_km(self.closest[last, q << level]) - 1e-3, 0)

    def gaps_km(self, p: int, q: int) -> np.ndarray:
        """The gap of every fix of block p with every one of block q."""
        first, last = slice(self.starts[p], self.starts[p] + self.size), slice(self.starts[q], self.starts[q] + self.size)
        own, ends = self.unit[first], self.unit[last]
        before = (self.unit[: self.starts[p]] @ ends.T).max(axis=0, initial=-2.0)
        if p and q + 1 < self.n:
            before[-1] = max(before[-1], self.closest[p - 1, q + 1])
        before = np.maximum.accumulate(before[::-1])[::-1]
        near = own @ self.unit[self.starts[q] :].T
        here = near[:, : len(ends)].copy()
        here[:, -1] = np.maximum(here[:, -1], near[:, len(ends) :].max(axis=1, initial=-2.0))
        here = np.maximum.accumulate(np.maximum.accumulate(here[:, ::-1], axis=1)[:, ::-1], axis=0)
        return _product_km(np.maximum(here, before[None]))


def _improved(lat: np.ndarray, lon: np.ndarray, best: Triangle | None, most_gap: float, side: float, side_km: float) -> Triangle | None:
    """The best triangle of all, from the best so far on. Where more than MOST_TRIPLES triples of blocks could hold a better one, the best
    so far, which isn't known to be optimal then."""
    blocks = _Blocks(lat, lon)
    value = best.perimeter_km - best.gap_km if best else 0.0

    def bounds(level: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ab, bc, ca, gap = blocks.most_km(level, a, b), blocks.most_km(level, b, c), blocks.most_km(level, c, a), blocks.least_gap_km(level, a, c)
        total, least = ab + bc + ca, np.minimum(np.minimum(ab, bc), ca)
        total = np.minimum(total, least / side) if side else total
        upper = np.where((gap <= most_gap * total) & (least >= side_km), total - gap, 0.0)
        return upper, upper > value + 1e-9

    level = len(blocks.levels) - 1
    a = b = c = np.zeros(1, dtype=np.int64)
    upper, _ = bounds(level, a, b, c)
    while level:
        level -= 1
        n = len(blocks.levels[level][0])
        halves = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
        a, b, c = (np.concatenate([2 * x + h[t] for h in halves]) for t, x in enumerate((a, b, c)))
        keep = (a <= b) & (b <= c) & (c < n)
        a, b, c = a[keep], b[keep], c[keep]
        upper, keep = bounds(level, a, b, c)
        a, b, c, upper = a[keep], b[keep], c[keep], upper[keep]
        if len(a) > MOST_TRIPLES:
            return Triangle(best.turns, best.gap, best.perimeter_km, best.gap_km, False) if best else None
    gaps: dict[tuple[int, int], np.ndarray] = {}
    fixes = lambda k: np.arange(blocks.starts[k], min(blocks.starts[k] + blocks.size, len(lat)))
    for at in np.argsort(-upper, kind="stable").tolist():
        if upper[at] <= value + 1e-9:
            break
        p, q, r = int(a[at]), int(b[at]), int(c[at])
        if (p, r) not in gaps:
            gaps[p, r] = blocks.gaps_km(p, r)
        i, j, k = fixes(p), fixes(q), fixes(r)
        ab, bc, ca, gap = _pairs_km(lat, lon, i, j)[:, :, None], _pairs_km(lat, lon, j, k)[None], _pairs_km(lat, lon, i, k)[:, None], gaps[p, r][:, None]
        total, least = ab + bc + ca, np.minimum(np.minimum(ab, bc), ca)
        fits = (i[:, None, None] < j[None, :, None]) & (j[None, :, None] < k[None, None]) & (gap <= most_gap * total) & (least >= side * total) & (least >= side_km)
        worth = np.where(fits, total - gap, 0.0)
        while worth.max() > value + 1e-9:
            x, y, z = np.unravel_index(int(worth.argmax()), worth.shape)
            found = _measured(lat, lon, [int(i[x]), int(j[y]), int(k[z])], most_gap, side, side_km)
            worth[x, y, z] = 0.0
            if found is not None and found.perimeter_km - found.gap_km > value:
                best, value = found, found.perimeter_km - found.gap_km
    return best


def _moved(lat: np.ndarray, lon: np.ndarray, turns: list[int], corners: np.ndarray, rows: np.ndarray, most_gap: float, side: float, side_km: float) -> list[int]:
    """Each turnpoint in turn is moved to the fix between its neighbours among the corners that gives the largest valid triangle."""
    gap_km = float(_gaps(lat, lon, np.array([turns[0], turns[2]]), np.union1d(rows, turns))[0, 1])
    for _ in range(4):
        before = list(turns)
        for t in range(3):
            k = int(np.searchsorted(corners, turns[t]))
            lo = max(int(corners[max(0, k - 1)]), turns[t - 1] + 1 if t else 0)
            hi = min(int(corners[min(len(corners) - 1, k + 1)]), turns[t + 1] - 1 if t < 2 else len(lat) - 1)
            some = np.arange(lo, hi + 1)
            x, y = (turns[(t + 1) % 3], turns[(t + 2) % 3])
            one, two = haversine_km(lat[some], lon[some], lat[x], lon[x]), haversine_km(lat[some], lon[some], lat[y], lon[y])
            rest = float(haversine_km(lat[x], lon[x], lat[y], lon[y]))
            total, least = one + two + rest, np.minimum(np.minimum(one, two), rest)
            fits = (gap_km <= most_gap * total) & (least >= side * total) & (least >= side_km)
            if fits.any():
                turns[t] = int(some[np.where(fits, total, -1).argmax()])
        if turns == before:
            break
    return turns


def triangle_distance_m(lat: np.ndarray, lon: np.ndarray, found: Triangle) -> tuple[list[int], int, int]:
    """(legs, gap, distance) in whole metres."""
    metres = lambda x, y: int(np.floor(haversine_km(lat[x], lon[x], lat[y], lon[y]) * 1000 + 0.5))
    a, b, c = found.turns
    legs, gap = [metres(a, b), metres(b, c), metres(c, a)], metres(*found.gap)
    return legs, gap, max(0, sum(legs) - gap)


def _kind(lat: np.ndarray, lon: np.ndarray, kind: str, fd_m: int) -> dict | None:
    """The better of the open and the closed triangle of a kind, if a coarse search finds the kind worth while."""
    xy, side, side_km = plane_m(lat, lon), 0.0, 0.0
    if kind == "fai_triangle":
        ratio = aspect_ratio(lat, lon)
        if fd_m < FAI_LEAST_FD_M or (ratio is not None and ratio >= FAI_MOST_ASPECT):
            return None
        coarse = simplify(xy, 250.0, chord_m=max(500.0, fd_m * 0.00125))
        probe = best_triangle(lat[coarse], lon[coarse], PROBE_GAP, FAI_SIDE, FAI_SIDE_KM)
        if probe is None or triangle_distance_m(lat[coarse], lon[coarse], probe)[2] < max(FAI_LEAST_M, FAI_TO_FD * fd_m):
            return None
        side, side_km = FAI_SIDE, max(FAI_SIDE_KM, fd_m / 1000 * FAI_TO_FD * FAI_SIDE)
    else:
        coarse = simplify_to(xy, 100, 200, 0.0, 500.0)
        probe = best_triangle(lat[coarse], lon[coarse], PROBE_GAP)
        if (triangle_distance_m(lat[coarse], lon[coarse], probe)[2] if probe else 0) < FREE_PROBE_TO_FD * fd_m:
            return None
    best = None
    for sub_type, most_gap in GAPS.items():
        found = best_triangle(lat, lon, most_gap, side, side_km)
        if found is None:
            break
        legs, gap, distance = triangle_distance_m(lat, lon, found)
        if kind == "free_triangle" and sub_type == "olc_open" and distance < FREE_TO_FD * fd_m:
            return None
        factor = FACTORS[kind, sub_type]
        route = {"type": kind, "sub_type": sub_type, "turns": list(found.turns), "legs_m": legs, "distance_m": distance, "gap_m": gap, "gap_ends": list(found.gap), "factor": factor, "score": distance / 1000 * factor, "optimal": found.optimal}
        best = route if best is None or route["score"] > best["score"] else best
    return best


def free_distance_m(lat: np.ndarray, lon: np.ndarray, way: np.ndarray) -> tuple[list[int], int]:
    """(legs, distance) of a way in whole metres; the distance is rounded to ten."""
    legs = [int(np.floor(haversine_km(lat[x], lon[x], lat[y], lon[y]) * 1000 + 0.5)) for x, y in zip(way, way[1:])]
    return legs, int(np.floor(sum(legs) / 10 + 0.5)) * 10


def evaluate(lat: np.ndarray, lon: np.ndarray) -> list[dict]:
    """The routes of one flight. Without a free distance there is no other; a task is never scored."""
    way = free_distance(lat, lon)
    if way is None:
        return []
    legs, distance = free_distance_m(lat, lon, way)
    routes = [{"type": "free_distance", "sub_type": "none", "turns": way.tolist(), "legs_m": legs, "distance_m": distance, "gap_m": None, "gap_ends": None, "factor": 1.0, "score": distance / 1000, "optimal": len(lat) <= FD_LAST}]
    return routes + [r for kind in ("free_triangle", "fai_triangle") if (r := _kind(lat, lon, kind, distance))]
