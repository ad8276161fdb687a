"""Runs of climb: short ones are taken into their neighbours. Decisions depend on earlier ones, so a flight is one small kernel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from skytrace.operators.series import each_flight

# How long an odd run between two equal ones may be, and the least duration of a run, in seconds.
ODD_S, LEAST_S = 8, 15


def _last_s(run: list) -> int:
    return run[4] - run[3]


def absorb_odd(runs: list[list], odd_s: int = ODD_S) -> list[list]:
    """From left to right, a run of at most odd_s seconds between two of one bucket joins them; the three are one run from then on
    and may be a neighbour again, but the right one is used up. A run is [bucket, start_idx, end_idx, start_t, end_t]."""
    out, k = [], 0
    while k < len(runs):
        run, after = runs[k], runs[k + 1] if k + 1 < len(runs) else None
        if out and after and out[-1][0] == after[0] and _last_s(run) <= odd_s:
            out[-1] = [out[-1][0], out[-1][1], after[2], out[-1][3], after[4]]
            k += 2
        else:
            out.append(list(run))
            k += 1
    return out


def dissolve_short(runs: list[list], least_s: int = LEAST_S) -> list[list]:
    """The first run shorter than least_s joins its longer neighbour, of equal ones the left; equal neighbours become one; again,
    until no run is short or one is left."""
    runs = [list(r) for r in runs]
    while len(runs) > 1 and (k := next((i for i, r in enumerate(runs) if _last_s(r) < least_s), None)) is not None:
        left, right = _last_s(runs[k - 1]) if k else -1, _last_s(runs[k + 1]) if k + 1 < len(runs) else -1
        into = k - 1 if left >= right else k + 1
        lo, hi = min(k, into), max(k, into)
        runs[lo : hi + 1] = [[runs[into][0], runs[lo][1], runs[hi][2], runs[lo][3], runs[hi][4]]]
        merged: list[list] = []
        for r in runs:
            if merged and merged[-1][0] == r[0]:
                merged[-1] = [r[0], merged[-1][1], r[2], merged[-1][3], r[4]]
            else:
                merged.append(r)
        runs = merged
    return runs


def climb_segments(runs: DataFrame) -> DataFrame:
    """(flight_id, bucket, start_idx, end_idx, start_t, end_t) of the runs of series.runs() over `bucket`, without short ones."""
    kind = runs.schema["flight_id"].dataType.simpleString()
    names = ["bucket", "start_idx", "end_idx", "start_t", "end_t"]

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found = dissolve_short(absorb_odd(f.sort_values("start_idx")[names].values.tolist()))
        return pd.DataFrame(found, columns=names).assign(flight_id=key[0])

    return each_flight(runs.select("flight_id", *names)).applyInPandas(one, f"flight_id {kind}, bucket int, start_idx long, end_idx long, start_t long, end_t long")
