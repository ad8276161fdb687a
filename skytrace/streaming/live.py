"""Live tracking: sessions of fixes that end at a gap, midnight rollover, and fixes put in order, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytrace.operators.cleaning import SLIP_FIXES


def sessions(fixes: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(flight_id, start, end, n): runs of fixes with no gap longer than `gap`. Fixes later than `late` are dropped; a session is
    emitted once no fix can join it. State is one window per open session."""
    kept = fixes.withWatermark("at", late) if fixes.isStreaming else fixes
    grouped = kept.groupBy("flight_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("flight_id", F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("end"), "n")


# From when a day may end and until when it may begin, in seconds.
EVENING_S, MORNING_S = 18 * 3600, 6 * 3600


def _roll(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the last seconds of the day and the days passed."""
    last, days = state.get if state.exists else (None, 0)
    for batch in batches:
        out = []
        for n, s in batch.sort_values("n")[["n", "s"]].itertuples(index=False):
            days += int(last is not None and last >= EVENING_S and s <= MORNING_S)
            last = int(s)
            out.append((key[0], int(n), days * 86_400 + last))
        yield pd.DataFrame(out, columns=["flight_id", "n", "t"])
    if last is not None:
        state.update((last, days))


def rolled_over(times: DataFrame) -> DataFrame:
    """(flight_id, n, t): seconds since the first midnight, of records (flight_id, n, s) whose s is the seconds of a day. Records of a
    flight come in order of n; each flight keeps two numbers of state."""
    return times.groupBy("flight_id").applyInPandasWithState(_roll, "flight_id long, n long, t long", "last long, days long", "append", GroupStateTimeout.NoTimeout)


_TOLD = ["flight_id", "n", "t", "segment"]


class _Timeline:
    """What a flight's log has come to: `prev` is the time of the record before, `top` that of the last fix kept, `run` the records since
    then that lie at or before it."""

    def __init__(self, prev: int | None, top: int | None, segment: int, run: list[tuple[int, int]]):
        self.prev, self.top, self.segment, self.run = prev, top, segment, run

    def take(self, n: int, t: int) -> list[tuple[int, int, int]]:
        """(n, t, segment) of the fixes that the next record settles."""
        if t == self.prev:
            return []
        self.prev = t
        out, todo = [], [(n, t)]
        while todo:
            n, t = todo.pop(0)
            if self.top is None or t > self.top:
                self.top, self.run = t, []
                out.append((n, t, self.segment))
                continue
            self.run.append((n, t))
            if len(self.run) > SLIP_FIXES:
                self.segment, self.top, todo, self.run = self.segment + 1, None, self.run + todo, []
        return out


#: Flights whose ids differ in so many low bits only share a call and a row of state, as a call costs Spark some ten milliseconds.
SHARED_BITS = 6
_STATE = "flights array<long>, after array<long>, prev array<long>, top array<long>, segment array<long>, run array<long>, run_n array<long>, run_t array<long>, held array<long>, held_n array<long>, held_t array<long>, held_at array<long>"


def _restored(state: GroupState) -> dict[int, tuple[_Timeline, dict[int, tuple[int, int]], int]]:
    """By flight its timeline, the records that wait (time and when sent by n), and the n that comes next."""
    if not state.exists:
        return {}
    flights, after, prev, top, segment, run, run_n, run_t, held, held_n, held_t, held_at = (list(x) for x in state.get)
    out = {f: (_Timeline(p, m, s, []), {}, a) for f, a, p, m, s in zip(flights, after, prev, top, segment)}
    for f, n, t in zip(run, run_n, run_t):
        out[f][0].run.append((n, t))
    for f, n, t, at in zip(held, held_n, held_t, held_at):
        out[f][1][n] = (t, at)
    return out


def _stored(flights: dict[int, tuple[_Timeline, dict[int, tuple[int, int]], int]]) -> tuple[list[int | None], ...]:
    """The row of state that _restored reads."""
    ids = list(flights)
    lines, after = [flights[f][0] for f in ids], [flights[f][2] for f in ids]
    run = [(f, *x) for f, line in zip(ids, lines) for x in line.run]
    held = [(f, n, *x) for f in ids for n, x in flights[f][1].items()]
    column = lambda rows, k: [x[k] for x in rows]
    return (ids, after, [x.prev for x in lines], [x.top for x in lines], [x.segment for x in lines], *(column(run, k) for k in range(3)), *(column(held, k) for k in range(4)))


def _in_order(wait_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flights, now, told = _restored(state), state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for batch in batches:
                sent = (batch["sent"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
                for f, n, t, at in sorted(zip(batch["flight_id"].tolist(), batch["n"].tolist(), batch["t"].tolist(), sent.tolist())):
                    told.add(f)
                    _, held, after = flights.setdefault(f, (_Timeline(None, None, 0, []), {}, 0))
                    if n >= after:
                        held.setdefault(n, (t, at))
        out, ends = [], []
        for f, (line, held, after) in flights.items():
            # A flight without records in this batch is given up as by a timer of its own, which goes off behind its time.
            late = now if f in told else now - 1
            while held:
                n = min(held) if after not in held and min(at for _, at in held.values()) + wait_ms <= late else after
                if n not in held:
                    ends.append(min(at for _, at in held.values()) + wait_ms)
                    break
                out += [(f, *x) for x in line.take(n, held.pop(n)[0])]
                after = n + 1
            flights[f] = (line, held, after)
        state.update(_stored(flights))
        if ends:
            state.setTimeoutTimestamp(max(min(ends), now + 1))
        if out:
            yield pd.DataFrame(out, columns=_TOLD)

    return step


def fixes_in_order(fixes: DataFrame, wait_s: int = 600, late: str = "1 hour") -> DataFrame:
    """(flight_id, n, t, segment): the fixes of a stream (flight_id, n, t, sent) that a flight's log keeps, in whatever order they come in. n
    is the logger's own count from 0, t the fix's time, sent the timestamp at which it went out.

    A record waits until all before it are there, or until the watermark (the latest sent, less `late`) is wait_s past the oldest that
    waits: then what is missing is given up with the next batch, and is dropped if it comes after that. Of records with one n the first batch's stays, within a
    batch the one of the least t. Records that repeat the time of the one before go. Up to SLIP_FIXES records in a row that aren't later than
    the last kept one go; a longer run is another timeline, and starts the next segment with its first record. A log's last records
    that run backward go unless they are more than that. Rows with a null in n, t, sent or flight_id go. State is a flight's run, at most SLIP_FIXES records,
    and what waits; the flights of 2**SHARED_BITS neighbouring ids, never more, share a row of it."""
    whole = fixes.select("flight_id", "n", "t", "sent").dropna().withWatermark("sent", late)
    groups = whole.withColumn("_group", F.shiftright(F.col("flight_id").cast("long"), SHARED_BITS))
    return groups.groupBy("_group").applyInPandasWithState(_in_order(wait_s * 1000), "flight_id long, n long, t long, segment long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
