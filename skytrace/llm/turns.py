"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, as a dynamic programme over tensors.

A repaired conversation is empty or has the role initials s?(ua)+. What has been put out so far is one of four states (nothing, s, u, a),
so each turn is a small (min, +) step between states. Conversations, cut into segments of SEGMENT turns at most, are bucketed by
length, and one array step per turn (time-major) updates the costs of all states of all segments of a bucket. Costs are stored
backward, so the edits are then read off forward, for all segments at once, and ties go to the least letter.

Spark deals turns to ranges of (conversation, turn). A conversation within a range is solved there. One that goes on in other ranges
is solved by its pieces: each gives the costs between its four first and four last states, these are put together per conversation
(a piece per range at most), then each piece gives the state it ends in for every state it may begin in, and at last its edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import partitions, written

#: Costs of deleting a turn, giving it another role, inserting one, and leaving a truncated one.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Kinds of faults, in the order in which the first counts.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Turns of a segment; turns that are solved together.
SEGMENT, AT_ONCE = 512, 1 << 16
_INITIALS = "sua"
#: Where a kept turn of initial s, u, a (or another) leads from each state, -1 where it may not stand; where an inserted or
#: re-roled turn does.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_NEXT = np.array([2, 2, 3, 2])
#: What is still to be paid in each state after the last turn, and the roles then inserted.
_LAST, _AFTER = np.array([0, 2 * INSERT, INSERT, 0]), np.array(["", "ua", "a", ""], dtype=object)
_FAR = 1 << 50


# --- the programme over segments --------------------------------------------------------------------------------------------------


class Bucket:
    """Segments of nearly one length, time-major: arrays of (turn, segment). Turns behind a segment's end do nothing."""

    def __init__(self, fault: np.ndarray, initial: np.ndarray, times: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.n = int(sizes.max())
        at = starts + np.arange(self.n)[:, None]
        self.real = np.arange(self.n)[:, None] < sizes
        at = np.where(self.real, at, 0)
        self.at, self.initial = at, initial[at]
        self.goes = (fault[at] == BLANK) | (fault[at] == DUPLICATE)
        self.own = np.where(fault[at] == CUT, TRUNCATED, 0)
        self.more = (times[at] - 1) * DELETE

    def before(self, costs: np.ndarray, t: int) -> np.ndarray:
        """Costs to go before turn t from those behind it; the last axis is the state, the first the segment."""
        shape = (-1,) + (1,) * (costs.ndim - 2)
        wide = lambda x: x.reshape(shape)
        out = costs + DELETE
        for state in range(4):
            to = _KEPT[state][self.initial[t]]
            kept = np.take_along_axis(costs, wide(np.maximum(to, 0))[..., None], axis=-1)[..., 0]
            stays = np.minimum(np.where(wide(to >= 0), kept, _FAR), costs[..., _NEXT[state]] + REROLE) + wide(self.own[t])
            out[..., state] = np.where(wide(self.goes[t]), out[..., state], np.minimum(out[..., state], stays))
        out += wide(self.more[t])[..., None]
        two, three = np.minimum(out[..., 2], out[..., 3] + INSERT), np.minimum(out[..., 3], out[..., 2] + INSERT)
        out[..., 0], out[..., 1] = np.minimum(out[..., 0], two + INSERT), np.minimum(out[..., 1], two + INSERT)
        out[..., 2], out[..., 3] = two, three
        return np.where(wide(self.real[t])[..., None], out, costs)

    def matrices(self) -> np.ndarray:
        """(segment, last state, first state): the least cost from one to the other."""
        costs = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (self.at.shape[1], 4, 4)).copy()
        for t in range(self.n - 1, -1, -1):
            costs = np.minimum(self.before(costs, t), _FAR)
        return costs

    def backward(self, last: np.ndarray) -> np.ndarray:
        """(turn, segment, state): costs to go before each turn, and at the end those that are given."""
        costs = np.empty((self.n + 1, *last.shape), dtype=np.int64)
        costs[self.n] = last
        for t in range(self.n - 1, -1, -1):
            costs[t] = self.before(costs[t + 1], t)
        return costs

    def forward(self, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edits of least cost, of these those of least letters, from the state that each segment begins in: (roles inserted before
        each turn, letter, role that a re-roled turn gets), and the states at the end."""
        shape, each = self.at.shape, np.arange(self.at.shape[1])
        inserted, letter, role = np.zeros(shape, dtype=np.int64), np.full(shape, "", dtype=object), np.zeros(shape, dtype=np.int64)
        for t in range(self.n):
            real = self.real[t]
            for _ in range(2):  # more than two turns are never inserted in one place
                here, deleted = costs[t, each, state], costs[t + 1, each, state] + DELETE + self.more[t]
                more = real & (deleted != here) & (costs[t, each, _NEXT[state]] + INSERT == here)
                inserted[t] = np.where(more, inserted[t] * 3 + np.where(state == 2, 2, 1), inserted[t])
                state = np.where(more, _NEXT[state], state)
            here, rest = costs[t, each, state], self.own[t] + self.more[t]
            gone = real & (costs[t + 1, each, state] + DELETE + self.more[t] == here)
            to = _KEPT[state, self.initial[t]]
            kept = real & ~gone & (to >= 0) & (costs[t + 1, each, np.maximum(to, 0)] + rest == here)
            other = real & ~gone & ~kept
            letter[t] = np.select([gone, kept, other], ["D", "K", "R"], "")
            role[t] = np.where(other, np.where(state == 2, 2, 1), 0)
            state = np.where(kept, to, np.where(other, _NEXT[state], state))
        return inserted, letter, role, state


class Segments:
    """Pieces of conversations, one behind the other in arrays (fault, initial, times), cut into segments and bucketed by length."""

    def __init__(self, fault: np.ndarray, initial: np.ndarray, times: np.ndarray, sizes: np.ndarray):
        self.rows, self.pieces = (fault, initial, times), len(sizes)
        n = -(-sizes // SEGMENT)
        self.first = np.cumsum(n) - n  # segment of each piece
        self.of = np.repeat(np.arange(len(sizes)), n)
        k = np.arange(len(self.of)) - self.first[self.of]
        self.start = (np.cumsum(sizes) - sizes)[self.of] + k * SEGMENT
        self.size = np.minimum(sizes[self.of] - k * SEGMENT, SEGMENT)
        self.last = self.first + n - 1
        width = np.ceil(np.log2(self.size)).astype(int)
        self.buckets = [(some, Bucket(*self.rows, self.start[some], self.size[some])) for some in (np.flatnonzero(width == w) for w in np.unique(width))]

    def matrices(self) -> np.ndarray:
        """(piece, last state, first state): costs through each piece."""
        own = np.empty((len(self.of), 4, 4), dtype=np.int64)
        for some, bucket in self.buckets:
            own[some] = bucket.matrices()
        out = own[self.first].copy()
        for piece in np.flatnonzero(self.last > self.first).tolist():
            for s in range(self.first[piece] + 1, self.last[piece] + 1):
                out[piece] = joined(out[piece], own[s])
        return out

    def _costs(self, last: np.ndarray) -> dict[int, np.ndarray]:
        """Costs to go in each bucket, from those behind each piece's last segment."""
        ends = np.empty((len(self.of), 4), dtype=np.int64)
        ends[self.last] = last
        if len(self.of) > self.pieces:
            own = np.empty((len(self.of), 4, 4), dtype=np.int64)
            for some, bucket in self.buckets:
                own[some] = bucket.matrices()
            for s in range(len(self.of) - 2, -1, -1):
                if self.of[s] == self.of[s + 1]:
                    ends[s] = (own[s + 1] + ends[s + 1][:, None]).min(axis=0)
        return {b: bucket.backward(ends[some]) for b, (some, bucket) in enumerate(self.buckets)}

    def exits(self, last: np.ndarray) -> np.ndarray:
        """(piece, first state): the state that the piece ends in."""
        costs, own = self._costs(last), np.empty((len(self.of), 4), dtype=np.int64)
        for b, (some, bucket) in enumerate(self.buckets):
            for state in range(4):
                own[some, state] = bucket.forward(costs[b], np.full(len(some), state))[3]
        out = own[self.first].copy()
        for piece in np.flatnonzero(self.last > self.first).tolist():
            for s in range(self.first[piece] + 1, self.last[piece] + 1):
                out[piece] = own[s][out[piece]]
        return out

    def edits(self, last: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each turn (roles inserted before it, letter, new role) as codes, and the state at each piece's end."""
        costs, entries = self._costs(last), np.zeros(len(self.of), dtype=np.int64)
        entries[self.first] = entry
        if len(self.of) > self.pieces:
            own = np.empty((len(self.of), 4), dtype=np.int64)
            for b, (some, bucket) in enumerate(self.buckets):
                for state in range(4):
                    own[some, state] = bucket.forward(costs[b], np.full(len(some), state))[3]
            for s in range(1, len(self.of)):
                if self.of[s] == self.of[s - 1]:
                    entries[s] = own[s - 1][entries[s - 1]]
        n = len(self.rows[0])
        inserted, letter, role, exits = np.zeros(n, dtype=np.int64), np.full(n, "", dtype=object), np.zeros(n, dtype=np.int64), np.empty(len(self.of), dtype=np.int64)
        for b, (some, bucket) in enumerate(self.buckets):
            found = bucket.forward(costs[b], entries[some])
            at = bucket.at[bucket.real]
            inserted[at], letter[at], role[at] = (x[bucket.real] for x in found[:3])
            exits[some] = found[3]
        return inserted, letter, role, exits[self.last]


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Costs through two pieces, one behind the other: (last state of two, first state of one)."""
    return np.minimum((two[:, :, None] + one[None]).min(axis=1), _FAR)


# --- turns and their faults -------------------------------------------------------------------------------------------------------


def _signed(turns: DataFrame) -> DataFrame:
    """A row per different turn with the times it occurs, an id of its own, what it may lack, and its initial."""
    own = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    none = F.col("text").isNull()
    # Two digests of text and whether it is null: what tells turns of one role apart.
    digests = [F.xxhash64(F.lit(seed), none, "text").alias(f"h{seed}") for seed in (0, 1)]
    inked = F.rtrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.coalesce(F.length("role"), F.lit(0)) > 0, initial).otherwise(3)
    told = own.select("*", *digests, (F.length(inked) == 0).alias("blank"), (~F.substring(inked, -1, 1).isin(".", "!", "?")).alias("cut"), initial.cast("int").alias("initial"))
    return written(told.withColumn("id", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with text, the same without text and with fault): a row for each different (conv_id, turn, role, text), with `times`.
    fault is that of its first occurrence; the others repeat it, so they are duplicates, or blank if it is."""
    known = _signed(turns)
    slim = known.drop("text")
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    # A least turn per role and text, on the map side first: a text that a third of all turns repeat is a row per task.
    firsts = slim.groupBy("conv_id", "role", "h0", "h1").agg(F.min(order).alias("first")).select(*[F.col(c).alias("_" + c) for c in ("conv_id", "role", "h0", "h1")], "first")
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in ("conv_id", "role", "h0", "h1")]
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") != order, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    placed = slim.join(firsts, same[0] & same[1] & same[2] & same[3]).select("conv_id", "turn", "role", "h0", "h1", "times", "id", "initial", fault.cast("int").alias("fault"))
    return known, placed


# --- over Spark's ranges ----------------------------------------------------------------------------------------------------------

_EDITS = "kind int, conv_id {kind}, part int, place long, id long, fault int, initial int, times long, inserted string, edit string, new_role string, after string, illegal long, costs array<long>"
#: Roles inserted, by code: digits to base 3, 1 for a user's turn and 2 for an assistant's.
_ROLES = {0: "", 1: "u", 2: "a", 5: "ua", 7: "au"}
#: Kinds of rows: a turn with its edit; a turn of a piece that may go on elsewhere, and what such a piece costs.
_DONE, _OPEN, _PIECE = 0, 1, 2
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _illegal(initial: np.ndarray, times: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Illegal neighbours up to each turn: with the one before, and among its own repetitions."""
    before = np.append(3, initial[:-1])
    legal = ((before == 0) & (initial == 1)) | ((before == 1) & (initial == 2)) | ((before == 2) & (initial == 1))
    out = (~legal).astype(np.int64)
    out[heads] = 0
    return out + times - 1


def _row_batch(kind: int, kind_of_id: pa.DataType, n: int, **given: object) -> pa.RecordBatch:
    types = {"conv_id": kind_of_id, "part": pa.int32(), "place": pa.int64(), "id": pa.int64(), "fault": pa.int32(), "initial": pa.int32(), "times": pa.int64(), "inserted": pa.string(), "edit": pa.string(), "new_role": pa.string(), "after": pa.string(), "illegal": pa.int64(), "costs": pa.list_(pa.int64())}
    columns = [pa.array(np.full(n, kind, dtype=np.int32))]
    for name, t in types.items():
        x = given.get(name)
        columns.append(pa.nulls(n, t) if x is None else x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t))
    return pa.RecordBatch.from_arrays(columns, ["kind", *types])


def _edit_columns(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, ends: np.ndarray) -> dict[str, list]:
    """The edits as columns; `ends` tells which pieces end their conversation."""
    inserted, letter, role, state = found
    after = np.full(len(letter), "", dtype=object)
    after[(np.cumsum(sizes) - 1)[ends]] = _AFTER[state[ends]]
    named = np.array([None, "user", "assistant"], dtype=object)
    return {"inserted": [_ROLES[x] for x in inserted.tolist()], "edit": letter.tolist(), "new_role": named[role].tolist(), "after": after.tolist()}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of one range in order: edits of the conversations that lie within; the first and the last, which may go on in other
    ranges, are handed on with the costs between their states."""
    held: list[pa.RecordBatch] = []
    part, place, begun = 0, 0, True

    def done(rows: pa.RecordBatch, heads: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal place
        fault, initial, times = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fault", "initial", "times"))
        sizes = np.diff(np.append(heads, rows.num_rows))
        illegal, kind = _illegal(initial, times, heads), rows.schema.field("conv_id").type
        places = place + np.arange(rows.num_rows)
        place += rows.num_rows
        wide = np.zeros(len(heads), dtype=bool)
        wide[0], wide[-1] = first or wide[0], last or (wide[-1] if len(heads) > 1 else first)
        row_wide = np.repeat(wide, sizes)
        common = lambda at: {"conv_id": rows.column("conv_id").take(pa.array(at)), "part": np.full(len(at), part), "place": places[at], "id": rows.column("id").take(pa.array(at)), "fault": fault[at], "initial": initial[at], "times": times[at], "illegal": illegal[at]}
        if (~wide).any():
            at = np.flatnonzero(~row_wide)
            own = Segments(fault[at], initial[at], times[at], sizes[~wide])
            n = int((~wide).sum())
            found = own.edits(np.tile(_LAST, (n, 1)), np.zeros(n, dtype=np.int64))
            yield _row_batch(_DONE, kind, len(at), **common(at), **_edit_columns(found, sizes[~wide], np.arange(n)))
        if wide.any():
            at = np.flatnonzero(row_wide)
            yield _row_batch(_OPEN, kind, len(at), **common(at))
            costs = Segments(fault[at], initial[at], times[at], sizes[wide]).matrices().reshape(-1, 16)
            # A piece's first and last initials tell whether it joins its neighbours legally.
            lo, hi = heads[wide], (heads + sizes - 1)[wide]
            listed = [[*c, int(initial[a]), int(initial[b])] for c, a, b in zip(costs.tolist(), lo, hi)]
            yield _row_batch(_PIECE, kind, len(lo), conv_id=rows.column("conv_id").take(pa.array(lo)), part=np.full(len(lo), part), place=places[lo], costs=listed)

    def whole() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = rows.column("conv_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return rows, np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))

    need = AT_ONCE
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        held.append(batch)
        if sum(b.num_rows for b in held) < need:
            continue
        rows, heads = whole()
        if len(heads) > 1:  # the last conversation may go on
            yield from done(rows.slice(0, heads[-1]), heads[:-1], begun, False)
            begun, rows = False, rows.slice(heads[-1])
        held, need = [rows], max(AT_ONCE, 2 * rows.num_rows)
    if held:
        yield from done(*whole(), begun, True)


def _combined(rows: pa.Table) -> pa.Table:
    """Of one conversation's pieces (a row each, with their costs): costs to go behind each, and illegal neighbours where two meet."""
    rows = rows.sort_by("part")
    listed = np.array(rows.column("costs").to_pylist(), dtype=np.int64)
    ends, last = [], _LAST
    for own in listed[::-1]:
        ends.append(last.tolist())
        last = (own[:16].reshape(4, 4) + last[:, None]).min(axis=0)
    meet = [0] + [int((a, b) not in _LEGAL) for a, b in zip(listed[:-1, 17].tolist(), listed[1:, 16].tolist())]
    is_last = [False] * (len(listed) - 1) + [True]
    return pa.table({"conv_id": rows.column("conv_id"), "part": rows.column("part"), "costs": pa.array(ends[::-1], pa.list_(pa.int64())), "meet": pa.array(meet, pa.int64()), "is_last": is_last})


def _piece_rows(rows: pa.Table) -> tuple[pa.RecordBatch, Segments, np.ndarray]:
    rows = rows.combine_chunks().sort_by("place").combine_chunks().to_batches()[0]
    fault, initial, times = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fault", "initial", "times"))
    last = np.array([rows.column("costs")[0].as_py()], dtype=np.int64)
    return rows, Segments(fault, initial, times, np.array([rows.num_rows])), last


def _piece_exits(rows: pa.Table) -> pa.Table:
    rows, own, last = _piece_rows(rows)
    return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "part": rows.column("part").slice(0, 1), "exits": pa.array(own.exits(last).tolist(), pa.list_(pa.int64()))})


def _entered(rows: pa.Table) -> pa.Table:
    """Of one conversation's pieces: the state that each begins in."""
    rows, state, entry = rows.sort_by("part"), 0, []
    for exits in rows.column("exits").to_pylist():
        entry.append(state)
        state = exits[state]
    return pa.table({"conv_id": rows.column("conv_id"), "part": rows.column("part"), "entry": pa.array(entry, pa.int64())})


def _piece_edits(rows: pa.Table) -> pa.Table:
    rows, own, last = _piece_rows(rows)
    found = own.edits(last, np.array([rows.column("entry")[0].as_py()], dtype=np.int64))
    ends = np.zeros(1 if rows.column("is_last")[0].as_py() else 0, dtype=np.int64)
    given = _edit_columns(found, np.array([rows.num_rows]), ends)
    illegal = rows.column("illegal").to_numpy().copy()
    illegal[0] += rows.column("meet")[0].as_py()
    kept = {c: rows.column(c) for c in ("conv_id", "part", "place", "id", "fault", "initial", "times")}
    return pa.Table.from_batches([_row_batch(_DONE, rows.schema.field("conv_id").type, rows.num_rows, **kept, **given, illegal=illegal)])


def edits(placed: DataFrame, parts: int | None = None) -> DataFrame:
    """Turns of faults() with the edits that repair their conversation at least cost: (conv_id, part, place, id, fault, initial, times, inserted,
    edit, new_role, after, illegal). part and place order a conversation's turns; inserted and after hold the initials of the roles
    of turns to insert before and behind; edit is K, R (to new_role) or D and is that of the first of `times` equal turns, as the
    others are deleted."""
    n = parts or partitions(placed.sparkSession)
    kind = placed.schema["conv_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h0", "h1")]
    ranged = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "id", "fault", "initial", "times", F.spark_partition_id().alias("part"))
    solved = written(ranged.mapInArrow(_solve, _EDITS.format(kind=kind)), "edits")
    pieces = solved.where(F.col("kind") == _PIECE).select("conv_id", "part", "costs")
    ends = pieces.groupBy("conv_id").applyInArrow(_combined, f"conv_id {kind}, part int, costs array<long>, meet long, is_last boolean")
    ends = written(ends, "ends").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("costs").alias("_costs"), "meet", "is_last")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    # A range has two such pieces at most, so both sides of these joins are bound by the number of ranges, but for the turns.
    turns = solved.where(F.col("kind") == _OPEN).drop("costs").join(ends, here).drop("_conv", "_part").withColumnRenamed("_costs", "costs")
    exits = turns.groupBy("conv_id", "part").applyInArrow(_piece_exits, f"conv_id {kind}, part int, exits array<long>")
    entries = written(exits.groupBy("conv_id").applyInArrow(_entered, f"conv_id {kind}, part int, entry long"), "entries").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "entry")
    rest = turns.join(entries, here).drop("_conv", "_part").groupBy("conv_id", "part").applyInArrow(_piece_edits, _EDITS.format(kind=kind))
    return solved.where(F.col("kind") == _DONE).unionByName(rest).drop("kind", "costs")


def repaired(known: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, part, place, letters, lines) from faults() and edits(): for each turn the letters of all edits at it and the lines
    (role, text) that it comes to, inserted ones with empty text."""
    lines = lambda c: F.transform(F.array_remove(F.split(c, ""), ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))))
    letters = F.concat(F.repeat(F.lit("I"), F.length("inserted")), "edit", F.repeat(F.lit("D"), (F.col("times") - 1).cast("int")), F.repeat(F.lit("I"), F.length("after")))
    texts = known.select("id", "role", F.col("text"))
    return edited.join(texts, "id").select("conv_id", "part", "place", letters.alias("letters"), F.concat(lines("inserted"), own, lines("after")).alias("lines"))


def summary(known: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost) of every conversation with turns."""
    fault, times = F.col("fault"), F.col("times")
    kept = F.col("edit") != "D"
    cost = INSERT * (F.length("inserted") + F.length("after")) + F.when(kept, F.when(F.col("edit") == "R", REROLE).otherwise(0) + F.when(fault == CUT, TRUNCATED).otherwise(0)).otherwise(DELETE) + DELETE * (times - 1)
    per = edited.groupBy("conv_id").agg(
        F.sum(F.when(fault == BLANK, times).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == DUPLICATE, times).when(fault == BLANK, 0).otherwise(times - 1)).alias("duplicate"),
        F.sum(F.when(fault == CUT, 1).otherwise(0)).alias("truncated"),
        F.sum("illegal").alias("illegal"),
        F.sum(cost).alias("cost"),
    )
    turns = known.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")).withColumnRenamed("conv_id", "_conv")
    return per.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def repair(turns: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired) of conversations (conv_id, turn, role, text).

    Turns of a conversation go by turn, nulls first, then by role and a digest of text; a null conv_id is a conversation. A turn's
    first fault counts: blank (null, empty or white space alone), duplicate (its role and text were there before, null roles being
    equal), truncated (its last other character is none of . ! ?). Blank and duplicate turns are deleted. Initials are those of the
    role as it is written; a null, empty or other role is never kept. A text may have any length, other columns any name; an empty
    table gives no rows. Letters and lines of a conversation are in order of (part, place).
    """
    known, placed = faults(turns)
    edited = written(edits(placed, parts), "edited")
    return summary(known, edited), repaired(known, edited)


def as_documents(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired): each conversation's letters and lines (role:text) as one value; what one value holds is gathered in
    one task, so a conversation must fit there."""
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "\n")
    own = repaired.select("conv_id", F.struct("part", "place", "letters", F.when(F.size("lines") > 0, lines).alias("lines")).alias("turn"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.array_join("turns.letters", "").alias("audit"), F.array_join("turns.lines", "\n").alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` (a null as one blank) modulo 20."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code: Column = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    some = turns.select("conv_id", "turn", "role", "text", code.alias("_code")).where("_code != 0")
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_n")).drop("_n")
