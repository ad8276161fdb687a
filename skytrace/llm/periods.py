"""Periodic runs of words, over a harmonic grid.

A run of smallest period q holds max(12 - q, q) or more neighbouring words that recur q words later, so a multiple of q is among their
places. For every period p the grid has the places 0, p, 2p ...: some n ln n pairs (p, place) in all. How far words agree with those p later,
forward and backward from each grid place, is found for all pairs at once by binary search over prefix hashes. Runs are verified
word by word; where a hash has misled, the text is searched again under another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import few_at_once

#: A run has so many words at least, and twice its period.
LEAST_WORDS = 12
#: Pairs of period and grid place that are searched at once; words of texts that are.
PAIRS, WORDS_AT_ONCE = 1 << 20, 1 << 17
_PRIME = (1 << 31) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo the prime, by doubling."""
    out = np.ones(1, dtype=np.int64)
    step = base
    while len(out) < n:
        out = np.append(out, out * step % _PRIME)
        step = step * step % _PRIME
    return out[:n]


class PrefixHashes:
    """Hashes of all prefixes of a sequence of word numbers; any two stretches are compared in constant time."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng([12, seed])
        value = rng.integers(1, _PRIME, int(words.max(initial=0)) + 1)[words]
        self.power = _powers(int(rng.integers(1 << 20, _PRIME)), len(words) + 1)
        self.sums = np.append(0, np.cumsum(value * self.power[:-1] % _PRIME) % _PRIME)

    def same(self, at: np.ndarray, later: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of `size` words from `at` and from `at + later` seem equal; unlike hashes prove unlike words."""
        there = at + later
        one, two = self.sums[at + size] - self.sums[at], self.sums[there + size] - self.sums[there]
        return one % _PRIME * self.power[later] % _PRIME == two % _PRIME

    def agree(self, at: np.ndarray, later: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from `at` on (or up to `at`, exclusive, if back) seem equal to those `later` words on, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        todo = np.flatnonzero(high > 0)
        while len(todo):
            size = (low[todo] + high[todo] + 1) // 2
            start = at[todo] - size if back else at[todo]
            fits = self.same(start, later[todo], size)
            low[todo[fits]] = size[fits]
            high[todo[~fits]] = size[~fits] - 1
            todo = todo[low[todo] < high[todo]]
        return low


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all texts' grids, PAIRS or so at a time. Grid places lie p or more before the text's end."""
    periods = sizes // 2
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[text] - 1) // period
    upto = np.cumsum(points)
    lo = 0
    while lo < len(text):
        base = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        n = points[lo:hi]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, t = np.repeat(period[lo:hi], n), np.repeat(text[lo:hi], n)
        yield t, p, starts[t] + k * p
        lo = hi


def _found(words: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows (text, start, end, period) of the runs as the hashes tell them; places count from the first text's first word."""
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    hashes, out = PrefixHashes(words, seed), [np.zeros((0, 4), dtype=np.int64)]
    for text, period, place in _pairs(sizes, starts):
        # A run's stretch at a grid place holds six words or more: itself agrees, and so does a neighbour.
        near = np.flatnonzero(words[place] == words[place + period])
        text, period, place = text[near], period[near], place[near]
        after = place + period + 1 < ends[text]
        near = after & (words[np.where(after, place + 1, place)] == words[np.where(after, place + 1, place) + period])
        before = place > starts[text]
        near |= before & (words[np.where(before, place - 1, place)] == words[np.where(before, place - 1, place) + period])
        text, period, place = text[near], period[near], place[near]
        forward = hashes.agree(place, period, ends[text] - place - period, back=False)
        backward = hashes.agree(place, period, place - starts[text], back=True)
        start, end = place - backward, place + period + forward
        long = end - start >= np.maximum(LEAST_WORDS, 2 * period)
        out.append(np.unique(np.stack([text, start, end, period], axis=1)[long], axis=0))
    found = np.concatenate(out)
    # The same stretch under several periods: all are multiples of the smallest.
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[: len(found)]]


def _wrong(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Texts with a run that the words themselves deny."""
    wrong = [text for text, start, end, period in found.tolist() if not np.array_equal(words[start : end - period], words[start + period : end])]
    return np.unique(np.array(wrong, dtype=np.int64))


def periodic_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period), in order of text, start and period, of the runs of texts that lie one behind the other in
    `words` (numbers that tell words apart); start and end count from the text's own first word."""
    found, seed = _found(words, sizes, 0), 0
    starts = np.cumsum(sizes) - sizes
    # A wrong length shows as a run that its words deny, be it one that hides another of the same stretch: a stretch with period p that
    # holds a run of period q, twice as long as either, has that of their divisor throughout.
    while len(wrong := _wrong(words, found)):
        seed += 1
        again = [found[~np.isin(found[:, 0], wrong)]]
        for t in wrong.tolist():
            own = _found(words[starts[t] : starts[t] + sizes[t]], sizes[t : t + 1], seed)
            own[:, 0] = t
            own[:, 1:3] += starts[t]
            again.append(own)
        found = np.concatenate(again)
    found[:, 1] -= starts[found[:, 0]]
    found[:, 2] -= starts[found[:, 0]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _described(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of some texts, the number of each one's runs, and the texts without what their runs repeat."""
    number: dict[bytes, int] = {}
    split = [(t or b"").split() for t in texts]  # bytes.split() knows ASCII white space only, as the contract asks
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    words = np.fromiter((number.setdefault(w, len(number)) for own in split for w in own), dtype=np.int64, count=int(sizes.sum()))
    runs = periodic_runs(words, sizes)
    starts = np.cumsum(sizes) - sizes
    # Words behind the first period of a run that holds them: +1 where that begins, -1 where the run ends.
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, starts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(gone, starts[runs[:, 0]] + runs[:, 2], -1)
    kept = np.cumsum(gone)[:-1] == 0
    counts = np.bincount(runs[:, 0], minlength=len(texts))
    left = []
    for t, own in enumerate(split):
        if counts[t]:
            stay = kept[starts[t] : starts[t] + sizes[t]].tolist()
            own = [w for w, k in zip(own, stay) if k]
        left.append(b" ".join(own))
    return runs, counts, left


def _batches(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(batch.column("bytes").to_numpy(zero_copy_only=False), dtype=np.int64)
        load = np.cumsum(sizes) // (6 * WORDS_AT_ONCE)
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            part = batch.slice(lo, hi - lo)
            runs, counts, left = _described(part.column("text").to_pylist())
            rows = pa.StructArray.from_arrays([pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), rows)
            collapsed = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), listed, collapsed], [*kept, "runs", "collapsed"])


def with_runs(docs: DataFrame) -> DataFrame:
    """docs without text, with two last columns: runs, an array of (start, length, period) in words by start and period, and collapsed, the words of the
    text, joined by one blank, without those that a run repeats.

    A run is a stretch of words with a smallest period that it holds twice or more, LEAST_WORDS words at least, and that no neighbour
    extends. A word is dropped where any run has it behind the run's first period. Null, empty and blank texts have no runs and no
    words left. Every row is searched on its own, so repeated rows, ids and nulls in other columns change nothing; texts may have any
    length; an empty table gives no rows. Other columns stay, but for runs, collapsed and bytes, which are this operator's.
    """
    kept = [c for c in docs.columns if c not in ("text", "runs", "collapsed", "bytes")]
    source = few_at_once(docs).select(*kept, F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return source.mapInArrow(partial(_batches, kept=kept), f"{named}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
