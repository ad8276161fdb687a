"""SimHash fingerprints and near-duplicate groups over a Gray-order hierarchical index.

Two fingerprints within three differing bits agree on all but three of any number of blocks that the 64 bits are cut into. Each
choice of blocks with its value is an upper node of the index (mask: the blocks, pattern: their value): one block of four of 16 bits,
two of five, three of six, as the fingerprints get more, so that nodes stay small. The fingerprints below a node are sorted by Gray
rank and cut into pages. Within a page, runs of neighbours are factored into nodes that hold the bits all members share; two nodes whose shared bits differ in more
than three places are pruned with everything below them. Where a node has more than one page, pages are first compared by
their own nodes in a join, and only the surviving pairs of pages are compared member by member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import dealt_evenly, few_at_once, partitions, written
from skytrace.llm.components import connected_components

DISTANCE, PAGE, FANOUT, STEP = 3, 4096, 8, 1 << 18


# --- fingerprints -----------------------------------------------------------------------------------------------------------------


def fingerprint_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per run of hashes (runs begin at starts, none is empty): a bit is 1 where over half the run has it."""
    ends = np.append(starts[1:], len(hashes))
    votes = np.zeros((len(starts), 64), dtype=np.int64)
    for lo in range(0, len(hashes), STEP):  # a long text is never unpacked whole
        hi = min(lo + STEP, len(hashes))
        first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left")
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - lo, 0), axis=0, dtype=np.int32)
    on = votes * 2 > (ends - starts)[:, None]
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def text_fingerprints(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """Fingerprints of texts in UTF-8. bytes.lower() and bytes.split() know ASCII only, as the contract asks."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    hashes, starts, of, n = [], [], [], 0
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            own = [xxh64_intdigest(joined, 42)]
        else:
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            end = np.cumsum(size + 1) - 1
            own = [xxh64_intdigest(joined[s:e], 42) for s, e in zip((end - size).tolist(), end[width - 1 :].tolist())]
        starts.append(n)
        of.append(i)
        n += len(own)
        hashes.append(np.array(own, dtype=np.uint64))
    if hashes:
        out[of] = fingerprint_bits(np.concatenate(hashes), np.array(starts))
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prints = text_fingerprints(part.column("text").to_pylist()).view(np.int64)
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(prints)], [*names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed long; rows keep their number, and columns but text stay."""
    source = few_at_once(docs).withColumn("text", F.col("text").cast("binary"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(_fingerprint_batches, f"{kept}, fp long")


# --- the index --------------------------------------------------------------------------------------------------------------------


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit code in Gray order: neighbours in this order differ in few bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class Forest:
    """For runs of fingerprints (one per group), levels of nodes. A node holds the AND and the OR of its members: they agree where
    these are equal. child[k] is the first child of each node at level k, with one more entry at the end."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.ands, self.ors, self.child = [prints], [prints], [np.arange(len(prints) + 1)]
        owner = group
        while len(owner) and (owner[1:] == owner[:-1]).any():
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            heads = np.flatnonzero(place % FANOUT == 0)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], heads))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], heads))
            self.child.append(np.append(heads, len(owner)))
            owner = owner[heads]
        self.top = len(self.ands) - 1

    def apart(self, level: int, x: np.ndarray, other: Forest, y: np.ndarray) -> np.ndarray:
        """Differences on the bits that each of two nodes settles for all its members."""
        settled = ~((self.ands[level][x] ^ self.ors[level][x]) | (other.ands[level][y] ^ other.ors[level][y]))
        return np.bitwise_count((self.ands[level][x] ^ other.ands[level][y]) & settled)


def close_pairs(left: Forest, right: Forest, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members within DISTANCE below the pairs (x, y) of top nodes. left is right: each pair once, none with itself."""
    same, todo = left is right, [(left.top, x, y)]
    while todo:
        level, x, y = todo.pop()
        if not len(x):
            continue
        if level == 0:
            keep = (x < y) if same else slice(None)
            yield x[keep], y[keep]
            continue
        a, b = left.child[level], right.child[level]
        nx, ny = a[x + 1] - a[x], b[y + 1] - b[y]
        made = np.cumsum(nx * ny)
        if len(x) > 1 and made[-1] > STEP:
            cut = max(1, min(len(x) - 1, int(np.searchsorted(made, made[-1] // 2))))
            todo += [(level, x[:cut], y[:cut]), (level, x[cut:], y[cut:])]
            continue
        at = np.arange(made[-1]) - np.repeat(made - nx * ny, nx * ny)
        i, j = np.divmod(at, np.repeat(ny, nx * ny))
        i, j = i + np.repeat(a[x], nx * ny), j + np.repeat(b[y], nx * ny)
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
        keep = left.apart(level - 1, i, right, j) <= DISTANCE
        todo.append((level - 1, i[keep], j[keep]))


def hang(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b in place; roots[i] is the smallest member that i hangs on, in the end."""
    while True:
        ra, rb = roots[a], roots[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(roots, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while (roots != (up := roots[roots])).any():
            roots[:] = up


def _raised(forest: Forest, to: int) -> None:
    """Give a forest of one tree a top at level `to`, so that two trees can be compared level by level."""
    while forest.top < to:
        forest.ands.append(forest.ands[-1])
        forest.ors.append(forest.ors[-1])
        forest.child.append(np.arange(len(forest.ands[-1]) + 1))
        forest.top += 1


_PAGED = "kind int, a long, b long, block int, value long, page long"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, block: np.ndarray | int, value: np.ndarray | int, page: np.ndarray | int) -> pa.RecordBatch:
    n = len(a)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, dtype=t), n))
    return pa.RecordBatch.from_arrays([full(kind, np.int32), full(a, np.int64), full(b, np.int64), full(block, np.int32), full(value, np.int64), full(page, np.int64)], ["kind", "a", "b", "block", "value", "page"])


def _link_pages(batches: Iterator[pa.RecordBatch], size: int = PAGE) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, value, Gray rank): cut them into pages and link within each. Kind 0 is a link; kind 1 a member of a page
    whose node may go on elsewhere: it is the first or last of this partition, or has several pages."""
    number = TaskContext.get().partitionId() << 32
    rest: list[np.ndarray] = []  # block, value, fp of the node that has not ended

    def close(columns: list[np.ndarray], open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        block, value, fp = columns
        node = np.cumsum(np.append(False, (block[1:] != block[:-1]) | (value[1:] != value[:-1])))
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
        page = np.cumsum((place % size == 0)) - 1
        forest, roots = Forest(fp.view(np.uint64), page), np.arange(len(fp))
        tops = np.arange(len(forest.ands[-1]))
        for a, b in close_pairs(forest, forest, tops, tops):
            hang(roots, a, b)
        linked = np.flatnonzero(roots != np.arange(len(fp)))
        if len(linked):
            yield _rows(0, fp[linked], fp[roots[linked]], 0, 0, 0)
        pages = np.bincount(node[place % size == 0])
        wide = pages > 1
        wide[0] |= open_first
        wide[-1] |= open_last
        shown = wide[node]
        if shown.any():
            yield _rows(1, fp[shown], fp[shown], block[shown], value[shown], page[shown] + number)
        number += int(page[-1]) + 1

    going_on = True  # the first node at hand may have begun before it
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "value", "fp")]
        if rest:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        if not len(columns[0]):
            continue
        block, value, _ = columns
        start = int(np.flatnonzero((block != block[-1]) | (value != value[-1])).max(initial=-1)) + 1
        tail = len(block) - start
        if tail >= 2 * size:  # a hot node: its full pages are closed, the rest goes on
            cut = start + tail // size * size
            yield from close([c[:cut] for c in columns], going_on, True)
            going_on, rest = True, [c[cut:] for c in columns]
            continue
        if start:
            yield from close([c[:start] for c in columns], going_on, False)
            going_on = False
        rest = [c[start:] for c in columns]
    if rest and len(rest[0]):
        yield from close(rest, going_on, True)


def _link_page_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pair, side): link the members of a pair's two pages."""

    def link(side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = int(np.count_nonzero(side == 0))
        a, b = fp[:cut], fp[cut:]
        if not len(a) or not len(b):
            return
        left, right = (Forest(x.view(np.uint64), np.zeros(len(x), dtype=np.int64)) for x in (a, b))
        top = max(left.top, right.top)
        _raised(left, top)
        _raised(right, top)
        roots = np.arange(len(fp))
        for i, j in close_pairs(left, right, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)):
            hang(roots, i, j + cut)
        linked = np.flatnonzero(roots != np.arange(len(fp)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[roots[linked]])], ["a", "b"])

    rest: list[np.ndarray] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "side", "fp")]
        if rest:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        bounds = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        bounds = [0, *bounds.tolist()]
        for lo, hi in zip(bounds, bounds[1:]):
            yield from link(columns[2][lo:hi], columns[3][lo:hi])
        rest = [c[bounds[-1] :] for c in columns]
    if rest and len(rest[0]):
        yield from link(rest[2], rest[3])


def blocks_for(n: int, page: int = PAGE) -> int:
    """Blocks to cut 64 bits into for n fingerprints: the fewest whose nodes hold half a page on average; six at most."""
    return next((b for b in range(DISTANCE + 1, 6) if n >> 64 * (b - DISTANCE) // b <= page // 2), 6)


def masks(blocks: int) -> list[int]:
    """The bits of every choice of all but DISTANCE blocks, as signed longs."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [int(np.uint64(sum(chosen)).astype(np.int64)) for chosen in combinations(own, blocks - DISTANCE)]


def fingerprint_links(prints: DataFrame, fp: str = "fp", page: int = PAGE, blocks: int | None = None) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints within DISTANCE bits of each other, directly or through others.

    Not all pairs: each page yields one link per member at most. Every fingerprint is sent once per choice of blocks, as 20 bytes.
    The number of blocks follows the number of fingerprints where it isn't given; links are exact with any.
    """
    spark = prints.sparkSession
    blocks = [F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(m).alias("value")) for k, m in enumerate(masks(blocks or blocks_for(prints.count(), page)))]
    entries = prints.select(F.col(fp).alias("fp")).where(F.col(fp).isNotNull()).distinct().select("fp", F.explode(F.array(*blocks)).alias("e")).select("e.*", "fp")
    order = ["block", "value", gray_rank(F.col("fp")), F.col("fp")]
    ranged = entries.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    paged = written(ranged.mapInArrow(partial(_link_pages, size=page), _PAGED), "pages")
    within = paged.where("kind = 0").select("a", "b")
    members = paged.where("kind = 1").select("block", "value", "page", F.col("a").alias("fp"))
    nodes = members.groupBy("block", "value", "page").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high"))
    one, two = nodes.select("block", "value", F.col("page").alias("one"), F.col("low").alias("l1"), F.col("high").alias("h1")), nodes.select("block", "value", F.col("page").alias("two"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    settled = F.bitwise_not(F.expr("(l1 ^ h1) | (l2 ^ h2)"))
    near = F.bit_count(F.expr("l1 ^ l2").bitwiseAND(settled)) <= DISTANCE
    pairs = one.join(two, ["block", "value"]).where(F.col("one") < F.col("two")).where(near).select("one", "two")
    n = partitions(spark)
    pairs = dealt_evenly(pairs, n)
    sides = [pairs.join(members.select(F.col("page").alias(side), "fp"), side).select("one", "two", "task", F.lit(k).alias("side"), "fp") for k, side in enumerate(("one", "two"))]
    facing = sides[0].unionByName(sides[1]).repartitionById(n, "task").drop("task").sortWithinPartitions("one", "two", "side")
    return within.unionByName(facing.mapInArrow(_link_page_pairs, "a long, b long"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id that links of DISTANCE bits or fewer reach.

    Words are runs outside ASCII white space, A-Z lower-cased; shingles of three words, repeats included. A text of fewer words is
    one shingle; a null, empty or blank text has fingerprint 0 and links like any other. Copies share a fingerprint and are never
    paired with each other. Repeated rows stay; a null doc_id stays too, but names no group unless all its members are null. Other
    columns are ignored.
    """
    prints = written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    groups = connected_components(fingerprint_links(prints))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = own.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: Prefix of the columns that are added to documents for a while; documents bring none like these.
_OWN = "__simhash_"


def _row_key() -> dict[str, Column]:
    """The id and 128 bits of the text's hash: tells apart texts that share an id or have none."""
    return {_OWN + "id": F.col("doc_id"), _OWN + "h1": F.xxhash64("text"), _OWN + "h2": F.xxhash64(F.lit(1), "text")}


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of least doc_id (null ids last), then of least text hash. Of rows that share both, one
    stays: the one of least hash over all columns. Columns as they come; a null or empty text is a text like any other; texts may have
    any length; an empty table gives no rows."""
    own = _row_key()
    rank = F.struct(F.col(_OWN + "id").isNull().alias("none"), *own)
    prints = written(fingerprints(docs.select(*(c.alias(k) for k, c in own.items()), "text")), "fingerprints")
    groups = connected_components(fingerprint_links(prints)).withColumnRenamed("node", "fp")
    counted = prints.groupBy(*own, "fp").agg(F.count("*").alias("n"))
    members = counted.join(groups, "fp", "left").select(*own, "n", F.coalesce("component", "fp").alias("component"))
    # A min per group, summed on the map side: a large group is one row per task.
    least = members.groupBy("component").agg(F.min(rank).alias("least"))
    leaves = (rank != F.col("least")).alias(_OWN + "leaves")
    fate = members.join(least, "component").select(*[F.col(k).alias("_" + k) for k in own], leaves, "n").where(F.col(_OWN + "leaves") | (F.col("n") > 1)).drop("n")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_OWN + "row")
    # One shuffle of the rows serves both branches.
    told = docs.select(row, *[c.alias(k) for k, c in own.items()])
    told = told.join(fate, told[_OWN + "id"].eqNullSafe(fate["_" + _OWN + "id"]) & (told[_OWN + "h1"] == fate["_" + _OWN + "h1"]) & (told[_OWN + "h2"] == fate["_" + _OWN + "h2"]), "left")
    once = told.where(F.col(_OWN + "leaves").isNull()).select(_OWN + "row")
    digest = F.xxhash64(*[F.col(f"{_OWN}row.`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"{_OWN}row.`{f.name}`") for f in docs.schema.fields])
    one = told.where(~F.col(_OWN + "leaves")).groupBy(*own).agg(F.min_by(_OWN + "row", digest).alias(_OWN + "row")).select(_OWN + "row")
    return once.unionByName(one).select(_OWN + "row.*")


def fingerprint_text(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
