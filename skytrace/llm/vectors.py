"""Vectors: which take part, near-duplicate groups by sign hashing, and nearest neighbours by collision counting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.llm.common import dealt_evenly, partitions, written
from skytrace.llm.components import connected_components
from skytrace.llm.simhash import hang

# --- near-duplicates --------------------------------------------------------------------------------------------------------------

#: Pairs of this cosine are to be found in one of the tables with this probability at least; vectors that share a bucket on average.
COSINE, FOUND, PER_BUCKET, PAGE = 0.95, 0.99, 16, 512


def takes_part(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def tables_for(n: int) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets keep their size as n grows, and the tables make up for the longer keys."""
    bits = min(31, max(4, round(math.log2(max(n, 1) / PER_BUCKET)) if n > PER_BUCKET else 4))
    one = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - one))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one length, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, so that no square or sum over- or underflows."""
    most = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    # Twice, as the least doubles need a factor that is no double itself.
    half = -np.frexp(most)[1] // 2
    return np.ldexp(np.ldexp(vectors, half), -np.frexp(most)[1] - half)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from a query; where squares would over- or underflow, of scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        far = np.sqrt(((vectors - query) ** 2).sum(axis=1))
        odd = np.flatnonzero(~((far > 1e-140) & (far < 1e150)))
        if len(odd):
            some = vectors[odd]
            most = np.maximum(np.abs(some).max(axis=1, initial=0), np.abs(query).max(initial=0))
            power = np.frexp(most)[1]
            # Differences of the numbers themselves where these are small, of a quarter of them where they are large.
            quarter = np.where(power > 0, 2, 0)
            apart = np.ldexp(some, -quarter[:, None]) - np.ldexp(query[None], -quarter[:, None])
            size = np.frexp(np.abs(apart).max(axis=1, initial=0))[1]
            half = -size // 2
            apart = np.ldexp(np.ldexp(apart, half[:, None]), (-size - half)[:, None])
            far[odd] = np.ldexp(np.ldexp(np.sqrt((apart**2).sum(axis=1)), size), quarter)
    return far


def _signs(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        size = np.diff(batch.column("vector").offsets.to_numpy())
        for dim in np.unique(size).tolist():
            rows = pa.array(np.flatnonzero(size == dim))
            part = batch.take(rows)
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
            for lo in range(0, part.num_rows, 1024):
                some = part.slice(lo, 1024)
                on = _scaled(_matrix(some.column("vector"))) @ planes[dim] > 0
                keys = (on.reshape(-1, tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)
                sent = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in some.schema.names), sent], [*some.schema.names, "signs"])


class Block:
    """Vectors of one bucket or page."""

    def __init__(self, cls: np.ndarray, copies: np.ndarray, vectors: np.ndarray, signs: np.ndarray):
        self.cls, self.copies, self.signs = cls, copies, signs
        scaled = _scaled(vectors)
        self.unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        signs = batch.column("signs").flatten().to_numpy().reshape(batch.num_rows, -1)
        return cls(batch.column("cls").to_numpy(), batch.column("copies").to_numpy(), _matrix(batch.column("vector")), signs)


def _linked(one: Block, two: Block, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of COSINE or more that no earlier table has together, so each pair counts once over all tables."""
    i, j = np.nonzero(one.unit @ two.unit.T >= COSINE)
    if one is two:
        i, j = i[i < j], j[i < j]
    new = ~(one.signs[i, :table] == two.signs[j, :table]).any(axis=1)
    return i[new], j[new]


_FOUND = "kind int, cls long, other long, bits int, bucket int, dim int, page long"


def _found(kind: int, cls: np.ndarray, other: np.ndarray, key: tuple[int, int, int] = (0, 0, 0), page: int = 0) -> pa.RecordBatch:
    n = len(cls)
    fill = lambda x, t: pa.array(np.full(n, x), t)
    return pa.RecordBatch.from_arrays([fill(kind, pa.int32()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), *(fill(k, pa.int32()) for k in key), fill(page, pa.int64())], ["kind", "cls", "other", "bits", "bucket", "dim", "page"])


def _report(one: Block, two: Block, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 0: vectors linked to a class, counting copies; kind 2: links that join the same classes, one per class at most."""
    if not len(i):
        return
    for block, own, rest, far in ((one, i, two, j), (two, j, one, i)):
        n = np.bincount(own, rest.copies[far], len(block.cls)).astype(np.int64)
        yield _found(0, block.cls[n > 0], n[n > 0])
    cls = one.cls if one is two else np.concatenate([one.cls, two.cls])
    roots = np.arange(len(cls))
    hang(roots, i, j if one is two else j + len(one.cls))
    hung = np.flatnonzero(roots != np.arange(len(cls)))
    yield _found(2, cls[hung], cls[roots[hung]])


def _link_buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, bucket, dim): link within pages; kind 1 names the members of a bucket that may have other pages."""
    page, key, held, begun = TaskContext.get().partitionId() << 32, None, [], True

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal page
        block = Block.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        if len(block.cls) > 1:
            yield from _report(block, block, *_linked(block, block, key[0]))
        if last or begun:
            yield _found(1, block.cls, block.copies, key, page)
        page += 1

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bits", "bucket", "dim")], axis=1)
        heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(keys) else []
        for lo, hi in zip(heads, [*heads[1:], len(keys)]):
            own = tuple(keys[lo].tolist())
            if key is not None and own != key:
                if held:
                    yield from close(False)
                held, begun = [], False
            key = own
            while lo < hi:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(lo, min(room, hi - lo)))
                lo += held[-1].num_rows
                if sum(b.num_rows for b in held) == size:
                    yield from close(True)
                    held, begun = [], True
    if held:
        yield from close(True)


def _link_facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (one, two, side): link the vectors of two pages of a bucket."""

    def link(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        cut = int(np.count_nonzero(both.column("side").to_numpy() == 0))
        if 0 < cut < both.num_rows:
            one, two = Block.of(both.slice(0, cut)), Block.of(both.slice(cut))
            yield from _report(one, two, *_linked(one, two, int(both.column("bits")[0].as_py())))

    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("one", "two")], axis=1)
        heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(keys) else []
        for lo, hi in zip(heads, [*heads[1:], len(keys)]):
            own = tuple(keys[lo].tolist())
            if key is not None and own != key:
                yield from link(held)
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from link(held)


def near_duplicate_vectors(vectors: DataFrame, page: int = PAGE, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: other vectors linked directly, the smallest vec_id that links reach.

    Equal vectors are one class and are never paired with each other. Classes share a bucket of a table where the signs of their
    products with random hyperplanes agree; within a bucket all cosines are computed in double precision. A bucket of more than
    `page` classes is compared page by page in separate tasks. Vectors of different lengths don't link. Vectors that are null or
    zero, or hold null or non-finite components, are their own group, as are all in an empty table. Repeated rows stay and count as
    vectors; a null vec_id names no group unless all its members are null.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    part = takes_part(F.col("vector"))
    classes = rows.where(part).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    bits, tables = tables_for(classes.count())
    kind = rows.schema["vector"].dataType.simpleString()
    signed = written(classes.select("cls", "copies", "vector").mapInArrow(partial(_signs, bits=bits, tables=tables, seed=seed), f"cls long, copies long, vector {kind}, signs array<int>"), "signs")
    entries = signed.select(F.posexplode("signs").alias("bits", "bucket"), F.size("vector").alias("dim"), "cls", "copies", "vector", "signs")
    order = ["bits", "bucket", "dim", "cls"]
    found = written(entries.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(partial(_link_buckets, size=page), _FOUND), "found")
    members = found.where("kind = 1").select("bits", "bucket", "dim", "page", "cls")
    pages = members.select("bits", "bucket", "dim", "page").distinct()
    pairs = pages.withColumnRenamed("page", "one").join(pages.withColumnRenamed("page", "two"), ["bits", "bucket", "dim"]).where("one < two").select("bits", "one", "two")
    pairs = dealt_evenly(pairs, n)
    sides = [pairs.join(members.select(F.col("page").alias(side), "cls"), side).select("bits", "one", "two", "task", F.lit(k).alias("side"), "cls") for k, side in enumerate(("one", "two"))]
    facing = sides[0].unionByName(sides[1]).join(signed, "cls").repartitionById(n, "task").drop("task").sortWithinPartitions("one", "two", "side")
    found = found.where("kind != 1").unionByName(written(facing.mapInArrow(_link_facing, _FOUND), "facing"))
    linked = found.where("kind = 0").groupBy("cls").agg(F.sum("other").alias("linked"))
    groups = connected_components(found.where("kind = 2"), "cls", "other").withColumnRenamed("node", "cls")
    placed = classes.join(linked, "cls", "left").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    told = named.select("vector", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    in_ = rows.where(part).join(told, "vector").select("vec_id", "n_links", "component_id")
    out = rows.where(~F.coalesce(part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return in_.unionByName(out).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# --- nearest neighbours -----------------------------------------------------------------------------------------------------------

#: Projections; the window's half width at radius 1 (a vector at that distance collides half the time); standard errors that the
#: threshold lies below the expected collisions of a vector at the radius; first radius, in typical distances, and its growth.
PROJECTIONS, HALF_WIDTH, SLACK, FIRST_RADIUS, GROWTH = 128, 0.6745, 1.3, 0.6, 1.05
BLOCK_ROWS, QUERY_ROWS, NEAREST = 8192, 64, 10


class SortedProjections:
    """An index over a block of vectors: for each random direction, the block in the order of its products with it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], PROJECTIONS))
        products = self._products(vectors)
        self.order = np.argsort(products, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(products.T, self.order.astype(np.int64), axis=1)
        self.flat = np.ascontiguousarray(self.order).ravel()
        with np.errstate(over="ignore", invalid="ignore"):
            spread = float(np.sqrt(2 * products.var(axis=0).mean()))
        # Where a spread is beyond all doubles, so is the first radius: every vector collides at once and is verified.
        self.first = spread * FIRST_RADIUS if np.isfinite(spread) else np.inf
        self.threshold = math.ceil(PROJECTIONS / 2 - SLACK * math.sqrt(PROJECTIONS) / 2)

    def _products(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(vectors @ self.directions)

    def _collide(self, counts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Count the vectors at places [begin, end) of each sorted array."""
        size = end - begin
        total = int(size.sum())
        if total:
            at = np.arange(total) + np.repeat(begin + np.arange(PROJECTIONS) * len(self.ids) - (np.cumsum(size) - size), size)
            counts += np.bincount(self.flat[at], minlength=len(self.ids))

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, (rows, distances) of the k nearest found, nearest first, ties to the smaller id; never those of its own id.

        Windows around the query grow with the radius (virtual rehashing: no array is sorted again); a vector that collides in
        `threshold` arrays is verified by its distance. A query ends where its k-th distance is within the radius, or when every
        vector has been verified.
        """
        n, target = len(self.ids), self._products(queries)
        for q in range(len(queries)):
            counts, done, far = np.zeros(n, dtype=np.int64), self.ids == own[q], np.full(n, np.inf)
            left = int(n - done.sum())
            want = min(k, left)
            lo = hi = np.array([np.searchsorted(self.sorted[j], target[q, j]) for j in range(PROJECTIONS)])
            radius = self.first if self.first > 0 else 1.0
            while want:
                half = HALF_WIDTH * radius
                new_lo = np.array([np.searchsorted(self.sorted[j], target[q, j] - half, side="left") for j in range(PROJECTIONS)])
                new_hi = np.array([np.searchsorted(self.sorted[j], target[q, j] + half, side="right") for j in range(PROJECTIONS)])
                self._collide(counts, new_lo, lo)
                self._collide(counts, hi, new_hi)
                lo, hi = new_lo, new_hi
                fresh = np.flatnonzero((counts >= self.threshold) & ~done)
                far[fresh] = distances(self.vectors[fresh], queries[q])
                done[fresh] = True
                left -= len(fresh)
                if not left or np.partition(far, want - 1)[want - 1] <= radius:
                    break
                radius *= GROWTH if np.isfinite(far).any() or (counts > 0).any() else 2
            if want:
                edge = np.partition(far, want - 1)[want - 1]
                rows = np.flatnonzero(far <= edge)
                rows = rows[np.lexsort((self.ids[rows], far[rows]))][:want]
                yield rows, far[rows]
            else:
                yield np.zeros(0, dtype=np.int64), np.zeros(0)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, dim, asks): the vectors of a block, then all queries, which stream through its index."""
    key, held, index = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "dim", "asks")], axis=1)
        heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(keys) else []
        for lo, hi in zip(heads, [*heads[1:], len(keys)]):
            own, asks, part = tuple(keys[lo, :2].tolist()), keys[lo, 2], batch.slice(lo, hi - lo)
            if own != key:
                key, held, index = own, [], None
            if not asks:
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("vector"))))
                continue
            if not held:
                continue  # no vector of this length in the block
            index = index or SortedProjections(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
            for at in range(0, len(ids), QUERY_ROWS):
                few = ids[at : at + QUERY_ROWS]
                found = list(index.nearest(vectors[at : at + QUERY_ROWS], few, k))
                sizes = [len(r) for r, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(few, sizes)), pa.array(index.ids[np.concatenate([r for r, _ in found])]), pa.array(np.concatenate([d for _, d in found]))], ["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that asks, the k nearest other rows found, by Euclidean distance.

    Vectors are dealt to blocks of about BLOCK_ROWS by a hash of their id, and each block is indexed whole in one task; every query
    is sent to every block and the blocks' k best are ranked per query. Vectors that are null or zero, or hold null or non-finite
    components, or no id take no part, nor do vectors of another length than the query's. Rows that share a query's id are its own;
    of repeated queries one is asked.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dim"), asks.alias("ask"))
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    held = rows.select(block.alias("block"), "dim", F.lit(0).alias("asks"), "vec_id", "vector")
    asked = rows.where("ask").dropDuplicates(["vec_id"]).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "dim", F.lit(1).alias("asks"), "vec_id", "vector")
    dealt = held.unionByName(asked).repartition(max(n, partitions(spark)), "block").sortWithinPartitions("block", "dim", "asks")
    found = dealt.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
