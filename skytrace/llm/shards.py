"""Token ids as binary shards with constant-time access by document key.

A shard is one row of a Parquet table, so shards lie wherever Spark can write: in one column the payload (the ids of its documents in
ascending doc_id order, each an unsigned 16- or 32-bit little-endian integer), in others the keys in that order and an index. The index is a minimal
perfect hash: each level is a bit array; a key whose bit no other key of the level shares is placed there, the rest go on to the
next, larger salt. A key's slot is the number of set bits before its own. By slot, the shard has the key's 32-bit fingerprint,
which tells absent keys, and the place of its ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.llm.common import few_at_once, partitions

#: A shard is closed once it holds so many ids or documents: what a look-up reads of the payload.
SHARD_IDS, SHARD_DOCS = 1 << 19, 1 << 14
END_ID = 0
#: Row groups of the files, so that a task reads few shards at once.
BLOCK_BYTES = 16 << 20
#: Bits per key of a level, and the level count after which keys must have been told apart.
SPREAD, LEVELS = 2, 64

_INDEX = "part long, seq long, first long, last long, n_docs long, n_ids long, width int, keys binary, level_bits binary, bits binary, ranks binary, fingerprints binary, at binary"
_SHARD = _INDEX + ", payload binary"
#: Ranges of ids that a look-up asks the files' statistics for.
RANGES = 32


# --- minimal perfect hash ---------------------------------------------------------------------------------------------------------


def mixed_bits(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of each key (the finaliser of SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys, from bit arrays alone."""

    def __init__(self, level_bits: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.level_bits, self.bits, self.ranks = level_bits, bits, ranks

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-SPREAD * len(left) // 64) * 64
            at = mixed_bits(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        bits = np.concatenate(levels).view(np.uint64) if levels else np.zeros(0, dtype=np.uint64)
        ranks = np.cumsum(np.append(0, np.bitwise_count(bits)))[:-1].astype(np.uint32) if len(bits) else np.zeros(0, dtype=np.uint32)
        return cls(np.array(sizes, dtype=np.uint64), bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it. A key that was not given may get any slot."""
        out, todo, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.level_bits):
            at = mixed_bits(keys[todo], level) % size + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[word] + below)[hit]
            todo = todo[~hit]
            base += int(size)
        return out


def _key_bits(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """One 64-bit key for a doc_id and its turn among the rows of that id; turns of rows without an id count down from -1."""
    return mixed_bits(keys.view(np.uint64) ^ mixed_bits(turns.astype(np.uint64), 7), 11)


# --- tokenizer --------------------------------------------------------------------------------------------------------------------

#: The pieces of the byte-level pre-tokenizer, for texts of characters below U+0250 only, where every library has the same letters, digits and white space.
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_PLAIN = re.compile("[\0-ɏ]*")
#: Pieces that a worker looks up rather than encodes again.
_KEPT = 1 << 19


class Tokenizer:
    """The library's tokenizer. As it encodes each piece of a text on its own, pieces seen before are looked up."""

    def __init__(self, path: str):
        import tokenizers

        self._own = tokenizers.Tokenizer.from_file(path)
        self._special = [t.content for t in self._own.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}
        self._bytes = np.zeros(self._own.get_vocab_size(), dtype=np.int64)  # of each id: a sign of the alphabet is one
        for token, number in self._own.get_vocab().items():
            self._bytes[number] = len(token)
        #: Bytes of an id in a payload.
        self.width = 2 if self._own.get_vocab_size() <= 1 << 16 else 4

    def packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _new_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces. A blank with letters is split off again where several stand side by side, so many go in one call."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        rest = list(pieces.difference(words))
        out = dict(zip(rest, (self.packed(e.ids) for e in self._own.encode_batch_fast(rest, add_special_tokens=False))))
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for group, found in zip(groups, self._own.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ends = np.cumsum([len(p.encode()) for p in group])
            cuts = (np.searchsorted(np.cumsum(self._bytes[found.ids]), ends) + 1) * self.width
            packed = self.packed(found.ids)
            out.update(zip(group, (packed[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist()))))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        out: list[bytes] = [b""] * len(texts)
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self._special) for t in texts]
        whole = [i for i, p in enumerate(plain) if not p]
        for i, e in zip(whole, self._own.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = self.packed(e.ids)
        pieces = [(i, _PIECE.findall(texts[i])) for i, p in enumerate(plain) if p]
        if len(self._known) > _KEPT:
            self._known.clear()
        known, new = self._known, set()
        looked = []
        for i, own in pieces:
            found, missing = list(map(known.get, own)), []
            try:  # list.index is the fastest way to the few that are new
                at = found.index(None)
                while True:
                    missing.append(at)
                    new.add(own[at])
                    at = found.index(None, at + 1)
            except ValueError:
                looked.append((i, own, found, missing))
        known.update(self._new_pieces(new))
        for i, own, found, missing in looked:
            for at in missing:
                found[at] = known[own[at]]
            out[i] = b"".join(found)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str | None) -> Tokenizer:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))


# --- writing ----------------------------------------------------------------------------------------------------------------------


def _shard(part: int, seq: int, width: int, keys: np.ndarray, turns: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
    own = _key_bits(keys, turns)
    index = PerfectHash.of(own)
    slots = index.slots(own)
    prints, at = np.zeros(len(keys), dtype="<u4"), np.zeros((len(keys), 2), dtype="<u4")
    prints[slots] = (mixed_bits(own, 63) >> np.uint64(32)).astype("<u4")
    at[slots] = np.stack([np.cumsum(size) - size, size], axis=1)
    with_id = keys[turns >= 0]
    row = {"part": part, "seq": seq, "first": int(with_id[0]) if len(with_id) else None, "last": int(with_id[-1]) if len(with_id) else None, "n_docs": len(keys), "n_ids": int(size.sum()), "width": width}
    row |= {"keys": np.stack([keys, turns], axis=1).astype("<i8").tobytes(), "level_bits": index.level_bits.astype("<u8").tobytes(), "bits": index.bits.astype("<u8").tobytes(), "ranks": index.ranks.astype("<u4").tobytes(), "fingerprints": prints.tobytes(), "at": at.tobytes(), "payload": b"".join(ids)}
    kinds = {"width": pa.int32()} | dict.fromkeys(("part", "seq", "first", "last", "n_docs", "n_ids"), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


def _write_shards(batches: Iterator[pa.RecordBatch], path: str | None, shard_ids: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in ascending order of id to shards."""
    own, seq, keys, turns, ids, n = tokenizer(path), 0, [], [], [], 0
    part, last, turn, end = 0, (), 0, own.packed([END_ID])
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            for key, p, new in zip(some.column("key").to_pylist(), some.column("part").to_pylist(), own.encode([t or "" for t in some.column("text").to_pylist()])):
                turn = turn + 1 if key == last else 0
                last, part = key, p
                keys.append(key or 0)
                turns.append(turn if key is not None else -1 - turn)
                ids.append(new + end)
                n += len(ids[-1]) // own.width
                if n >= shard_ids or len(keys) >= shard_docs:
                    yield _shard(part, seq, own.width, np.array(keys, dtype=np.int64), np.array(turns, dtype=np.int64), ids)
                    seq, keys, turns, ids, n = seq + 1, [], [], [], 0
    if keys:
        yield _shard(part, seq, own.width, np.array(keys, dtype=np.int64), np.array(turns, dtype=np.int64), ids)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Encode each whole text (null: empty), end it with END_ID and write all ids in ascending doc_id order to shards at path.

    Rows without an id come first and rows that share an id in the order of their texts' hashes; each has a key of its own in its
    shard, the id with its turn. An empty table gives no shard. Other columns are left out.
    """
    n = partitions(docs.sparkSession)
    placed = few_at_once(docs).select(F.col("doc_id").cast("long").alias("key"), "text")
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ranged = placed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order)
    shards = ranged.mapInArrow(partial(_write_shards, path=tokenizer_path, shard_ids=shard_ids, shard_docs=shard_docs), _SHARD)
    shards.write.option("compression", "none").option("parquet.block.size", BLOCK_BYTES).parquet(path)


# --- reading ----------------------------------------------------------------------------------------------------------------------


class Shard:
    """The index of one shard as read back."""

    def __init__(self, row: dict):
        self.keys, self.turns = np.frombuffer(row["keys"], dtype="<i8").reshape(-1, 2).T
        self.index = PerfectHash(*(np.frombuffer(row[c], dtype=t) for c, t in (("level_bits", "<u8"), ("bits", "<u8"), ("ranks", "<u4"))))
        self.prints = np.frombuffer(row["fingerprints"], dtype="<u4")
        self.at = np.frombuffer(row["at"], dtype="<u4").reshape(-1, 2).astype(np.int64)

    def find(self, keys: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key; an absent key passes for a present one once in 2**32."""
        own = _key_bits(np.ascontiguousarray(keys), np.ascontiguousarray(turns))
        slots = self.index.slots(own)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == (mixed_bits(own[found], 63) >> np.uint64(32)).astype("<u4")
        at = self.at[np.where(found, slots, 0)]
        return found, at[:, 0], at[:, 1]


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of every shard, each looked up in the index."""
    from zlib import crc32

    for batch in batches:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
            shard = Shard(row)
            found, at, size = shard.find(shard.keys, shard.turns)
            if not found.all():
                raise ValueError("a shard doesn't have one of its own keys")
            wide = memoryview(np.frombuffer(row["payload"], dtype=f"<u{row['width']}").astype("<u4")).cast("B")
            checks = [crc32(wide[4 * a : 4 * (a + s)]) for a, s in zip(at.tolist(), size.tolist())]
            own = (np.full(len(at), row[c]) for c in ("part", "seq"))
            columns = [*(pa.array(x, pa.int64()) for x in own), pa.array(shard.keys, pa.int64(), mask=shard.turns < 0), *(pa.array(x, pa.int64()) for x in (at, size, checks))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "key", "at", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the shards at path; start counts the ids of all documents before it.

    A shard's start is a running sum over the shards of its part, and one over the parts, of which there are as many as partitions
    when they were written; it is joined with the documents' few numbers, so no payload moves.
    """
    shards = spark.read.parquet(path)
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(W.orderBy("part"))), F.lit(0)).alias("_part"))
    within = F.coalesce(F.sum("n_ids").over(before(W.partitionBy("part").orderBy("seq"))), F.lit(0))
    starts = sizes.withColumn("_within", within).join(parts, "part").select("part", "seq", (F.col("_part") + F.col("_within")).alias("start"))
    found = shards.mapInArrow(_read_shards, "part long, seq long, key long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("key", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _look_up(batches: Iterator[pa.RecordBatch], wanted: list[int]) -> Iterator[pa.RecordBatch]:
    """From the index alone: where in its shard each document lies that is asked for."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
            shard, keys, turn = Shard(row), np.unique(np.array(wanted, dtype=np.int64)), 0
            starts = shard.turns[np.searchsorted(shard.keys, keys).clip(max=len(shard.keys) - 1)]  # an id may go on from the shard before
            turns = np.maximum(starts, 0)
            while len(keys):  # the next turn of each id that had one
                found, at, size = shard.find(keys, turns)
                keys, turns = keys[found], turns[found] + 1
                own = [pa.array(np.full(len(keys), row[c]), pa.int64()) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys), pa.array(at[found]), pa.array(size[found])], ["part", "seq", "doc_id", "at", "size"])


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for; absent ids give no row.

    The index of the shards whose range holds one of them tells shard, place and size; of the payload, which is a column of its own,
    only those shards are read, and of each the bytes of the document are taken. The ranges that are pushed down to the files'
    statistics are RANGES at most, whatever the number of ids.
    """
    asked = sorted(set(doc_ids))
    step = max(1, -(-len(asked) // RANGES))
    near = F.lit(False)
    for some in (asked[at : at + step] for at in range(0, len(asked), step)):
        near = near | ((F.col("first") <= some[-1]) & (F.col("last") >= some[0]))
    shards = spark.read.parquet(path).where(near)
    places = shards.select(*(c.split(" ")[0] for c in _INDEX.split(", "))).mapInArrow(partial(_look_up, wanted=asked), "part long, seq long, doc_id long, at long, size long")
    own = F.substring("payload", (F.col("at") * F.col("width") + 1).cast("int"), (F.col("size") * F.col("width")).cast("int"))
    bytes_ = places.join(shards.select("part", "seq", "width", "payload"), ["part", "seq"]).select("doc_id", "width", own.alias("ids"))
    return bytes_.mapInArrow(_unpacked, "doc_id long, ids array<long>")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, dtype=f"<u{w}").astype(np.int64) for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])
