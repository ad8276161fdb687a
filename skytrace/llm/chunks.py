"""Substring deduplication: content-defined chunks under a gear rolling hash, deduplicated by digest.

A chunk may begin at a word, or where there is no ASCII white space near by at any character, if the preceding bytes have a small
gear hash. The hash looks back GEAR_BYTES bytes only, and a place counts unless another lies shortly before it, so an insertion moves
no boundary further on. What is compared is the digest of a window: the chunks from one on, as few as make up RUN_WORDS words or
RUN_BYTES bytes, and the last ones of a text in the same way. Every digest keeps its first occurrence, by (doc_id, offset), and all others are cut out. So only a passage that
occurs elsewhere as a whole goes, however common its words or lines are on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import few_at_once, written

#: The hash has 16 bits and shifts by one a byte, so it forgets what lies further back.
GEAR_BYTES = 16
#: One word start in so many may begin a chunk; the least and the most bytes of one (a chunk at a text's start or end may be shorter).
ONE_IN, LEAST_BYTES, MOST_BYTES = 4, 16, 512
#: So many bytes after the last ASCII white space, one character in so many may begin a chunk.
DENSE_AFTER, DENSE_ONE_IN = 48, 8
#: A repeated passage is cut from so many words, or so many bytes of fewer words, on.
RUN_WORDS, RUN_BYTES = 15, 256
_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
_GEAR[0] = 0  # so that the bytes between texts leave no trace
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A window's place in one long: the offset, and in the last bits its size, which is below RUN_BYTES + MOST_BYTES.
_SIZE_BITS = 10
_BATCH_BYTES = 2 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the GEAR_BYTES bytes that end there, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def chunk_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of the chunks of texts that lie in data at [starts, ends), GEAR_BYTES zero bytes between them."""
    space, hashes = _SPACE[data], gear_hashes(data)
    blank = space | (data == 0)
    since = np.arange(len(data)) - np.maximum.accumulate(np.where(blank, np.arange(len(data)), -1))
    begins = (data[1:] & 0xC0) != 0x80  # a character
    word = space[:-1] & (hashes[:-1] < (1 << 16) // ONE_IN)
    dense = (since[:-1] >= DENSE_AFTER) & (hashes[:-1] < (1 << 16) // DENSE_ONE_IN)
    can = np.flatnonzero(begins & ~blank[1:] & (word | dense)) + 1
    text = np.searchsorted(starts, can, side="right") - 1
    lone = np.append(True, (np.diff(can) >= LEAST_BYTES) | (text[1:] != text[:-1]))[: len(can)]
    lone &= (can > starts[text]) & (can < ends[text])
    begin = np.concatenate([starts, can[lone]])
    of = np.concatenate([np.arange(len(starts)), text[lone]])
    order = np.lexsort((begin, of))
    begin, of = begin[order], of[order]
    end = np.append(begin[1:], 0)
    last = np.append(of[1:] != of[:-1], True)
    end[last] = ends[of[last]]
    extra, extra_of = [], []
    for i in np.flatnonzero(end - begin > MOST_BYTES).tolist():
        at, stop = int(begin[i]), int(end[i])
        while stop - at > MOST_BYTES:  # the least hash of a stretch: in texts that repeat themselves, the same place of each period
            lo, hi = at + MOST_BYTES // 2, at + MOST_BYTES
            at = lo + int(np.where(begins[lo - 1 : hi - 1], hashes[lo - 1 : hi - 1].astype(np.int32), 1 << 16).argmin())
            extra.append(at)
            extra_of.append(of[i])
    if extra:
        begin, of = np.concatenate([begin, extra]), np.concatenate([of, extra_of])
        order = np.lexsort((begin, of))
        begin, of = begin[order], of[order]
        end = np.append(begin[1:], 0)
        last = np.append(of[1:] != of[:-1], True)
        end[last] = ends[of[last]]
    keep = end > begin
    return of[keep], begin[keep], end[keep]


def _window_texts(ids: pa.Array, marks: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    from xxhash import xxh3_128_digest

    gap = bytes(GEAR_BYTES)
    joined = gap.join(texts) + gap
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(size + GEAR_BYTES) - size - GEAR_BYTES
    data = np.frombuffer(joined, dtype=np.uint8)
    of, begin, end = chunk_bounds(data, starts, starts + size)
    blank = _SPACE[data] | (data == 0)
    words = np.append(0, np.cumsum(np.append(~blank[0], blank[:-1] & ~blank[1:])))  # that begin before each byte
    last = np.minimum(np.searchsorted(words[end], words[begin] + RUN_WORDS), np.searchsorted(end, begin + RUN_BYTES))
    whole = last < len(end)
    whole[whole] = of[last[whole]] == of[whole]
    # The last chunk of a text may be in no window from a chunk on: the shortest that ends with it.
    tail = np.flatnonzero(np.append(of[1:] != of[:-1], True)[: len(of)])
    head = np.maximum(np.searchsorted(words[begin], words[end[tail]] - RUN_WORDS, side="right"), np.searchsorted(begin, end[tail] - RUN_BYTES, side="right")) - 1
    known = (head >= 0) & (of[np.maximum(head, 0)] == of[tail])
    tail, head = tail[known], head[known]
    known = last[head] != tail
    tail, head = tail[known], head[known]
    of, begin, end = np.append(of[whole], of[tail]), np.append(begin[whole], begin[head]), np.append(end[last[whole]], end[tail])
    digests = np.frombuffer(b"".join([xxh3_128_digest(joined[s:e]) for s, e in zip(begin.tolist(), end.tolist())]), dtype=np.int64).reshape(-1, 2)
    place = (begin - starts[of]) << _SIZE_BITS | (end - begin)
    columns = [ids.take(pa.array(of)), pa.array(place), pa.array(marks[of]), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "mark", "digest", "digest2"])


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.asarray(batch.column("size").to_numpy(zero_copy_only=False), dtype=np.int64)
        load = np.cumsum(size) // _BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if hi > lo:
                yield _window_texts(part.column("doc_id"), part.column("mark").to_numpy(), part.column("text").to_pylist())


def _mark() -> Column:
    """The text's 64-bit hash: tells apart texts that share a doc_id."""
    return F.xxhash64("text")


def text_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, place, mark, digest, digest2): the window at every chunk of every whole text that has enough words or bytes from there
    on; place packs offset and bytes into one long. The digest has 128 bits, as among 10^12 windows some pairs share any 64."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = few_at_once(docs).where("octet_length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("text"), _mark().alias("mark"), F.octet_length("text").alias("size"))
    return texts.mapInArrow(_window_batches, f"doc_id {kind}, place long, mark long, digest long, digest2 long")


def _start(place: str) -> Column:
    return F.shiftright(place, _SIZE_BITS)


def _size(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << _SIZE_BITS) - 1)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with the stretches to cut: those that touch or overlap become one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("found")
        bounds = lists.offsets.to_numpy()
        found = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        start, end, first = found.field("start").to_numpy(), found.field("end").to_numpy(), found.field("first_id")
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort((start, row))
        start, end, row = start[order], end[order], row[order]
        reach = np.maximum.accumulate(row << 44 | end)  # rows are in order, so an earlier row reaches into no later one
        heads = np.flatnonzero(np.append(True, (row << 44 | start)[1:] > reach[:-1])[: len(row)])
        tails = np.append(heads[1:], len(row)) - 1
        stops = reach[tails] & ((1 << 44) - 1)
        rows, at = np.unique(row[heads], return_index=True)
        at = np.append(at, len(heads))
        spans = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64()))
        cut = np.add.reduceat(stops - start[heads], at[:-1]) if len(rows) else stops
        kept = []
        for lo, hi in zip(heads[at[:-1]].tolist(), [*heads[at[1:-1]].tolist(), len(row)]):
            kept.append(sorted(first.take(pa.array(order[lo:hi])).unique().to_pylist(), key=lambda x: (x is not None, x)))
        ids, marks = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "mark"))
        columns = [ids, marks, spans(start[heads]), spans(stops), pa.array(cut, pa.int64()), pa.array(kept, pa.list_(first.type))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "starts", "ends", "cut_bytes", "first_ids"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, starts, ends, cut_bytes, first_ids): for each text with repeated passages, the byte ranges to cut, their bytes
    and the documents where they occur first.

    A passage is repeated where another text, or the same text before, has it; its first occurrence by (doc_id, offset) stays, null
    ids first. Rows with the same id and text count as one document. Null and empty texts have no passages. A passage is found where
    it holds whole chunks of RUN_WORDS words or RUN_BYTES bytes in all; up to a chunk at its start and two at its end stay.
    """
    windows = written(text_windows(docs), "windows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    key, own = ["digest", "digest2"], F.struct("doc_id", "place", "mark")
    # A min and a max per digest, on the map side first: a passage in a third of all texts is one row per task.
    first = windows.groupBy(*key).agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first != last").select(*key, "first")
    later = windows.join(first, key).where(own != F.col("first"))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    # A window that overlaps its own first occurrence is cut from where that ends.
    start = F.when(same, F.greatest(_start("place"), _start("first.place") + _size("first.place"))).otherwise(_start("place"))
    found = later.select("doc_id", "mark", F.struct(start.alias("start"), (_start("place") + _size("place")).alias("end"), F.col("first.doc_id").alias("first_id")).alias("found"))
    listed = found.groupBy("doc_id", "mark").agg(F.collect_set("found").alias("found"))  # a set, as repeated rows bring each again
    return listed.mapInArrow(_joined, f"doc_id {kind}, mark long, starts array<long>, ends array<long>, cut_bytes long, first_ids array<{kind}>")


#: Prefix of the columns that are added to documents for a while; documents bring none like these.
_OWN = "__chunks_"


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, lengths = [], [], []
        counted = "n_chars" in batch.schema.names and pa.types.is_integer(batch.schema.field("n_chars").type)
        old = batch.column("n_chars").to_pylist() if counted else [None] * batch.num_rows
        for n, (text, starts, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", _OWN + "starts", _OWN + "ends")))):
            if starts:
                raw, at, parts = text.encode(), 0, []
                for s, e in zip(starts, ends):
                    parts.append(raw[at:s])
                    at = e
                left = b"".join([*parts, raw[at:]])
                if not left.split():
                    continue
                text = left.decode()
                old[n] = len(text)
            rows.append(n)
            texts.append(text)
            lengths.append(old[n])
        kept = pa.array(rows, pa.int64())
        new = {"text": texts} | ({"n_chars": lengths} if counted else {})
        names = [c for c in batch.schema.names if not c.startswith(_OWN)]
        yield pa.RecordBatch.from_arrays([pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(c).take(kept) for c in names], names)


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from the texts; a document of which no word is left goes, one that had none stays.

    n_chars, if there is one of whole numbers, follows the text where it was cut. All other columns stay as they are, whatever their
    names; rows that repeat an id and a text are cut alike; null ids are ids. An empty table gives no rows.
    """
    spans = repeated_spans(docs.select("doc_id", "text")).select([F.col(c).alias(_OWN + c) for c in ("doc_id", "mark", "starts", "ends")])
    same = docs["doc_id"].eqNullSafe(spans[_OWN + "doc_id"]) & (_mark() == spans[_OWN + "mark"])
    both = docs.join(spans, same, "left").select(*docs.columns, _OWN + "starts", _OWN + "ends")
    return both.mapInArrow(_cut_batches, docs.schema)
