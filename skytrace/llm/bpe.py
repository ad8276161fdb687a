"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved down to leaves, which the tokenizer encodes on their own. Two neighbours are joined by encoding a window around
their border again: it grows until both its ends are places where every way to split the text has a border, so the ids outside
can't change. Decoding is a homomorphism: the bytes of halves are concatenated up the tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import few_at_once

#: Characters of a leaf; the least part of a window on either side of a border.
LEAF, WINDOW = 4096, 64
#: Between a character that is no white space and a plain blank, every way to split a text has a border: a piece holds white space
#: only as its first character or throughout, and looks ahead at most one character behind itself.
_BORDER = re.compile(r"(?<=\S)(?=[ \t\n\r])")
#: White space as the tokenizer's pattern knows it. A long run of it is taken out before the library sees it, whose pattern would look
#: ahead from within it too deeply: before a character that is none, the run is one piece but for its last character.
_LONG_RUN = 1_000
_SPACE = "[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


@lru_cache(maxsize=4)
def _long_runs(least: int) -> re.Pattern:
    return re.compile(f"{_SPACE}{{{least},}}+")


class Codec:
    """The tokenizer of a rank file, and the byte length of each id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, long_run: int = _LONG_RUN):
        import tiktoken

        self.long_run = long_run
        self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a text that is encoded on its own."""
        parts, at = [], 0
        for run in _long_runs(self.long_run).finditer(text):
            stop = run.end() - (run.end() < len(text))
            parts += [*self._own.encode_ordinary(text[at : run.start()]), *self._own._encode_single_piece(text[run.start() : stop])]
            at = stop
        return np.array(parts + self._own.encode_ordinary(text[at:]), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(text, mid, self.encode(text[:mid]), self.encode(text[mid:]))

    def join(self, text: str, mid: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text from those of text[:mid] and text[mid:]."""
        lo, hi, reach = None, None, WINDOW
        while lo is None or hi is None:
            if lo is None and reach >= mid:
                lo = 0
            elif lo is None:
                start = mid - reach
                found = _BORDER.search(text, start, mid - WINDOW // 2)
                lo = found.start() if found else None
            if hi is None:
                found = _BORDER.search(text, mid + 1, min(len(text), mid + reach))
                hi = found.start() if found else len(text) if mid + reach >= len(text) else None
            reach *= 2
        keep = self._count(left[::-1], len(text[lo:mid].encode()))
        skip = self._count(right, len(text[mid:hi].encode()))
        return np.concatenate([left[: len(left) - keep], self.leaf(text[lo:hi]), right[skip:]])

    def _count(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many ids make up n_bytes."""
        if not n_bytes:
            return 0
        upto = np.cumsum(self.size[ids[:n_bytes]])
        at = int(np.searchsorted(upto, n_bytes))
        if at == len(upto) or upto[at] != n_bytes:
            raise AssertionError("a border lies within a token")
        return at + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return self._own.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file; the public 50k vocabulary and its pattern where none is named. Once per process."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return Codec(ranks, pattern or public_tokenizers.PATTERN)


def _mapped(batches: Iterator[pa.RecordBatch], take: str, give: str, change: Callable[[], Callable], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Replace column `take` by a binary column `give`, a few rows at a time."""
    one = change()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            new = pa.array([one(x) for x in part.column(take).to_pylist()], pa.binary())
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([new if n == take else part.column(n) for n in names], [give if n == take else n for n in names])


def _encoder(path: str | None) -> Callable[[str | None], bytes]:
    own = codec(path)
    return lambda text: own.encode(text or "").tobytes()


def _decoder(path: str | None) -> Callable[[bytes], bytes]:
    own = codec(path)
    return lambda ids: own.decode(np.frombuffer(ids, dtype="<u4"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of each whole text as little-endian unsigned 32-bit integers; a null text counts as empty. Rows keep
    their number and order within their partition, repeated ones too; other columns are left out. A text may be of any length, a
    million blanks in a row included; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = few_at_once(docs).select("doc_id", "text")
    return source.mapInArrow(partial(_mapped, take="text", give="ids", change=partial(_encoder, path)), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encode() with a column decoded: the bytes that the ids stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    source = encoded.select("doc_id", "ids", F.col("ids").alias("decoded"))
    return source.mapInArrow(partial(_mapped, take="decoded", give="decoded", change=partial(_decoder, path)), f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """What a result of encode() and decode() comes to: number of ids and digests of both directions."""
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
