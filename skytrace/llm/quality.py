"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import crc32_of_id, few_at_once

#: Bound of the labelled rows that are sent to all tasks; hashed features; dimensions; neighbours that vote; rows of a block.
LABELLED, FEATURES, DIMENSIONS, NEIGHBOURS, BLOCK = 4_000, 4_096, 48, 25, 256
KEEP_FROM = 0.3
SHARES = (0.1, 0.2, 0.3, 0.4)
_TOKENS = re.compile(r"\w+|[^\w\s]").findall
_KEPT = 1 << 16


class Features:
    """Hashed features of texts: each token, and four signs of junk by what share of the text shows them (words in capitals, words
    that repeat the one before, very long words, lines of a word or two), with a feature for each of SHARES that is reached."""

    def __init__(self):
        self._known: dict[str, int] = {}

    def _place(self, token: str) -> int:
        if len(self._known) > _KEPT:
            self._known.clear()
        at = self._known[token] = crc32(token.lower().encode()) % FEATURES
        return at

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens, words, lines = _TOKENS(text), text.split(), text.split("\n")
        counts = Counter(tokens)
        signs = {
            "capitals": (sum(n for t, n in counts.items() if len(t) > 1 and t.isupper()), len(words)),
            "again": (sum(map(eq, words, words[1:])), len(words)),
            "long": (sum(n for t, n in counts.items() if len(t) > 24), len(words)),
            "short": (sum(0 < len(x.split(None, 2)) < 3 for x in lines), len(lines)),
        }
        counts.update({f"\0{k}{share}": n for k, (n, all_) in signs.items() for share in SHARES if n > 2 and n >= share * all_})
        known = self._known
        at = np.array([known[t] if t in known else self._place(t) for t in counts], dtype=np.int64)
        n = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        return at, 1 + np.log(n)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Features()
    for batch in batches:
        at, value = [], []
        for text in batch.column("text").to_pylist():
            i, v = own.of(text)
            summed = np.bincount(i, v, FEATURES) if len(i) else np.zeros(FEATURES)
            at.append(np.flatnonzero(summed))
            value.append(summed[at[-1]])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))], ["doc_id", "quality", "at", "value"])


@dataclass
class Model:
    rarity: np.ndarray  # per feature
    axes: np.ndarray  # feature to dimension
    vectors: np.ndarray  # labelled texts, of length 1 or 0
    labels: np.ndarray

    def place(self, at: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Latent vectors of texts whose features lie one after another in at and value."""
        out = np.zeros((len(sizes), self.axes.shape[1]), dtype=np.float32)
        begin = np.cumsum(sizes) - sizes
        held = sizes > 0
        if held.any():
            out[held] = np.add.reduceat(self.axes[at] * (value * self.rarity[at]).astype(np.float32)[:, None], begin[held], axis=0)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The labels of each vector's NEIGHBOURS nearest labelled texts, weighted by similarity; the mean label without any."""
        mean = float(self.labels.mean()) if len(self.labels) else 0.0
        if not len(self.labels):
            return np.full(len(vectors), mean)
        near = vectors @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        return np.divide((weight * self.labels[top]).sum(axis=1), total, out=np.full(len(vectors), mean), where=total > 0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A bounded sample of labelled texts, those of the smallest hashes of their ids, from rows whose crc32(doc_id as text) mod 5 is
    not 0; whole texts, of which at most FEATURES sums each reach the driver. Of rows that share an id the text of the smallest hash
    counts, of repeated labels the higher. Axes are the first right singular vectors of their
    weighted features (subspace iteration). Without labels there are no vectors and every score is 0."""
    known = labels.where((crc32_of_id("doc_id") % 5 != 0) & F.col("quality").isNotNull())
    picked = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit("quality"), "doc_id")).limit(LABELLED)
    # LABELLED rows of two numbers, so they may be sent to all tasks.
    texts = few_at_once(docs).where(crc32_of_id("doc_id") % 5 != 0).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # One text an id, chosen on the map side first, so that no id brings more than one to the driver.
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "quality", "t.text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_feature_rows, f"doc_id {kind}, quality int, at array<long>, value array<double>").toPandas().sort_values("doc_id")
    table = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"])):
        table[i, np.asarray(at, dtype=int)] = value
    rarity = np.log((1 + len(table)) / (1 + (table > 0).sum(axis=0))).astype(np.float32)
    weighed = table * rarity
    weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-9)
    axes = np.random.default_rng(7).standard_normal((FEATURES, min(DIMENSIONS, max(1, len(table))))).astype(np.float32)
    for _ in range(6):
        axes, _r = np.linalg.qr(weighed.T @ (weighed @ axes)) if len(table) else (axes, None)
    model = Model(rarity, np.ascontiguousarray(axes), np.zeros((0, axes.shape[1]), np.float32), rows["quality"].to_numpy(dtype=np.float64))
    own = weighed @ axes
    length = np.linalg.norm(own, axis=1, keepdims=True)
    model.vectors = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    own = Features()
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            found = [own.of(t) for t in part.column("text").to_pylist()]
            sizes = np.array([len(i) for i, _ in found])
            scores = model.vote(model.place(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), sizes))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "quality_score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score), 0 to 1, of every whole text: cosines with all labelled vectors, a block of texts at a time. A text
    without tokens, null ones too, gets the mean label. Rows keep their number; other columns are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return few_at_once(docs).select("doc_id", "text").mapInArrow(partial(_scores, model=model), f"doc_id {kind}, quality_score double")
