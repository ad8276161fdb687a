"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) on the presence of telling words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import crc32_of_id, few_at_once, written

#: Bounds of what the classifier is fitted on: rows of confirmed toxic text, rows of unlabelled text, words used.
POSITIVES, UNLABELLED, WORDS = 6_000, 12_000, 1_024
#: A word tells something from this many standard errors on, from so many toxic texts and from this share of them.
LEAST_Z, LEAST_TEXTS, LEAST_SHARE = 5.5, 4, 0.01
#: Letters of a stem: the beginning that two or more different words of a text share.
STEMS = (5, 6, 7)
REJECT_FROM = 0.7
#: Bounds of the estimated share of toxic texts, and the chance that its bounds may fail.
LEAST_PRIOR, MOST_PRIOR, RISK = 1e-3, 0.9, 0.1
_WORDS_OF = re.compile(r"[^\W_]+").findall


def signs(text: str | None) -> set[str]:
    """What a text may be told by: its words, lower-cased, and with a hyphen the stems of several of its words."""
    words = set(_WORDS_OF((text or "").lower()))
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return words | {s + "-" for s, n in stems.items() if n > 1}


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([sorted(signs(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([found if c == "text" else batch.column(c) for c in batch.schema.names], ["words" if c == "text" else c for c in batch.schema.names])


def without_kin(found: list[str]) -> list[str]:
    """Words and stems, the most telling first, but those that share their beginning with a stem before them."""
    kept, stems = [], []
    for sign in found:
        bare = sign.removesuffix("-")
        if not any(bare.startswith(s) or s.startswith(bare) for s in stems):
            kept.append(sign)
            stems += [bare] * sign.endswith("-")
    return kept


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray  # one per word, then the bias

    def scores(self, present: list[list[int]]) -> np.ndarray:
        sums = np.array([self.weights[at].sum() for at in present], dtype=float) + self.weights[-1]
        return 1 / (1 + np.exp(-sums))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, shrink: float = 5e-3) -> np.ndarray:
    """Weights and bias of a linear classifier that minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)).

    The loss of a toxic text taken for a clean one is logistic, so that texts with a single telling word count too; that of a clean
    one taken for toxic is the sigmoid, which is bounded: a few texts full of such words can't outweigh the rest. Where the second
    term would be negative, it is 0 and has no slope, so that nothing is gained by overfitting it. Words are given for being more
    frequent in toxic texts, so no weight falls below 0; the bias is shrunk, and weights are drawn to the log odds they start from, so
    that of words that go together none loses its weight to the others. Adam, full batches.
    """
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (positive, unlabelled))
    in_p, in_u = p.mean(axis=0), u.mean(axis=0)
    # Start from each word's log odds; what of its share in U is due to toxic texts is taken out.
    clean = np.maximum(in_u - prior * in_p, 0) / max(1 - prior, 1e-6)
    w = np.maximum(np.log((in_p + 0.5 / len(p)) / (clean + 0.5 / len(u))), 0).astype(np.float32)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    start = np.append(w[:-1], 0)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        negative = su.mean() - prior * sp.mean()
        up = prior * p.T @ (sp - 1) / len(p)
        down = u.T @ (su * (1 - su)) / len(u) - prior * p.T @ (sp * (1 - sp)) / len(p)
        grad = up + down if negative > 0 else up
        grad += shrink * np.append((w[:-1] - start[:-1]) / 10, w[-1]).astype(np.float32)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return w.astype(np.float64)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of toxic texts among unlabelled ones, from how both kinds show the signs; no clean label is needed.

    Of texts that score c or more, unlabelled ones hold at least prior times the share of toxic ones; near the top they hold hardly
    more. The c is the one at which this ratio is surely lowest, as both shares are samples (best bin estimation, Garg et al., 2021).
    """
    weights = np.maximum(np.log((positive.mean(axis=0) + 0.5 / len(positive)) / (unlabelled.mean(axis=0) + 0.5 / len(unlabelled))), 0)
    p, u = (np.sort(x @ weights) for x in (positive, unlabelled))
    at = np.unique(p)
    in_p, in_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = math.sqrt(math.log(4 / RISK) / 2 / len(u)) + math.sqrt(math.log(4 / RISK) / 2 / len(p))
    best = int(((in_u + slack) / in_p).argmin())
    return float(np.clip(in_u[best] / in_p[best], LEAST_PRIOR, MOST_PRIOR))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Learn from toxic labels of rows whose crc32(doc_id as text) mod 3 is not 1, and from unlabelled texts of such rows.

    Both samples hold whole texts, those of the smallest hashes of their ids, so reruns agree; rows that share an id are as many texts,
    but no more than POSITIVES + UNLABELLED in all, those of the smallest hashes. Of repeated labels of an id one that says toxic
    tells. Words and stems are picked by how much more often toxic texts have them; what reaches the driver is the picked ones and
    which of them each sampled text has. Labels that say clean are not looked at. The class prior, if none is given, is estimated from
    the unlabelled texts. Without a toxic text, or without signs that LEAST_TEXTS of them share, the model scores every text 0.
    """
    learn = crc32_of_id("doc_id") % 3 != 1
    known = labels.where(learn & (F.col("toxic") == 1) & F.col("doc_id").isNotNull())
    none = Model([], np.array([-np.inf]))
    if known.isEmpty():
        return none
    hashed = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = known.select("doc_id").distinct().orderBy(hashed).limit(POSITIVES).select(F.col("doc_id").alias("_p"))
    told = F.col("_p").isNotNull()
    # Two bounded sets of ids, so both may be sent to all tasks; each text of them comes back as its words and stems.
    spare = docs.where(learn).select("doc_id").distinct().orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id")).limit(UNLABELLED).select(F.col("doc_id").alias("_u"))
    texts = docs.where(learn).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_p"), "left").join(F.broadcast(spare), F.col("doc_id") == F.col("_u"), "left")
    texts = few_at_once(texts.where("_p is not null or _u is not null")).select(told.alias("toxic"), F.col("_u").isNotNull().alias("unlabelled"), "text")
    sample = written(texts.mapInArrow(_signs, "toxic boolean, unlabelled boolean, words array<string>"), "toxicity-sample")
    # Copies count once, so that the words of one toxic text with many copies don't tell.
    sample = sample.groupBy(F.xxhash64("words").alias("text")).agg(F.max("toxic").alias("toxic"), F.max("unlabelled").alias("unlabelled"), F.first("words").alias("words"))
    sample = written(sample.orderBy("text").limit(POSITIVES + UNLABELLED), "toxicity-sample")
    n_p, n_u = sample.agg(F.count_if("toxic"), F.count_if("unlabelled")).first()
    if not n_p or not n_u:
        return none
    counts = sample.select("toxic", "unlabelled", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("p"), F.count_if("unlabelled").alias("u"))
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    vocabulary = without_kin([r.word for r in counts.where(F.col("p") >= max(LEAST_TEXTS, LEAST_SHARE * n_p)).where(z >= LEAST_Z).orderBy(z.desc(), "word").limit(WORDS).select("word").collect()])
    known_words = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    has = F.transform(F.array_intersect("words", known_words), lambda x: F.array_position(known_words, x).cast("int"))
    rows = sample.select("toxic", "unlabelled", has.alias("has")).toPandas()
    table = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, at in enumerate(rows["has"]):
        table[i, np.asarray(at, dtype=int) - 1] = 1
    positive, unlabelled = table[rows["toxic"]], table[rows["unlabelled"]]
    if not vocabulary:
        return none
    prior = class_prior(positive, unlabelled) if prior is None else min(max(prior, LEAST_PRIOR), MOST_PRIOR)
    return Model(vocabulary, fit_nnpu(positive, unlabelled, prior))


def score(docs: DataFrame, model: Model, out: str = "toxic_score") -> DataFrame:
    """docs with a column `out`, the last unless there is one of that name, which it replaces: 0 to 1 for each whole text; a null or
    empty text has the score of no word. Rows are scored on their own, repeated ones alike."""
    place = {w: i for i, w in enumerate(model.words)}
    weights = model.weights

    def one(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(list(place), weights)
        for batch in texts:
            yield pa.array(own.scores([[place[w] for w in place.keys() & signs(t)] for t in batch.to_pylist()]), pa.float64())

    return few_at_once(docs).withColumn(out, F.arrow_udf(one, "double")("text"))


#: A column that is added to documents for a while; documents bring none like it.
_OWN = "__toxicity_score"


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    """docs without those that score reject_from or more; columns as they come, whatever their names. Null and empty texts stay, rows
    that share an id are judged each by its own text, and an empty table gives no rows."""
    return score(docs.select("*"), fit(docs, labels), _OWN).where(F.col(_OWN) < reject_from).drop(_OWN)
