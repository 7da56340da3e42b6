"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs
with one word between, lower-cased and hashed to 2 ** BITS coordinates.  Each
coordinate has a learning rate of its own, which falls with the gradients that
it has seen, and an L1 penalty that keeps it at zero until they agree; what is
left are a few thousand weights, broadcast to every task.

Rows: a null or empty text has no feature and gets the score of the bias alone.
Labels other than 0 and 1, and labels without a document, teach nothing; a
document that is labelled or listed twice is learned from once (label 1 wins,
the smallest text counts), and without any label every score is 0.5.  Rows with
equal texts get equal scores.  Columns of ``docs`` stay, unless they are called
as one that is added.

Scale: documents are learned from in one pass by one task, about ``sample`` of
them, chosen by a hash of their ids; the ids are counted and chosen before any
text is read.  The learner holds one document and 2 ** BITS coordinates.
Scoring is one pass over all documents without a shuffle; a task holds half a
megabyte of text, or one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import hashing
from attestra.llm.base import chunks, text_bytes, written

#: Documents that the model is fitted on, about; bounds the one task that learns.
SAMPLE = 16_000
BITS = 22
#: Rate of a coordinate at its first gradient and how soon it falls; penalties by absolute value and by square.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
#: Seeds of the two kinds of pairs: words that follow each other, and words with one between.
PAIRS = ((1, np.uint64(0xA0761D6478BD642F)), (2, np.uint64(0xE7037ED1A0B428DB)))
_RANGE = 1 << 31


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every word, pair and skip pair of the texts."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends, rows = hashing.words(data, offsets, hashing.PUNCTUATION)
    words = hashing.word_hashes(data, starts, ends)
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at, found = [of], [words]
    for gap, seed in PAIRS:
        inside = of[gap:] == of[:-gap]
        at.append(of[gap:][inside])
        found.append(hashing.mix(words[:-gap] * seed + words[gap:])[inside])
    return np.concatenate(at), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


class Learner:
    """The state of FTRL-proximal: sums of adjusted gradients ``z`` and of squared ones ``n``; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == len(self.z) - 1  # the bias pays no penalty
        over = np.where(free, np.abs(z), np.maximum(np.abs(z) - L1, 0))
        return -np.sign(z) * over / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, coordinates: np.ndarray, label: int) -> None:
        at = np.append(coordinates, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.n[at] = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at]) - np.sqrt(n)) / ALPHA * w


def _distinct(texts: pa.Array, bits: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of the distinct features, by row; only coordinates that ``keep`` marks."""
    row, at = features(texts, bits)
    if keep is not None:
        useful = keep[at]
        row, at = row[useful], at[useful]
    both = np.unique((row << bits) | at)
    return both >> bits, both & ((1 << bits) - 1)


def sampled(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of about ``sample`` labelled training documents, one row an id, in the order of a hash of it.

    Ids are counted first; those whose hash falls below the share wanted are
    taken, which needs no sort and no row more than it keeps.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = written(docs.filter(training).select("doc_id").distinct().join(known, "doc_id"), "labelled")
    share = sample / max(sample, ids.count())
    order = F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE))
    picked = written(ids.filter(order < F.lit(int(share * _RANGE))), "picked")
    # about ``sample`` rows of two numbers, small enough to broadcast
    rows = docs.filter(training).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy(order, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(rows: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero, learned in one pass in the order of ``rows``; the last is the bias."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, label = Learner(bits), None
        for batch in chunks(batches):
            row, at = _distinct(batch.column(0), bits)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, label in enumerate(batch.column(1).to_pylist()):
                learner.learn(at[cuts[i] : cuts[i + 1]], label)
        touched = np.append(np.flatnonzero(learner.n[:-1]), len(learner.n) - 1)
        weights = learner.weights(touched) if label is not None else np.zeros(1)
        kept = np.append(np.flatnonzero(weights[:-1]), len(weights) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(touched[kept]), pa.array(weights[kept])], names=["at", "weight"])

    learned = rows.coalesce(1).mapInArrow(learn, "at long, weight double").orderBy("at").toArrow()  # a few thousand, 2 ** bits at most
    if not learned.num_rows:  # no partition, so no learner ran
        return np.array([1 << bits]), np.zeros(1)
    return learned.column("at").to_numpy(), learned.column("weight").to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """``docs`` with score (the probability of label 1) and predicted (1 from 0.5 on).  Only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, weight = sent.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = weight
        keep = dense != 0
        for texts in batches:
            found = []
            for part in chunks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
                row, coordinate = _distinct(part.column(0), bits, keep)
                total = np.bincount(row, dense[coordinate], part.num_rows) + dense[-1]
                found.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    kept = docs.drop("score", "predicted")
    scored = kept.withColumn("score", F.arrow_udf(judge, "double")("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
