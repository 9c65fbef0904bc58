"""Quality classifier: logistic regression over hashed word n-grams, trained online by FTRL-proximal.

Tokens are runs of letters and digits or runs of other signs, in lower case. A text has its
unigrams, its bigrams, and for each three tokens in a row the pattern of which of them are equal (so that
repetition is seen whatever word repeats). Features are hashed into ``2 ** BITS`` buckets; a score
is the sparse dot product of counts and weights over the root of the number of features.

Defined results: null and empty texts have no features and get the score of the bias alone; rows that
repeat get equal scores; without any usable label every score is 0.5; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import SIGNS, Tokens, buffers, chunks, mix

BITS = 18
#: At most so many labelled texts are learned from, those with the least hash of their id.
TRAIN_ROWS = 8192
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
_U = np.uint64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of each n-gram, and the number of n-grams per text."""
    tokens = Tokens(data, offsets, SIGNS)
    h, row = tokens.hash, tokens.row
    two = row[1:] == row[:-1]
    three = row[2:] == row[:-2]
    pairs = mix(h[:-1] * _U(3) + h[1:])[two]
    same = (h[:-2] == h[1:-1]).astype(_U) + _U(2) * (h[:-2] == h[2:]).astype(_U) + _U(4) * (h[1:-1] == h[2:]).astype(_U)
    pattern = mix(same[three] + _U(0xABCDEF))
    rows = np.concatenate([row, row[:-1][two], row[:-2][three]])
    buckets = (np.concatenate([h, pairs, pattern]) >> _U(64 - BITS)).astype(np.int64)
    return buckets, rows, np.bincount(rows, minlength=len(offsets) - 1)


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _per_text(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = buffers(lower(texts))
    for a, b in chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        buckets, rows, _ = features(data[offsets[a] : offsets[b]], at)
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(b - a + 1))
        for i in range(b - a):
            found, count = np.unique(buckets[order[cuts[i] : cuts[i + 1]]], return_counts=True)
            yield found, count / np.sqrt(max(1, count.sum()))


class Ftrl:
    """Follow the regularised leader, one coordinate at a time; weights of little use stay exactly 0."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all buckets; the last one is the bias."""
    model, bias = Ftrl(1 << BITS), Ftrl(1, l1=0.0)
    one = np.zeros(1, np.int64)
    for _ in range(epochs):
        for (at, x), label in zip(texts, labels, strict=True):
            w, b = model.weights(at), bias.weights(one)
            error = sigmoid(w @ x + b[0]) - label
            model.update(at, error * x, w)
            bias.update(one, np.array([error]), b)
    return np.append(model.weights(), bias.weights())


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += _per_text(batch.column("text"))
        labels += batch.column("label").to_pylist()
    weights = fit(texts, np.array(labels, float))
    found = np.flatnonzero(weights)
    yield pa.RecordBatch.from_pydict({"bucket": found.astype(np.int32), "weight": weights[found]})


def training_rows(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most ``bound`` labelled documents, in a fixed order, in one partition.

    The choice is by a hash of the id. The chosen labels are bounded, so they are broadcast and no
    text of another document moves; a second limit holds where an id has many rows.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    chosen = (
        labels.where(use & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(order, "doc_id", "label")
        .limit(bound)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(order, "doc_id", "label", F.xxhash64("text"))
        .limit(bound)
        .select("text", "label")
    )


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int = TRAIN_ROWS) -> np.ndarray:
    """Train in one task on a bounded sample; at most ``2 ** BITS + 1`` weights come back to the driver."""
    rows = training_rows(docs, labels, label, use, bound).mapInArrow(_train, "bucket int, weight double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[rows.column("bucket").to_numpy()] = rows.column("weight").to_numpy()
    return weights


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function from text to the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = shared.value
        data, offsets = buffers(lower(texts))
        out = np.full(len(offsets) - 1, float(w[-1]))
        for a, b in chunks(offsets):
            buckets, rows, count = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] += np.bincount(rows, w[buckets], b - a) / np.sqrt(np.maximum(count, 1))
        return pa.array(sigmoid(out))

    return score


def held_out(modulus: int, rest: int) -> Column:
    """Whether a row is kept from learning: the remainder of CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = train(docs, labels, "quality", ~held_out(3, 1))
    score = scorer(docs, weights)
    return docs.select("doc_id", held_out(3, 1).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, all columns as they were.

    A document without any word is no evidence of low quality and stays.
    """
    score = scorer(docs, train(docs, labels, "quality", ~held_out(3, 1)))
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.where((score(text) >= threshold) | (F.trim(text) == ""))
