"""Toxicity: a second-order factorization machine over hashed terms.

The terms of a text are its words in lower case and their first 4, 5, 6 and 7 bytes, each with the number of
times it occurs (1, 2, or 3 and more: reaching a number sets all lower ones too). The machine works on the terms
whose share among the toxic texts learned from exceeds their share among the others by ``LEAST_Z`` standard errors.
A score is ``sigmoid(bias + sum w + sum over pairs of <v, v'>)``, so that two terms that say little alone
may be toxic together. Linear weights follow FTRL-proximal; factors follow AdaGrad with decay.

Defined results: null and empty texts have no terms and get the score of the bias; rows that repeat get equal
scores; without any usable label every score is 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import SIGNS, Tokens, buffers, chunks
from .quality import Ftrl, held_out, lower, sigmoid, training_rows

BITS = 17
LEVELS = 3
FACTORS = 4
TRAIN_ROWS = 8192
EPOCHS = 6
LEAST_Z = 4.0
#: A term must occur in so many of the learned texts.
LEAST_TEXTS = 3
PREFIXES = (4, 5, 6, 7)
_U = np.uint64


def terms(data: np.ndarray, offsets: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each text, sorted; with ``active`` only of those buckets."""
    tokens = Tokens(data, offsets, SIGNS)
    word = tokens.kind == 1
    hashes, rows = [tokens.hash[word]], [tokens.row[word]]
    for size in PREFIXES:
        which, h = tokens.prefix(size)
        which, h = which[word[which]], h[word[which]]
        hashes.append(h)
        rows.append(tokens.row[which])
    bucket = (np.concatenate(hashes) >> _U(64 - BITS)).astype(np.int64)
    row = np.concatenate(rows)
    if active is not None:
        keep = active[bucket]
        bucket, row = bucket[keep], row[keep]
    key, count = np.unique(row << BITS | bucket, return_counts=True)
    out = np.concatenate([np.stack([key >> BITS, (key & (1 << BITS) - 1) * LEVELS + level])[:, count > level] for level in range(LEVELS)], axis=1)
    order = np.lexsort((out[1], out[0]))
    return out[0][order], out[1][order]


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """``feature``, ``w`` and ``v`` of the chosen terms, and the ``bias``."""
    size, toxic = LEVELS << BITS, labels == 1
    seen = np.bincount(np.concatenate([*texts, np.zeros(0, np.int64)]), minlength=size)
    hits = np.bincount(np.concatenate([t for t, one in zip(texts, toxic, strict=True) if one] + [np.zeros(0, np.int64)]), minlength=size)
    ones, zeros = max(1, toxic.sum()), max(1, len(labels) - toxic.sum())
    share = seen / max(1, len(labels))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    feature = np.flatnonzero((seen >= LEAST_TEXTS) & (hits / ones - (seen - hits) / zeros >= LEAST_Z * error))
    number = np.full(size, -1)
    number[feature] = np.arange(len(feature))
    texts = [number[t][number[t] >= 0] for t in texts]
    model, b = Ftrl(len(feature), alpha=0.5, l1=0.1), np.log((ones + 0.5) / (zeros + 0.5)) if len(labels) else 0.0
    random = np.random.default_rng(8)
    v, power = random.normal(0, 0.01, (len(feature), FACTORS)), np.full((len(feature), FACTORS), 1.0)
    for _ in range(epochs):
        for at, label in zip(texts, labels, strict=True):
            w, own = model.weights(at), v[at]
            total = own.sum(0)
            error = sigmoid(b + w.sum() + 0.5 * float((total * total - (own * own).sum(0)).sum())) - label
            model.update(at, np.full(len(at), error), w)
            b -= 0.05 * error
            slope = error * (total - own) + 0.001 * own
            power[at] += slope * slope
            v[at] = own - 0.05 * slope / np.sqrt(power[at])
    return {"feature": feature, "w": model.weights(), "v": v, "bias": np.array([b])}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        data, offsets = buffers(lower(batch.column("text")))
        for a, b in chunks(offsets):
            row, feature = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            texts += np.split(feature, np.searchsorted(row, np.arange(1, b - a)))
    model = fit(texts, np.array(labels, float))
    yield pa.RecordBatch.from_pydict(
        {
            "feature": np.append(model["feature"], -1).astype(np.int32),
            "w": np.append(model["w"], model["bias"]),
            "v": pa.array([*model["v"].tolist(), [0.0] * FACTORS], pa.list_(pa.float64())),
        }
    )


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Train in one task on a bounded sample; at most ``3 * 2 ** BITS`` features come back to the driver."""
    rows = (
        training_rows(docs, labels, label, use, bound)
        .mapInArrow(_train, "feature int, w double, v array<double>")
        .orderBy("feature")
        .toArrow()
    )
    if not rows.num_rows:
        rows = pa.table({"feature": [-1], "w": [0.0], "v": [[0.0] * FACTORS]})
    v = np.array(rows.column("v").to_pylist(), np.float32).reshape(-1, FACTORS)
    feature, w = rows.column("feature").to_numpy(), rows.column("w").to_numpy()
    return {"feature": feature[1:], "w": w[1:].astype(np.float32), "v": v[1:], "bias": w[:1]}


def scorer(docs: DataFrame, model: dict[str, np.ndarray]):
    """A column function from text to the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        number = np.full(LEVELS << BITS, -1)
        number[m["feature"]] = np.arange(len(m["feature"]))
        active = (number.reshape(-1, LEVELS) >= 0).any(1)
        data, offsets = buffers(lower(texts))
        out = np.full(len(offsets) - 1, float(m["bias"][0]))
        for a, b in chunks(offsets):
            row, feature = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], active)
            at = number[feature]
            row, at = row[at >= 0], at[at >= 0]
            out[a:b] += np.bincount(row, m["w"][at], b - a)
            for f in range(FACTORS):
                v = m["v"][at, f].astype(float)
                out[a:b] += 0.5 * (np.bincount(row, v, b - a) ** 2 - np.bincount(row, v * v, b - a))
        return pa.array(sigmoid(out))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(docs, train(docs, labels, "toxic", ~held_out(4, 2)))
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
