"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the 1- and 2-grams of words (A-Z lower-cased) and of word shapes (letter case, digits,
the symbols a word holds, and whether it repeats the word before it), hashed to a fixed number of
weights. A feature's value is its share of the text's n-grams, so a text of any length is scored by
the mean weight of its n-grams: a sparse dot product.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .labelled import bounded_sample, remainder
from .tables import documents

BITS = 18
#: Labelled texts that training reads, by hash of their ids and texts.
MAX_TRAIN_ROWS = 20_000
EPOCHS = 3
_SCALES = (8.0, 16.0)  # of word and of shape n-grams
_ALPHA, _BETA, _L1, _L2 = 0.3, 1.0, 1e-4, 1e-4
_U = np.uint64

_CLASSES = ((re.compile(r"[a-z -\U0010ffff]+"), "x"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"[0-9]+"), "9"))
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """``Then,`` is ``Xx,`` and ``of$$$`` is ``x$+``."""
    for pattern, mark in _CLASSES:
        word = pattern.sub(mark, word)
    return _RUN.sub(r"\1+", word)


def _slots(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and row offsets of the word n-grams and of the shape n-grams."""
    words = tx.tokenise(column)
    names = words.words.to_pylist()
    by_shape: dict[str, int] = {}
    shapes = np.fromiter((by_shape.setdefault(shape(w), len(by_shape)) for w in names), np.int64, len(names))
    shape_hash = tx.hashes(pa.array(list(by_shape), pa.string()), 12)
    row, codes, offsets = tx.row_of(words.offsets), words.codes, words.offsets
    repeat = np.zeros(len(codes), _U)
    if len(codes) > 1:
        repeat[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    lowered = tx.hashes(pa.compute.ascii_lower(words.words), 11)[codes]
    shaped = shape_hash[shapes[codes]] + repeat * _U(0x9E3779B97F4A7C15) if len(codes) else np.zeros(0, _U)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(codes) else np.zeros(0, np.int64)
    pair_offsets = np.searchsorted(pair, offsets)
    pair_offsets[1:] = np.searchsorted(pair, np.maximum(offsets[1:] - 1, 0))
    pair_offsets = np.maximum.accumulate(pair_offsets)
    out = []
    for h in (lowered, shaped):
        two = tx.mix(h[pair] * _U(3) + tx.mix(h[pair + 1])) if len(pair) else np.zeros(0, _U)
        one = tx.mix(h)
        both = np.concatenate((one, two))
        order = np.argsort(np.concatenate((row, row[pair])) if len(pair) else row, kind="stable")
        out.append(((both >> _U(64 - BITS)).astype(np.int64)[order], offsets + pair_offsets))
    return out


def _vectors(batches):
    for batch in tx.chunks(batches):
        column = tx.texts(batch)
        parts = _slots(column)
        indices, values = [], []
        for i in range(len(column)):
            at, of = [], []
            for (slots, offsets), scale in zip(parts, _SCALES, strict=True):
                found, count = np.unique(slots[offsets[i] : offsets[i + 1]], return_counts=True)
                at.append(found)
                of.append(count * (scale / max(1, count.sum())))
            indices.append(np.concatenate(at).astype(np.int32))
            values.append(np.concatenate(of).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([x.tobytes() for x in indices], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())],
            names=["doc_id", "y", "at", "x"],
        )


def follow_the_leader(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal steps over (y, slots, values) in the order given; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= _L1, 0.0, -(zi - np.sign(zi) * _L1) / ((_BETA + np.sqrt(n[at])) / _ALPHA + _L2))

    for _ in range(epochs):
        for y, at, x in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / _ALPHA * w
            n[at] = ni + g * g
    return weights(slice(None)).astype(np.float32)


def _fit(batches):
    frames = [b.to_pandas() for b in batches]
    rows = pd.concat(frames).sort_values(["order", "doc_id", "at", "x"], kind="stable") if frames else pd.DataFrame()
    examples = []
    for y, at, x in zip(rows.get("y", []), rows.get("at", []), rows.get("x", []), strict=True):
        slots, values = np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)
        # a slot that both families use would be stepped once only: add its values up
        slots, back = np.unique(slots, return_inverse=True)
        examples.append((y, np.append(slots, 1 << BITS), np.append(np.bincount(back, values, len(slots)) if len(slots) else [], 1.0)))
    yield pa.RecordBatch.from_arrays([pa.array([follow_the_leader(examples).tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, most: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """2**BITS weights and a bias, learnt in one task from a bounded sample of labelled rows."""
    vectors = bounded_sample(docs, labels, label, folds, most).mapInArrow(_vectors, "doc_id long, y int, at binary, x binary")
    ordered = vectors.withColumn("order", F.xxhash64("doc_id", F.lit(7))).repartition(1)  # the scan stays parallel; the sample is bounded
    found = ordered.mapInArrow(_fit, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _scorer(model):
    def score(batches):
        weights = model.value
        for batch in tx.chunks(batches):
            column = tx.texts(batch)
            total = np.full(len(column), float(weights[-1]))
            for (slots, offsets), scale in zip(_slots(column), _SCALES, strict=True):
                total += tx.sums(weights[slots].astype(np.float64), offsets) * (scale / np.maximum(1, np.diff(offsets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return score


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row. Null and empty texts get the bias's score; repeated rows are scored alike."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats: 1 MB
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels outside remainder 0 of 5.

    Rows are scored one by one, repeats and equal ids included; null and empty texts have the intercept alone. A null id
    counts as empty text in the remainder. Without rows there are no scores.
    """
    docs = documents(spark, sf_dir)
    weights = train(docs, documents(spark, sf_dir, "labels"))
    return score(docs, weights).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
