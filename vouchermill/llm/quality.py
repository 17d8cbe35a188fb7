"""Quality classifier: logistic regression over hashed word n-grams, fitted
with follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text are the n-grams of its blank-separated words: single words
and pairs, and singles, pairs and triples of word shapes (capitals, small
letters, digits and other bytes, each run written once; a pair of equal words
differs from one of different words). A feature's value is
its share of the text's n-grams of that sort, so a score is the mean of the
weights that the text's n-grams have, whatever its length.

Defined cases: a null or blank text has no features and gets the bias alone;
rows with the same text get the same score; other columns are never read. With
no labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchermill.llm import batches, textbytes as tb
from vouchermill.llm.labelled import MOST_LABELLED, held_out, labelled_texts

BITS = 18
KINDS = 5
THRESHOLD = 0.3

_BLANK = np.ones(256, np.uint8)
_BLANK[[9, 10, 11, 12, 13, 32]] = 0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


@dataclass
class Ftrl:
    """Step size, its start, and the two penalties of the proximal update."""

    alpha: float = 2.0
    beta: float = 0.05
    l1: float = 0.0005
    l2: float = 0.001
    epochs: int = 4


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    shape = _SHAPE[data]
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    place = np.cumsum(fresh) - 1
    sums = np.zeros(len(shape) + 1, np.uint64)
    np.cumsum(np.where(fresh, shape.astype(np.uint64) + np.uint64(1), np.uint64(0)) * tb.powers(len(shape))[place], out=sums[1:])
    return tb.mix((sums[ends] - sums[starts]) * tb.inverse_powers(len(shape))[place[starts]])


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of every n-gram, for each of the KINDS sorts."""
    starts, ends, rows = tb.tokens(_BLANK[data], offsets)
    if not len(starts):
        return [(rows, rows)] * KINDS
    word, shape = tb.run_hashes(data, starts, ends), _shape_hashes(data, starts, ends)
    two, three = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    pairs = tb.pair(shape[:-1], shape[1:]) + (word[:-1] == word[1:])  # a word repeated is a pair of its own
    found = [
        (rows, word), (rows[1:][two], tb.pair(word[:-1], word[1:])[two]), (rows, shape),
        (rows[1:][two], pairs[two]), (rows[2:][three], tb.pair(pairs[:-1], shape[2:])[three]),
    ]
    mask = np.uint64((1 << BITS) - 1)
    return [(r, (h & mask).astype(np.int64) + (k << BITS)) for k, (r, h) in enumerate(found)]


def fit(texts: list[str], labels: list[int], settings: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and bias. Each text is one update of the weights it touches."""
    examples = []
    for first, end, data, offsets in tb.slices(pa.array(texts, pa.string())):
        rows, ids, values = [], [], []
        for r, f in features(data, offsets):
            n = np.bincount(r, minlength=end - first)
            key, count = np.unique(r << 32 | f, return_counts=True)
            rows.append(key >> 32), ids.append(key & 0xFFFFFFFF), values.append(count / n[key >> 32])
        rows, ids, values = np.concatenate(rows), np.concatenate(ids), np.concatenate(values)
        order = np.argsort(rows, kind="stable")
        ids, values = ids[order], values[order]
        cut = np.searchsorted(rows[order], np.arange(end - first + 1))
        examples += [(ids[a:b], values[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    z, n = np.zeros(KINDS << BITS), np.zeros(KINDS << BITS)
    rate = (sum(labels) + 1) / (len(labels) + 2)
    bias = float(np.log(rate / (1 - rate)))
    bias_n = 1.0

    def weights(i):
        return np.where(
            np.abs(z[i]) <= settings.l1, 0.0,
            -(z[i] - np.sign(z[i]) * settings.l1) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2),
        )

    for epoch in range(settings.epochs):
        for j in np.random.default_rng(epoch).permutation(len(examples)):
            i, x = examples[j]
            w = weights(i)
            error = 1 / (1 + np.exp(-np.clip(bias + w @ x, -30, 30))) - labels[j]
            g = error * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / settings.alpha
            z[i] += g - step * w
            n[i] += g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    return weights(np.arange(len(z))).astype(np.float32), float(bias)


def score_column(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(column), bias)
    for first, end, data, offsets in tb.slices(column):
        for r, f in features(data, offsets):
            n = end - first
            total = np.bincount(r, weights=weights[f], minlength=n)
            out[first:end] += total / np.maximum(np.bincount(r, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    batches.for_texts(spark)
    sample = labelled_texts(docs, labels, label, most)
    model = fit([t for t, _ in sample], [y for _, y in sample]) if sample else (np.zeros(KINDS << BITS, np.float32), 0.0)
    shared = spark.sparkContext.broadcast(model)  # KINDS * 2**BITS numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score_column(batch.column(2), weights, bias))],
                ["doc_id", "held_out", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    rows = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
