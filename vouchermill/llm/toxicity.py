"""Toxicity: a bidirectional gated recurrent network with attention pooling over
word and character inputs, trained in numpy, scoring all overlapping windows.

A text's words (of `words.words`) are cut into windows of WINDOW words that
start every STRIDE words, so that each place is in a window with context on
both sides. A word enters as its own vector, if the training sample has it in
enough texts, next to the mean vector of its pairs of bytes. A window's score
is a logistic function of the attention-weighted mean of the states of both
directions; a text's score is that of its highest window, and training raises
or lowers that window (a text is toxic as soon as one passage is).

Defined cases: a null or wordless text has one window without words, which
gets the bias alone; rows with the same text get the same score; other columns
are never read. With no labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vouchermill.llm import batches, textbytes as tb
from vouchermill.llm.labelled import MOST_LABELLED, held_out, labelled_texts
from vouchermill.llm.words import free_name

WINDOW, STRIDE = 40, 20
WORD_DIM, CHAR_DIM, HIDDEN = 8, 4, 8
CHAR_BITS = 12
#: words with a vector of their own: in at least so many training texts, at most so many
LEAST_TEXTS, MOST_WORDS = 4, 30_000
#: windows run through the network at once, and words whose bytes are looked up at once
BATCH, WORDS = 4096, 1 << 17
THRESHOLD = 0.5
#: share of words that enter as unknown ones while training
MASKED = 0.1


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def read_words(data: np.ndarray, offsets: np.ndarray):
    """Hash and row of every word, the byte pairs of all words and where each word's begin."""
    kinds = tb.WORD_BYTES[data]
    starts, ends, rows = tb.tokens(kinds, offsets)
    hashes = tb.run_hashes(kinds, starts, ends)
    left = np.empty_like(kinds)
    left[:1], left[1:] = 0, kinds[:-1]
    left[starts] = 0
    inside = np.flatnonzero(kinds)
    pairs = (left[inside].astype(np.int32) * 37 + kinds[inside]) & ((1 << CHAR_BITS) - 1)
    lengths = ends - starts
    return hashes, rows, pairs, np.cumsum(lengths) - lengths, lengths


def windows(rows: np.ndarray, n_rows: int):
    """Row, first word and number of words of every window; a row without words has one of none."""
    counts = np.bincount(rows, minlength=n_rows)
    many = 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0)
    row = np.repeat(np.arange(n_rows), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = (np.cumsum(counts) - counts)[row] + nth * STRIDE
    return row, first, np.minimum(counts[row] - nth * STRIDE, WINDOW)


class Network:
    """Parameters by name, so that training can walk over them."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, rate: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # sorted hashes; row 0 of `word` is for all others
        draw = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.02), "char": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.05)}
        self.p["word"][1:, 0] += odds  # start from each word's log odds in the sample
        for d in "fb":
            self.p[f"{d}_in"] = draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN)
            self.p[f"{d}_own"] = draw(HIDDEN, 3 * HIDDEN)
            self.p[f"{d}_bias"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.full(1, np.log(rate / (1 - rate)), np.float32)}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, ids, pairs, begin, lengths) -> np.ndarray:
        """[words + 1, dims]; the last row, all zero, fills windows up."""
        x = np.zeros((len(ids) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = self.p["word"][ids]
        for a in range(0, len(ids), WORDS):
            at, n = begin[a : a + WORDS], lengths[a : a + WORDS]
            own = self.p["char"][pairs[at[0] : at[-1] + n[-1]]]
            x[a : a + len(n), WORD_DIM:] = np.add.reduceat(own, at - at[0], axis=0) / n[:, None]
        return x

    def run(self, x, place, size, keep=False):
        """Logit of each window; place[w, t] is the row of x of its t-th word."""
        n, steps = place.shape
        live = np.arange(steps)[None, :] < size[:, None]
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        saved = {}
        for d, name in enumerate("fb"):
            gates = x @ self.p[f"{name}_in"] + self.p[f"{name}_bias"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, own = gates[place[:, t]], h @ self.p[f"{name}_own"]
                rz = _sigmoid(g[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
                before, h = h, np.where(live[:, t, None], new + z * (h - new), h)
                states[d, t] = h
                if keep:
                    saved[d, t] = (before, r, z, new, own[:, 2 * HIDDEN :])
        both = np.concatenate([states[0], states[1]], axis=2)  # steps, n, 2H
        e = np.where(live.T, both @ self.p["attend"], np.float32(-1e9))
        a = np.exp(e - e.max(0)) * live.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, both)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (both, a, pooled, saved, live)) if keep else logit

    def logits(self, x, first, size) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        order = np.argsort(size, kind="stable")  # windows of like length together
        for i in range(0, len(first), BATCH):
            w = order[i : i + BATCH]
            steps = max(1, int(size[w].max()))
            span = np.arange(steps)[None, :]
            place = np.where(span < size[w, None], first[w, None] + span, len(x) - 1)
            out[w] = self.run(x, place, size[w])
        return out

    def gradients(self, ids, pairs, begin, lengths, first, size, error):
        """Of sum(error * logit) for windows given by their words."""
        x = self.inputs(ids, pairs, begin, lengths)
        steps = max(1, int(size.max()))
        span = np.arange(steps)[None, :]
        place = np.where(span < size[:, None], first[:, None] + span, len(x) - 1)
        logit, (both, a, pooled, saved, live) = self.run(x, place, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        err = error(logit).astype(np.float32)
        g["bias"][0], g["out"] = err.sum(), pooled.T @ err
        d_pooled = err[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, both)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", d_e, both)
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for d, name in enumerate("fb"):
            w_in, own_w = self.p[f"{name}_in"], self.p[f"{name}_own"]
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(first), HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
                before, r, z, new, own_n = saved[d, t]
                total = d_h + d_both[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                here = live[:, t, None]
                d_new = np.where(here, total * (1 - z), 0)
                d_z = np.where(here, total * (before - new), 0) * z * (1 - z)
                d_pre = d_new * (1 - new * new)
                d_r = d_pre * own_n * r * (1 - r)
                d_own = np.concatenate([d_r, d_z, d_pre * r], 1)
                d_h = np.where(here, total * z, total) + d_own @ own_w.T
                g[f"{name}_own"] += before.T @ d_own
                np.add.at(d_gates, place[:, t], np.concatenate([d_r, d_z, d_pre], 1))
            d_gates[-1] = 0
            g[f"{name}_in"], g[f"{name}_bias"] = x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ w_in.T
        np.add.at(g["word"], ids, d_x[:-1, :WORD_DIM])
        if len(ids):
            share = d_x[:-1, WORD_DIM:] / lengths[:, None]
            np.add.at(g["char"], pairs, np.repeat(share, lengths, axis=0))
        return g


def _training_words(texts: list[str]):
    """The words of all texts as one sequence, and each text's windows."""
    parts, at_word, at_pair, at_row = [], 0, 0, 0
    for first, end, data, offsets in tb.slices(pa.array(texts, pa.string())):
        hashes, rows, pairs, begin, lengths = read_words(data, offsets)
        row, start, size = windows(rows, end - first)
        parts.append((hashes, rows + at_row, pairs, begin + at_pair, lengths, row + at_row, start + at_word, size))
        at_word, at_pair, at_row = at_word + len(hashes), at_pair + len(pairs), at_row + end - first
    return [np.concatenate(x) for x in zip(*parts)]


def _logits_in_parts(net: Network, ids, pairs, begin, lengths, first, size) -> np.ndarray:
    """Logits of all windows; only the words of BATCH windows are held as vectors at once."""
    out = np.empty(len(first), np.float32)
    for a in range(0, len(first), BATCH):
        f, s = first[a : a + BATCH], size[a : a + BATCH]
        lo, hi = int(f.min()), int((f + s).max())
        p = (begin[lo], begin[hi - 1] + lengths[hi - 1]) if hi > lo else (0, 0)
        x = net.inputs(ids[lo:hi], pairs[p[0] : p[1]], begin[lo:hi] - p[0], lengths[lo:hi])
        out[a : a + BATCH] = net.logits(x, f - lo, s)
    return out


def fit(texts: list[str], labels: list[int], epochs: int = 5, batch: int = 64, step: float = 0.02) -> Network:
    """Adam over the highest window of each text. A positive text weighs more where positives are rare."""
    y = np.array(labels, np.float32)
    hashes, rows, pairs, begin, lengths, w_row, w_first, w_size = _training_words(texts)
    order = np.lexsort((rows, hashes))
    h, r = hashes[order], rows[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[: len(h)]  # a word's texts once each
    h, r = h[fresh], r[fresh]
    words, back = np.unique(h, return_inverse=True)
    in_texts = np.bincount(back, minlength=len(words))
    positive = np.bincount(back, weights=y[r], minlength=len(words))
    chosen = np.flatnonzero(in_texts >= min(LEAST_TEXTS, max(2, len(texts) // 50)))
    chosen = np.sort(chosen[np.argsort(-in_texts[chosen], kind="stable")[:MOST_WORDS]])
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    odds = np.log((positive[chosen] + 0.5) / (n_pos + 1)) - np.log((in_texts[chosen] - positive[chosen] + 0.5) / (n_neg + 1))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - 1.5, 0) * np.minimum(in_texts[chosen] / 10, 1)
    net = Network(words[chosen], (odds / 2).astype(np.float32), float((n_pos + 1) / (len(y) + 2)))
    ids = net.lookup(hashes)
    weight = np.where(y > 0, min(4.0, max(1.0, n_neg / max(n_pos, 1))), 1.0).astype(np.float32)
    bounds = np.searchsorted(w_row, np.arange(len(texts) + 1))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turn = 0
    for epoch in range(epochs):
        logit = _logits_in_parts(net, ids, pairs, begin, lengths, w_first, w_size)
        top = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(bounds[:-1], bounds[1:])])
        rng = np.random.default_rng(epoch)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            w = top[docs]
            size = w_size[w]
            word = np.repeat(w_first[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            n = lengths[word]
            pair_at = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            error = lambda z: weight[docs] * (_sigmoid(z) - y[docs])  # noqa: B023, E731
            seen = np.where(rng.random(len(word)) < MASKED, 0, ids[word])
            g = net.gradients(seen, pairs[pair_at], np.cumsum(n) - n, n, np.cumsum(size) - size, size, error)
            turn += 1
            for k, v in net.p.items():
                m, s = moment[k]
                d = g[k] / len(docs) + (2e-5 * v if k != "bias" else 0)
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                pace = step * (0.3 if k in ("word", "char") else 1)
                v -= pace * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-6)
    return net


def score_column(column: pa.Array, net: Network) -> np.ndarray:
    out = np.zeros(len(column))
    for first, end, data, offsets in tb.slices(column, tb.SLICE // 2):
        hashes, rows, pairs, begin, lengths = read_words(data, offsets)
        row, start, size = windows(rows, end - first)
        logit = net.logits(net.inputs(net.lookup(hashes), pairs, begin, lengths), start, size)
        best = np.maximum.reduceat(logit, np.searchsorted(row, np.arange(end - first)))
        out[first:end] = 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -30, 30)))
    return out


def with_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, name: str = "toxic_score"
) -> DataFrame:
    """The documents, all their columns, and the score; a column of that name is replaced."""
    docs = docs.drop(name)
    batches.for_texts(docs.sparkSession)
    sample = labelled_texts(docs, labels, label, most)
    net = fit([t for t, _ in sample], [y for _, y in sample]) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(net)  # at most MOST_WORDS word vectors
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_column(batch.column(at), shared.value) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(batches.tidy(scored), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = with_scores(docs.select("doc_id", "text"), labels, label, most)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    name = free_name(docs, "toxic_score")
    rows = with_scores(docs, labels, label, most, name)
    return rows.where(F.col(name) < THRESHOLD).select(*docs.columns)
