import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vouchermill.llm import quality, toxicity
from vouchermill.llm.labelled import labelled_texts

from .conftest import prose

BAD = ["vile", "scorn", "brute"]


@pytest.fixture(scope="module")
def marked():
    """(id, text, quality, toxic): junk is in capitals or repeated, toxic texts hold some of BAD."""
    rng, rows = random.Random(9), []
    for i in range(500):
        w = prose(1000 + i, rng.randint(20, 150)).split()
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), good, toxic))
    return rows


def held(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]


def test_quality_on_held_out_rows(spark, marked):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in marked], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in marked], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    tests = held(marked)
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in tests}
    assert np.mean([got[i].predicted == q for i, _, q, _ in tests]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_on_held_out_rows(spark, marked):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in marked], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in marked], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    tests = held(marked)
    assert np.mean([got[i].predicted == x for i, _, _, x in tests]) > 0.93
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 350 < kept.count() < 430


def test_labels_of_the_test_fold_are_never_read(spark, marked):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in marked], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in marked], "doc_id bigint, quality int, toxic int")
    texts = {t for t, _ in labelled_texts(docs, labels, "quality", 10**6)}
    assert texts == {r[1] for r in marked} - {r[1] for r in held(marked)}
    assert len(labelled_texts(docs, labels, "quality", 10)) == 10


def test_edge_rows(spark, edge_docs, no_docs, labels):
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        rows = module.score(edge_docs, labels, label).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
        same = {}
        texts = {r.doc_id: r.text for r in edge_docs.where("doc_id in (5, 6)").collect()}
        for r in rows:
            if r.doc_id in texts:
                same.setdefault(texts[r.doc_id], set()).add(r.score)
        assert all(len(s) == 1 for s in same.values())
        assert module.score(no_docs, labels, label).count() == 0
        none = labels.where("false")
        assert len({r.score for r in module.score(edge_docs, none, label).collect()}) == 1
    assert toxicity.drop_toxic(edge_docs.withColumnRenamed("lang", "toxic_score"), labels).columns[2] == "toxic_score"


def test_windows_overlap_and_cover():
    rows = np.repeat([0, 2, 3], [1, 100, 40])
    row, first, size = toxicity.windows(rows, 5)
    assert np.bincount(row, minlength=5).tolist() == [1, 1, 4, 1, 1] and size[row == 1].tolist() == [0]
    covered = sorted(set(np.concatenate([np.arange(f, f + s) for f, s in zip(first, size)]).tolist()))
    assert covered == list(range(141))
    assert (first[row == 2][1:] < (first + size)[row == 2][:-1]).all()


def test_gradients_of_the_network():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(1, 6, dtype=np.uint64), np.zeros(5, np.float32), 0.3)
    net.p = {k: rng.normal(0, 0.4, v.shape) for k, v in net.p.items()}
    ids, lengths = np.array([0, 1, 2, 3, 4, 5, 1]), np.array([2, 1, 3, 1, 1, 2, 2])
    pairs = rng.integers(0, 1 << toxicity.CHAR_BITS, lengths.sum())
    begin, first, size = np.cumsum(lengths) - lengths, np.array([0, 3]), np.array([3, 4])

    def loss():
        x = net.inputs(ids, pairs, begin, lengths).astype(np.float64)
        place = np.where(np.arange(4) < size[:, None], first[:, None] + np.arange(4), len(x) - 1)
        return float(net.run(x, place, size) @ np.array([1.0, -2.0]))

    g = net.gradients(ids, pairs, begin, lengths, first, size, lambda z: np.array([1.0, -2.0]))
    for name, value in net.p.items():
        flat = value.reshape(-1)
        picks = {"word": ids[1] * toxicity.WORD_DIM + 2, "char": pairs[0] * toxicity.CHAR_DIM}.get(name, len(flat) // 2)
        keep, step = flat[picks], 1e-2
        flat[picks] = keep + step
        up = loss()
        flat[picks] = keep - step
        down = loss()
        flat[picks] = keep
        assert g[name].reshape(-1)[picks] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name


def test_scores_do_not_depend_on_slices(marked):
    texts = [t for _, t, _, _ in marked[:60]]
    w, b = quality.fit(texts, [q for _, _, q, _ in marked[:60]])
    whole = quality.score_column(pa.array(texts), w, b)
    single = np.concatenate([quality.score_column(pa.array([t]), w, b) for t in texts])
    assert np.allclose(whole, single)
