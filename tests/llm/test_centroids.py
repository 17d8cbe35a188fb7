import hashlib
import math
import random

import numpy as np
import pytest

from vouchermill.llm import centroids as clusters


def plain(rows):
    """All distances in Python integers: {(vec_id, vector): row of the report}."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in ordered[:16]]
    for turn in range(4):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]
        for k in range(len(centres) if turn < 3 else 0):
            own = [v for (_, v), (_, j) in zip(kept, found) if j == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in found)
    out = []
    for (i, _), (d, k) in zip(kept, found):
        inertia = sum(x for x, j in found if j == k)
        out.append((i, k, d, inertia, total, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()))
    return sorted(out, key=str)


def report(df):
    return sorted((tuple(r) for r in clusters.report(*clusters.cluster(df)).collect()), key=str)


SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance double"


def test_equals_plain_form_with_edges(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([-1, 0, 1, 0.5]) * rng.random() for _ in range(64)] for _ in range(90)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7])] * 5 + [(7, vectors[8]), (None, vectors[9]), (None, vectors[9])]
    bad = [None, [], vectors[0][:63], vectors[0] + [1.0], [None] + vectors[0][1:], [math.nan] + vectors[0][1:], [math.inf] + vectors[0][1:], [-math.inf] + vectors[0][1:]]
    df = spark.createDataFrame([(*r, "c", 0.5) for r in rows + [(1000 + i, v) for i, v in enumerate(bad)]], SCHEMA)
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert report(df) == plain(exact)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64, "c", 0.0) for i in range(n)]
    got = report(spark.createDataFrame(rows, SCHEMA))
    assert got == plain([r[:2] for r in rows]) if n else got == []


def test_double_vectors_and_limits(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, [-0.1] * 64)], "vec_id int, embedding array<double>")
    assert report(df) == plain([(1, [0.1] * 64), (2, [-0.1] * 64)])
    with pytest.raises(Exception, match="do not fit a long"):
        report(spark.createDataFrame([(1, [3e6] * 64)], "vec_id int, embedding array<double>"))


@pytest.mark.parametrize("size", [3, 100, (1 << 27) - 1])
@pytest.mark.parametrize("count", [1, 2, 16, 40])
def test_search_is_exact(size, count):
    rng = np.random.default_rng(size + count)
    centres = rng.integers(-size, size, (count, 64))
    centres[count // 2 :] = centres[: count - count // 2]  # ties between numbers
    vectors = rng.integers(-size, size, (300, 64))
    vectors[:100] = centres[rng.integers(0, count, 100)]
    vectors[100:150] = size - 1 - rng.integers(0, 2, (50, 64))  # nearly constant: hardly any deviation
    found, distance, exact = clusters.nearest(vectors, clusters.Centroids(centres))
    want = ((vectors.astype(object)[:, None] - centres[None]) ** 2).sum(2)
    assert (found == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert exact <= vectors.shape[0] * count


def test_search_skips_centroids():
    """Vectors with spread means: most centroids are rejected without a distance."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-5, 5, (64, 64)) + np.arange(64)[:, None] * 10
    vectors = centres[rng.integers(0, 64, 1000)] + rng.integers(-3, 3, (1000, 64))
    _, _, exact = clusters.nearest(vectors, clusters.Centroids(centres))
    assert exact < 1000 * 64 / 8
