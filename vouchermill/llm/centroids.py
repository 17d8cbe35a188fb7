"""Centroid clustering in whole numbers with equal-average equal-variance search.

The nearest centroid of a vector x is found without looking at all of them. With
S the sum of the k components and V = sqrt(k * sum of squares - S^2), every
centroid c has k * d(x, c) >= (S_x - S_c)^2 + (V_x - V_c)^2, where d is the
squared distance. Centroids are sorted by S, that is by their mean; the search
starts at the vector's mean and goes outward, the nearer side first:

* if (S_x - S_c)^2 alone exceeds k times the best distance, so does everything
  further out on both sides, and the vector is done;
* if the sum with the deviations exceeds it, this centroid is passed over;
* otherwise the distance is computed exactly.

Sums, squares and distances are integers. The deviation alone is a double; it
rejects only if it does so with a margin far above its rounding error, so ties
are always decided by exact distances (the smaller number wins).

A round is one pass over the vectors: tasks search whole Arrow batches with
numpy and pass on a count and component sums per centroid, which Spark adds up.
The driver holds the centroids and their sums, k * number of centroids numbers,
and no vector. The last assignment is written to the shared folder, so the
inertias do not cost a second search.

Defined cases: vectors with another number of components, a null component, or
one that is not finite are left out; a null vec_id is written as the empty
string where it is hashed and stays null in the result; equal rows are separate
vectors and get equal results, and if such rows become centroids the smaller
number takes them all; with fewer vectors than centroids there are fewer
centroids; an empty table gives an empty result; only vec_id and embedding are
read, so other columns may have any name. Distances are longs, therefore
components must stay below 2^27 once they are whole numbers (2 million before);
larger ones stop the job with a message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchermill.session import shared_folder

COMPONENTS, SCALE = 64, 64
CENTROIDS, ROUNDS = 16, 3
MOST = 1 << 27
#: relative rounding error that the deviation test allows for (doubles have 2^-53)
MARGIN = 1e-9
#: vectors searched at once
ROWS = 4096


def whole_vectors(column: pa.Array, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector counts, and their whole-number components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, components), np.int64)
    ends = column.offsets.to_numpy().astype(np.int64)
    rows = np.flatnonzero((np.diff(ends) == components) & column.is_valid().to_numpy(zero_copy_only=False))
    at = (ends[rows] - ends[0])[:, None] + np.arange(components)
    values = column.values.slice(int(ends[0]), int(ends[-1] - ends[0])).cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # a null component becomes NaN
    matrix = flat[at] if len(rows) else np.zeros((0, components))
    finite = np.isfinite(matrix).all(1)
    rows, matrix = rows[finite], np.floor(matrix[finite] * SCALE)
    if len(matrix) and np.abs(matrix).max() >= MOST:
        raise ValueError(f"a vector has a component of {MOST / SCALE:.0f} or more: its squared distances do not fit a long")
    return rows, matrix.astype(np.int64)


@dataclass
class Centroids:
    """Centroids with what the search needs of them, sorted by mean."""

    values: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.values.sum(1), kind="stable")
        self.sorted = self.values[self.order]
        self.sums, self.deviations = averages(self.sorted)

    def __len__(self) -> int:
        return len(self.values)


def averages(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the components of each vector, and its deviation times the square root of their number."""
    sums, k = vectors.sum(1), vectors.shape[1]
    # taken about the mean, so that nothing cancels: the relative error is that of a few roundings
    return sums, np.sqrt(k * ((vectors - (sums / k)[:, None]) ** 2).sum(1))


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, and how many distances were computed."""
    n, k, many = len(vectors), vectors.shape[1], len(centroids)
    sums, deviations = averages(vectors)
    right = np.searchsorted(centroids.sums, sums)
    left = right - 1
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, many)
    exact = 0
    active = np.arange(n)
    for _ in range(many):
        if not len(active):
            break
        l, r, s = left[active], right[active], sums[active]
        # the side whose mean is nearer; a side that is used up is infinitely far
        far = np.iinfo(np.int64).max
        to_left = np.where(l >= 0, np.abs(s - centroids.sums[np.maximum(l, 0)]), far)
        to_right = np.where(r < many, np.abs(s - centroids.sums[np.minimum(r, many - 1)]), far)
        go_left = to_left <= to_right
        c = np.where(go_left, l, r)
        left[active] -= go_left
        right[active] += ~go_left
        gap = np.minimum(to_left, to_right).astype(np.float64) ** 2
        room = best[active].astype(np.float64) * k  # k * best distance
        # doubles again: an equality in whole numbers must not reject, so the bound is widened by the margin
        within = gap <= room * (1 + MARGIN)
        active, c, gap, room = active[within], c[within], gap[within], room[within]
        step = np.abs(deviations[active] - centroids.deviations[c])
        slack = MARGIN * (deviations[active] + centroids.deviations[c] + np.abs(sums[active]) + 1)
        hit = gap + np.maximum(step - slack, 0) ** 2 <= room * (1 + MARGIN)
        rows, c = active[hit], c[hit]
        exact += len(rows)
        distance = ((vectors[rows] - centroids.sorted[c]) ** 2).sum(1)
        name = centroids.order[c]
        closer = (distance < best[rows]) | ((distance == best[rows]) & (name < number[rows]))
        best[rows[closer]], number[rows[closer]] = distance[closer], name[closer]
    return number, best, exact


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of `seed:vec_id`; equal digests in the order of their components."""

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[int]]] = []
        for batch in stream:
            rows, matrix = whole_vectors(batch.column(1))
            names = batch.column(0).take(pa.array(rows)).to_pylist()
            digests = [hashlib.sha256(f"{seed}:{'' if v is None else v}".encode()).hexdigest() for v in names]
            held += [(d, matrix[i].tolist()) for d, i in zip(digests, range(len(digests)))]
            held = sorted(held)[:count]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.list_(pa.int64()))], ["digest", "vector"])

    rows = vectors.mapInArrow(hashed, "digest string, vector array<bigint>").orderBy("digest", "vector").limit(count).collect()
    return np.array([r.vector for r in rows], np.int64).reshape(-1, COMPONENTS)


def next_centroids(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Assign all vectors and move every centroid that has some to the floor of their mean."""

    def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), COMPONENTS), np.int64)
        for batch in stream:
            _, matrix = whole_vectors(batch.column(1))
            for a in range(0, len(matrix), ROWS):
                part = matrix[a : a + ROWS]
                number, _, _ = nearest(part, centroids)
                count += np.bincount(number, minlength=len(centroids))
                order = np.argsort(number, kind="stable")
                own, at = np.unique(number[order], return_index=True)
                total[own] += np.add.reduceat(part[order], at)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(count[own]), *(pa.array(total[own, i]) for i in range(COMPONENTS))],
            ["cluster", "n", *(f"s{i}" for i in range(COMPONENTS))],
        )

    sums = [f"s{i}" for i in range(COMPONENTS)]
    parts = vectors.mapInArrow(summed, ", ".join(["cluster int", "n bigint", *(f"{s} bigint" for s in sums)]))
    values = centroids.values.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():  # a row per centroid
        values[row.cluster] = [row[s] // row.n for s in sums]
    return Centroids(values)


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster and squared distance of every vector that counts."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def placed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, matrix = whole_vectors(batch.column(1))
            for a in range(0, len(rows), ROWS):
                number, distance, _ = nearest(matrix[a : a + ROWS], centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[a : a + ROWS])), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    return vectors.mapInArrow(placed, f"vec_id {kind}, cluster int, distance bigint")


def cluster(embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, Centroids]:
    """The assignment of every vector after the last round, stored, and the centroids."""
    spark = embeddings.sparkSession
    vectors = embeddings.select("vec_id", "embedding")
    centroids = Centroids(first_centroids(vectors, count, seed))
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(vectors, centroids)
    folder = shared_folder(spark, "clusters")
    assign(vectors, centroids).write.parquet(folder)
    return spark.read.parquet(folder), centroids


def report(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and a digest of its centroid."""
    spark = assigned.sparkSession
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per centroid
    total = sum(inertia.values())
    rows = [
        (i, inertia[i], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.values.tolist()) if i in inertia
    ]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
