"""Jaccard join of texts on word n-grams, with Bayesian pruning of candidates.

1. Every text becomes the set of its runs of SHINGLE words; texts with the same
   set are one class, so copies are never compared or paired.
2. Classes that share a band of their MinHash values meet in a bucket. Each
   pair is compared in the first band that it shares, some hashes at a time,
   and is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls below TOLERANCE. A bucket passes on a spanning
   forest of its surviving pairs, not the pairs.
3. The forests join into groups. In each group all pairs of sets are verified
   exactly by counting shared n-grams; the results are the links of each class
   and the components of the verified links.

Large buckets and groups are cut into blocks, and each pair of blocks is work
for a task of its own. A pair with the threshold similarity shares no band with
probability (1 - t**ROWS)**BANDS (5e-8 for 0.8), and is pruned with about
9e-6 (TOLERANCE at each of the looks).

Defined cases: null texts are empty; a text of 1 to SHINGLE-1 words has one
n-gram, all its words; wordless texts are alike only if equal; rows that repeat
get a row each; a class of null ids only has a null class_id; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vouchermill.llm import batches, textbytes as tb
from vouchermill.llm.components import components
from vouchermill.llm.words import free_name
from vouchermill.session import shared_folder

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: hashes compared before each decision, and the probability below which a pair goes
STEP, TOLERANCE = 16, 1e-6
#: rows of a bucket or group that one task compares with as many others
BLOCK = 512
#: pairs, and columns of the incidence matrix, worked on at once
PAIRS, COLUMNS = 1 << 15, 2048


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, in ascending order of both."""
    words, rows = tb.word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    counts = np.bincount(rows, minlength=n_rows)
    run = words.copy()
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = (np.cumsum(counts) - counts)[short]
    own = words[first] if len(short) else words[:0]
    for k in range(1, size):
        run[:-k] = tb.pair(run[:-k], words[k:]) if len(words) > k else run[:-k]
        more = counts[short] > k
        own[more] = tb.pair(own[more], words[first[more] + k])
    whole = np.zeros(len(words), bool)
    if len(words) >= size:
        whole[: len(words) - size + 1] = rows[size - 1 :] == rows[: len(words) - size + 1]
    r, h = np.concatenate([rows[whole], short]), np.concatenate([run[whole], own])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[fresh], h[fresh]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tb.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n] | np.uint64(1), seeds[n:]


def sketch(data: np.ndarray, offsets: np.ndarray, size: int, bands: int, rows_per_band: int):
    """For each text: class key (16 bytes), number of n-grams, 32-bit hash of each
    band, and one byte of each MinHash value."""
    row, h = shingles(data, offsets, size)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    has = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[has]
    keys = np.zeros((n, 2), np.uint64)
    sig = np.zeros((n, bands * rows_per_band), np.uint32)
    if len(has):
        keys[has, 0] = np.add.reduceat(tb.mix(h), begin)
        keys[has, 1] = np.add.reduceat(tb.mix(h + np.uint64(0x632BE59BD9B4E019)), begin) + counts[has].astype(np.uint64)
        for j, (a, b) in enumerate(zip(*_permutations(bands * rows_per_band))):
            sig[has, j] = np.minimum.reduceat((h * a + b) >> np.uint64(32), begin)
    names = [keys[i].tobytes() if counts[i] else hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest() for i in range(n)]
    band = np.zeros((n, bands), np.uint32)
    for b in range(bands):
        acc = np.full(n, b, np.uint64)
        for j in range(rows_per_band):
            acc = tb.pair(acc, sig[:, b * rows_per_band + j].astype(np.uint64))
        band[:, b] = acc >> np.uint64(32)
    return names, counts, band.view(np.int32), (sig & np.uint32(255)).astype(np.uint8)


def least_agreeing(threshold: float, hashes: int, tolerance: float) -> dict[int, int]:
    """For n compared values, the least number of agreeing ones with which the
    posterior probability of reaching the threshold is at least the tolerance.

    The prior is uniform, so after m of n agree the similarity has a Beta(m + 1,
    n - m + 1) distribution. One byte also agrees by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    found = {}
    for n in range(STEP, hashes + 1, STEP):
        below = [comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 2)]
        # P(similarity >= t) = P(Binomial(n + 1, t) <= m)
        found[n] = next(m for m in range(n + 1) if sum(below[: m + 1]) >= tolerance)
    return found


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs connect the least label among them, in place."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows with equal `keys`, which follow one another),
    and where each group starts. The last group of a batch waits for the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cuts = _starts(held, keys)
        if len(cuts) > 1:
            yield held.slice(0, cuts[-1]), cuts[:-1]
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        column = table[k].combine_chunks()
        if pa.types.is_binary(column.type):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def _pairs(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the groups, about PAIRS at a time."""
    ends = np.append(starts[1:], n)
    partners = np.repeat(ends, ends - starts) - np.arange(n) - 1
    total = np.cumsum(partners)
    i = 0
    while i < n:
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        count = partners[i:j]
        a = np.repeat(np.arange(i, j), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        if len(a):
            yield a, b
        i = j


def _in_blocks(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows with the pairs of blocks (x <= y) that they take part in; `own` is
    the row's block. Up to BLOCK rows are one block."""
    rows = rows.withColumn("blocks", F.ceil(size / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "key")


def near_classes(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows_per_band: int = ROWS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: doc_id, text_key (md5 of the text), class_id (the
    least id of its component of links), n_links (other documents at the
    threshold or above), n_copies (of those, with the same n-grams), and
    `first`, the least (id, text_key) of the component."""
    spark = docs.sparkSession
    batches.for_texts(spark)

    def written(df: DataFrame, purpose: str) -> DataFrame:
        folder = shared_folder(spark, purpose)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.slices(batch.column(2), tb.SLICE // 4):
                names, counts, band, sig = sketch(data, offsets, size, bands, rows_per_band)
                own = batch.slice(first, end - first)
                spread = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(names, pa.binary()), pa.array(counts.astype(np.int32)), spread,
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "text_key", "key", "n", "bands", "sig"],
                )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.md5(text).alias("text_key"), text.alias("text"))
    sketches = written(
        rows.mapInArrow(batches.tidy(sketched), f"doc_id {kind}, text_key string, key binary, n int, bands array<int>, sig binary"), "sketches"
    )
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    classes = written(sketches.groupBy("key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("members")), "classes")
    values = sketches.where("n > 0").join(classes.select("key", "first"), "key")
    values = values.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    values = written(values.select("key", "bands", "sig").dropDuplicates(["key"]), "signatures")

    # buckets of more than one class
    spread = values.select("key", F.posexplode("bands").alias("band", "hash"))
    bucket = F.shiftleft(F.col("band").cast("bigint"), 32) + F.col("hash").cast("bigint")  # a number for each (band, hash)
    spread = spread.select("key", "band", bucket.alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    meeting = spread.join(shared, "bucket").join(values.select("key", "bands", "sig"), "key")
    enough = least_agreeing(threshold, bands * rows_per_band, tolerance)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["bucket", "x", "y"]):
            n = table.num_rows
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(n, -1)
            hashes = table["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)
            band, own = table["band"].to_numpy(), table["own"].to_numpy()
            across = table["x"].to_numpy() != table["y"].to_numpy()
            labels = np.arange(n)
            for a, b in _pairs(starts, n):
                apart = across[a] & (own[a] == own[b])
                a, b = a[~apart], b[~apart]
                # pairs that share an earlier bucket were compared there
                earlier = (hashes[a] == hashes[b]).argmax(1) < band[a]
                a, b = a[~earlier], b[~earlier]
                agree = np.zeros(len(a), np.int64)
                for done in range(STEP, sig.shape[1] + 1, STEP):
                    agree += (sig[a, done - STEP : done] == sig[b, done - STEP : done]).sum(1)
                    alive = agree >= enough[done]
                    a, b, agree = a[alive], b[alive], agree[alive]
                merge(labels, a, b)
            moved = np.flatnonzero(labels != np.arange(n))
            key = table["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([key.take(pa.array(moved)), key.take(pa.array(labels[moved]))], ["a", "b"])

    buckets = _in_blocks(meeting, "bucket", F.col("size"))
    groups = written(components(buckets.mapInArrow(batches.tidy(pruned), "a binary, b binary")), "groups")

    # exact verification within the groups
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "root").join(classes, F.col("node") == F.col("key")).select(
        "key", "root", "size", "members", F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__text")
    )
    texts = rows.join(members, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__text")))
    texts = texts.select("key", "root", "size", "members", "text").dropDuplicates(["key"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["root", "x", "y"]):
            ends = np.append(starts[1:], table.num_rows)
            found = [_verify(table.slice(s, e - s), threshold, size) for s, e in zip(starts, ends)]
            yield from pa.concat_tables(found).to_batches()

    links = written(
        _in_blocks(texts, "root", F.col("size")).mapInArrow(batches.tidy(verified), "key binary, low binary, links bigint"), "links"
    )
    together = components(links.select(F.col("key").alias("a"), F.col("low").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    roots = classes.join(together.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    leads = roots.groupBy("root").agg(F.min("first").alias("first"))
    lead = written(
        roots.drop("first").join(leads, "root").join(counts, "key", "left").select(
            "key", "first", "members", F.coalesce("links", F.lit(0)).alias("links")
        ), "class-links",
    )
    return sketches.select("doc_id", "text_key", "key").join(lead, "key").select(
        "doc_id", "text_key", F.col("first.doc_id").alias("class_id"),
        (F.col("members") - 1 + F.col("links")).cast("bigint").alias("n_links"),
        (F.col("members") - 1).cast("bigint").alias("n_copies"), "first",
    )


def _verify(table: pa.Table, threshold: float, size: int) -> pa.Table:
    """Links of each class with the others of its group: the number of documents
    linked, and the least class of the linked component."""
    n = table.num_rows
    parts = [(r + first, h) for first, _, data, offsets in tb.slices(table["text"].combine_chunks()) for r, h in [shingles(data, offsets, size)]]
    row, h = (np.concatenate(x) for x in zip(*parts))
    counts = np.bincount(row, minlength=n)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - c)), np.float32)
        part[row[a:b], column[a:b] - c] = 1
        shared += part @ part.T
    linked = shared >= threshold * (counts[:, None] + counts[None, :] - shared) - 1e-6
    np.fill_diagonal(linked, False)
    if table["x"][0] != table["y"][0]:
        own = table["own"].to_numpy()
        linked &= own[:, None] != own[None, :]
    labels = np.arange(n)
    merge(labels, *np.nonzero(np.triu(linked)))
    key = table["key"].combine_chunks()
    links = linked @ table["members"].to_numpy().astype(np.int64)
    return pa.table({"key": key, "low": key.take(pa.array(labels)), "links": pa.array(links.astype(np.int64))})


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of near copies, with all its columns: that of
    the least id (null last)."""
    found = near_classes(docs, **options)
    first, text, many = (free_name(docs, n) for n in ("first_id", "first_text", "rows_like_first"))
    lead = found.groupBy(F.col("first.doc_id").alias(first), F.col("first.text_key").alias(text)).agg(
        F.sum(
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).cast("int")
        ).alias(many)
    )
    key = F.md5(F.coalesce(docs["text"], F.lit("")))
    rows = docs.join(lead, docs["doc_id"].eqNullSafe(F.col(first)) & (key == F.col(text)))
    single = rows.where(F.col(many) == 1).select(*docs.columns)
    several = rows.where(F.col(many) > 1).dropDuplicates([first, text]).select(*docs.columns)
    return single.unionByName(several)
