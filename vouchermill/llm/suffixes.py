"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when a string of LENGTH bytes over it also starts elsewhere, in the
same text or another. A full suffix array would exchange LENGTH bytes for every
byte of text, so only suffixes at anchors are sorted: the anchor of a window of
LENGTH bytes is its GRAM with the least hash. Equal windows have equal anchors
at equal places, so windows need only be compared among suffixes that start
with the same gram, and nothing is lost by the sampling.

1. Anchors are counted into a table of bits of bounded size, by hash. Grams that
   occur once need not be exchanged; a hash shared by chance costs work only.
2. Each task sorts the suffixes at its remaining anchors (with the bytes to the
   left that their windows reach), collapses equal ones, and writes the run in
   front coding, cut by the hash of the gram. What a task holds of one passage
   is one entry, however many of its texts have it.
3. The runs of a part are merged by a loser tree that never compares a known
   prefix again. Neighbours that share less than a gram end a group. Two windows
   are equal if their entries share the bytes from the anchor on and those before
   it: the first follows from the prefixes that the merge knows, the second from
   the entries sorted by the bytes before the anchor, so no window is hashed or
   read. A part that a very common gram makes larger than MOST_PART_BYTES is
   dealt to several tasks by run, and no group of WINDOW_BYTES or more is held:
   such groups are cut into slices. A slice judges its own windows and passes on
   two 61-bit hashes of each different one with its count, the counts of all
   slices are added up in a second shuffle, and the windows that repeat elsewhere
   go back to their entries. The hashes are polynomials modulo 2**61 - 1 at bases
   drawn for each job, so no text can be made to collide.
4. The verdicts go back to the runs, which know the places, and from there to
   the texts.

Defined cases: null texts are empty and have nothing to remove; texts shorter
than LENGTH have no window; texts of any length are read in pieces that overlap
by LENGTH - 1 bytes; rows that repeat in id and text are different documents, so
all their windows repeat, and their spans are kept once; an empty table stays
empty; cutting bytes can split a character of several bytes, which
`remove_repeats` decodes with replacement; other columns are left alone,
whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vouchermill.llm import batches, textbytes as tb
from vouchermill.llm.merge import Run, merge_runs
from vouchermill.llm.words import free_name, row_key
from vouchermill.session import shared_folder

LENGTH = 200
PLACE_BITS = 28  # of the low bits of a gram's hash, which hold its place in a piece of text
#: bytes of texts whose anchors are looked for at once
PIECE_BYTES = 1 << 18
#: bits of the filter per expected anchor, and the most (128 MB)
SPARE, MOST_BITS, SEGMENT_BITS = 16, 30, 10
#: bytes of entries that a task sorts as one run; bytes of a part to aim at
RUN_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: entries whose windows are compared at once; bytes of a part that one task merges
WINDOW_BYTES, MOST_PART_BYTES = 2 << 20, 32 << 20
#: rows of bytes gathered at once
ROWS = 2048


def gram_size(length: int) -> int:
    return max(2, min(24, length // 4))


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, place of the piece in its text). Every
    window of LENGTH bytes lies in one piece; only a long text has several."""
    for first, end, data, offsets in tb.slices(column, PIECE_BYTES):
        if len(data) <= 2 * PIECE_BYTES:
            yield first, end, data, offsets, 0
            continue
        for a in range(0, len(data) - length + 1, PIECE_BYTES):
            piece = data[a : a + PIECE_BYTES + length - 1]
            yield first, end, piece, np.array([0, len(piece)]), a


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """For each anchor with its consecutive windows: row, place, first and last
    start of its windows, and the gram's hash. Places count in `data`."""
    gram, n = gram_size(length), len(data)
    sizes = np.diff(offsets)
    long_enough = sizes >= length
    if not long_enough.any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tb.powers(n), out=sums[1:])
    hashes = tb.mix((sums[gram:] - sums[:-gram]) * tb.inverse_powers(n + 1)[: n + 1 - gram])
    low = np.uint64((1 << PLACE_BITS) - 1)
    value = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, k = length - gram + 1, 1
    while 2 * k <= span:
        value = np.minimum(value[:-k], value[k:])
        k *= 2
    value = np.minimum(value[: len(value) - (span - k)], value[span - k :])
    count = (sizes - length + 1)[long_enough]
    start = np.repeat(offsets[:-1][long_enough] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place = (value[start] & low).astype(np.int64)
    fresh = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = start[np.append(fresh[1:], len(start)) - 1]
    place, start = place[fresh], start[fresh]
    return np.searchsorted(offsets, start, "right") - 1, place, start, last, hashes[place]


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (tb.mix(hashes + np.uint64(0x51ED270B)) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_grams(texts: DataFrame, length: int, bits: int) -> np.ndarray:
    """Packed bits by gram hash: set if at least two anchors have it. The driver
    gets 2**bits bits."""
    low = bits - SEGMENT_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(bucket, np.arange((1 << SEGMENT_BITS) + 1) << low)
            local = (bucket & ((1 << low) - 1)).astype(np.uint32)
            rows = [(s, local[a:b], times[a:b] > 1) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in rows], pa.int32()), pa.array([x[~m].tobytes() for _, x, m in rows], pa.binary()),
                 pa.array([x[m].tobytes() for _, x, m in rows], pa.binary())], ["segment", "once", "more"],
            )

        for batch in batches:
            for _, _, data, offsets, _ in pieces(batch.column(0), length):
                found = _buckets(anchors(data, offsets, length)[4], bits)
                if len(found):
                    held.append(found)
                    size += len(found)
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, np.zeros(1 << low, np.uint8)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(times > 1).tobytes()])], ["segment", "bits"])

        for batch in batches:
            for segment, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now:
                    if now is not None:
                        yield out()
                    now, times[:] = segment, 0
                at = np.frombuffer(once, np.uint32)
                times[at] = np.minimum(times[at] + 1, 2)
                times[np.frombuffer(more, np.uint32)] = 2
        if now is not None:
            yield out()

    rows = texts.select("text").mapInArrow(batches.tidy(counted), "segment int, once binary, more binary")
    rows = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(batches.tidy(joined), "segment int, bits binary")
    table = np.zeros((1 << SEGMENT_BITS, (1 << low) // 8), np.uint8)
    for r in rows.toLocalIterator():
        table[r.segment] = np.frombuffer(r.bits, np.uint8)
    return table.ravel()


def _gather(data: np.ndarray, first: np.ndarray, count: np.ndarray, span: np.ndarray, out: np.ndarray) -> None:
    """Bytes at first + span, of each row as many as `count`; the rest stays zero."""
    at = np.minimum(first.astype(np.int32)[:, None] + span, np.int32(len(data) - 1))
    np.copyto(out, data[at], where=span < count.astype(np.int32)[:, None])


def _write_run(entries: list, length: int, parts: int) -> pa.RecordBatch | None:
    """Sort, collapse and front-code entries; one row for each part. An entry's
    key is the bytes from its anchor on, its tie those before it."""
    key16, start, left, right, gram, body = zip(*entries)
    key16, start, gram = np.concatenate(key16), np.concatenate(start), np.concatenate(gram)
    left, right = np.concatenate(left), np.concatenate(right)
    part = (tb.mix(gram) % np.uint64(parts)).astype(np.int64)
    size = left + right
    data = np.concatenate(body)
    begin = np.cumsum(size) - size
    n = len(size)
    # fixed-width rows: part, key, tie, and both lengths (so padding never matters for equality)
    matrix = np.zeros((n, 4 + 2 * length + 4), np.uint8)
    matrix[:, :4] = part.astype(">u4").view(np.uint8).reshape(n, 4)
    span = np.arange(length, dtype=np.int32)
    for first, count, to in ((begin + left, right, 4), (begin, left, 4 + length)):
        for c in range(0, n, ROWS):
            _gather(data, first[c : c + ROWS], count[c : c + ROWS], span, matrix[c : c + ROWS, to : to + length])
    matrix[:, -4:] = np.stack([right + 257, left + 257], 1).astype(">u2").view(np.uint8).reshape(n, 4)
    order = np.argsort(matrix.view(f"S{matrix.shape[1]}").ravel(), kind="stable")
    matrix = matrix[order]
    differs = matrix[1:] != matrix[:-1]
    fresh = np.append(True, differs.any(1))
    kept = order[fresh]
    many = np.diff(np.append(np.flatnonzero(fresh), n)) > 1
    # the places of each entry; those of rows that repeat in id and text are one
    item, owner = np.cumsum(fresh) - 1, key16[order].view(np.uint64).reshape(n, 2)
    place = np.lexsort((start[order], owner[:, 1], owner[:, 0], item))
    told = np.stack([item[place].astype(np.uint64), owner[place, 0], owner[place, 1], start[order][place].astype(np.uint64)], 1)
    once = np.append(True, (told[1:] != told[:-1]).any(1))
    seen, times = order[place][once], np.bincount(item[place][once], minlength=len(kept))
    rows = matrix[fresh]
    del matrix, told
    differs = rows[1:, 4 : 4 + length] != rows[:-1, 4 : 4 + length]
    lcp = np.where(differs.any(1), differs.argmax(1), length)
    lcp = np.append(0, np.minimum(lcp, np.minimum(right[kept][1:], right[kept][:-1])))
    part = part[kept]
    cut = np.searchsorted(part, np.arange(parts + 1))
    occurrence = np.append(0, np.cumsum(times))
    run = TaskContext.get().partitionId() * 100_000 + _write_run.number
    _write_run.number += 1
    out = []
    for p in np.flatnonzero(np.diff(cut)):
        a, b = cut[p], cut[p + 1]
        lcp[a] = 0
        r, lf = right[kept[a:b]], left[kept[a:b]]
        keys = [rows[a + i, 4 + lcp[a + i] : 4 + r[i]].tobytes() + rows[a + i, 4 + length : 4 + length + lf[i]].tobytes() for i in range(b - a)]
        head = np.stack([r, lf, lcp[a:b], many[a:b]], 1).astype(np.uint16)
        own = seen[occurrence[a] : occurrence[b]]
        out.append({
            "part": int(p), "run": run, "bytes": int((r + lf).sum()), "head": head.tobytes(), "keys": b"".join(keys), "times": times[a:b].astype(np.int32).tobytes(),
            "owners": key16[own].tobytes(), "starts": start[own].astype(np.int64).tobytes(),
        })
    return pa.RecordBatch.from_pylist(out, _RUN)


_RUN = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("bytes", pa.int64()), *[(c, pa.binary()) for c in ("head", "keys", "times", "owners", "starts")]])


_MERGED = pa.schema(
    [("part", pa.int32()), ("run", pa.int64()), ("verdicts", pa.binary()), ("left", pa.int32()), ("value", pa.int64()), ("check", pa.int64()),
     ("item", pa.int32()), ("window", pa.int32()), ("times", pa.int32())]
)
#: verdicts in one batch
MOST_VERDICTS = 1 << 18
#: windows asked about in one batch
MOST_ASKED = 1 << 16


def _sorted_run(head: np.ndarray, keys: bytes, at: int) -> tuple[Run, list[int]]:
    texts, ties, before = [], [], b""
    for right, left, lcp, _ in head.tolist():
        end = at + right - lcp
        before = before[:lcp] + keys[at:end]
        texts.append(before)
        ties.append(keys[end : end + left])
        at = end + left
    return Run(texts, ties, head[:, 2].tolist()), head[:, 3].tolist()


class Member(NamedTuple):
    """An entry of a group: bytes before the anchor and from it on, whether it occurs
    more than once, its (run, item)s, and the prefix of `right` that the entry before it has."""

    left: bytes
    right: bytes
    many: int
    owners: list[tuple[int, int]]
    shared: int


def _judge(members: list[Member], length: int):
    """For each number of bytes before the anchor that a window can have: that
    number, the members with such a window, and which windows are equal (by class).

    The bytes from the anchor on are equal as long as the shared prefixes of the
    members between reach; those before it are compared by sorting them backwards.
    """
    n, width = len(members), length - gram_size(length)
    left, right, shared = (np.array(x, np.int32) for x in zip(*((len(m.left), len(m.right), m.shared) for m in members)))
    body = np.frombuffer(b"".join(m.left for m in members) or b"\0", np.uint8)
    mirror, span, end = np.zeros((n, width), np.uint8), -np.arange(1, width + 1, dtype=np.int32), np.cumsum(left)
    for c in range(0, n, ROWS):
        at = np.maximum(end[c : c + ROWS, None].astype(np.int32) + span, 0)
        np.copyto(mirror[c : c + ROWS], body[at], where=-span <= left[c : c + ROWS, None])
    order = np.argsort(mirror.view(f"S{width}").ravel(), kind="stable")
    mirror = mirror[order]
    differs = mirror[1:] != mirror[:-1]
    alike = np.append(width, np.where(differs.any(1), differs.argmax(1), width))
    before = np.empty(n, np.int64)
    for k in range(width + 1):
        has = np.flatnonzero((left >= k) & (right >= length - k))
        if len(has):
            before[order] = np.cumsum(alike < k)
            yield k, has, np.cumsum(shared < length - k)[has] * (n + 1) + before[has]


_PRIME = np.uint64((1 << 61) - 1)
_U = [np.uint64(i) for i in range(65)]


def _reduced(a: np.ndarray) -> np.ndarray:
    """a modulo 2**61 - 1."""
    a = (a >> _U[61]) + (a & _PRIME)
    return np.where(a >= _PRIME, a - _PRIME, a)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1."""
    low, a1, b1 = np.uint64((1 << 32) - 1), a >> _U[32], b >> _U[32]
    a0, b0 = a & low, b & low
    middle, small = a1 * b0 + a0 * b1, a0 * b0
    return _reduced((a1 * b1 << _U[3]) + (middle >> _U[29]) + ((middle & np.uint64((1 << 29) - 1)) << _U[32]) + (small >> _U[61]) + (small & _PRIME))


class _Hashes:
    """Polynomials modulo 2**61 - 1 of strings within members, from sums over all their bytes."""

    def __init__(self, members: list[Member], base: int, length: int):
        body = np.frombuffer(b"".join(m.left + m.right for m in members), np.uint8)
        size = np.array([len(m.left) + len(m.right) for m in members])
        self.begin = np.cumsum(size) - size
        powers = [1]
        while len(powers) <= 2 * length:  # an entry's bytes; the same for all slices
            powers.append(powers[-1] * base % int(_PRIME))
        self.powers = np.array(powers, np.uint64)
        self.high, self.low = np.zeros(len(body) + 1, np.uint64), np.zeros(len(body) + 1, np.uint64)
        place = np.arange(len(body), dtype=np.int32) - np.repeat(self.begin.astype(np.int32), size)
        term = _times(self.powers[place], body.astype(np.uint64) + _U[1])
        np.cumsum(term >> _U[32], out=self.high[1:])
        np.cumsum(term & np.uint64((1 << 32) - 1), out=self.low[1:])

    def at(self, member: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        """Of the strings of one length that start at places of members."""
        a = self.begin[member] + place
        high, low = self.high[a + length] - self.high[a], self.low[a + length] - self.low[a]
        total = _reduced((high >> _U[29]) + ((high & np.uint64((1 << 29) - 1)) << _U[32]) + low)
        return _times(total, self.powers[len(self.powers) - 1 - place]).view(np.int64)


def _told(members: list[Member], length: int, bases: tuple[int, int] | None):
    """(run, item, first and last window) of the windows that repeat among the members. With
    bases, also arrays of each different window: bytes before the anchor, both hashes,
    run, item, window of the entry, and 1, or 2 if it repeats here."""
    many = np.array([m.many for m in members], bool)
    left = np.array([len(m.left) for m in members])
    again = np.zeros((len(members), length - gram_size(length) + 3), bool)  # by bytes before the anchor, plus one
    hashes = [_Hashes(members, b, length) for b in bases or ()]
    run, item = np.array([m.owners[0] for m in members]).T
    asked, size = [], 0
    for k, has, code in _judge(members, length):
        _, first, back, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        hit = times > 1
        again[has, k + 1] = hit[back] | many[has]
        if bases:
            own = has[first]
            window = left[own] - k
            asked.append((np.full(len(own), k), *(h.at(own, window, length) for h in hashes), run[own], item[own], window, np.where(hit | many[own], 2, 1)))
            size += len(own)
            if size > MOST_ASKED:
                yield tuple(map(np.concatenate, zip(*asked)))
                asked, size = [], 0
    if asked:
        yield tuple(map(np.concatenate, zip(*asked)))
    # windows that follow one another, from the leftmost
    row, most = np.nonzero(again[:, 1:-1] & ~again[:, 2:])
    _, least = np.nonzero(again[:, 1:-1] & ~again[:, :-2])
    for i, a, b in zip(row.tolist(), most.tolist(), least.tolist()):
        for r, own in members[i].owners:
            yield r, own, int(left[i]) - a, int(left[i]) - b


def _merged(rows: list[dict], length: int, sliced: bool = False, most: int = WINDOW_BYTES, bases: tuple[int, int] = (2, 3)):
    """Over the runs of one part: what `_told` gives of its groups; windows are asked
    about where a group goes on elsewhere: if it has more than `most` bytes, or in
    all groups if the part is `sliced`."""
    gram = gram_size(length)
    runs, many = [], []
    for row in rows:
        run, more = _sorted_run(np.frombuffer(row["head"], np.uint16).reshape(-1, 4), row["keys"], 0)
        row["keys"] = None
        runs.append(run)
        many.append(more)
    group: list[Member] = []
    pending: list[Member] = []
    held = size = 0
    cut = False  # whether slices of `group` have been told already

    def ended():
        nonlocal held, pending
        if cut:
            yield from _told(group, length, bases)
        elif sliced or len(group) > 1:
            pending += group
            held += size
            if held > most:
                yield from _told(pending, length, bases if sliced else None)
                pending, held = [], 0
        elif group[0].many:
            yield from ((r, i, 0, len(group[0].left) + len(group[0].right) - length) for r, i in group[0].owners)

    for r, i, shared in merge_runs(runs):
        key, tie = runs[r].keys[i], runs[r].ties[i]
        if group and shared < gram:
            yield from ended()
            group, size, cut = [], 0, False
        if group and group[-1].right == key and group[-1].left == tie:  # the same entry in another run
            group[-1].owners.append((r, i))
            group[-1] = group[-1]._replace(many=1)
            continue
        if size > most:  # the group goes on in another slice
            yield from _told(group, length, bases)
            group, size, cut = [], 0, True
        group.append(Member(tie, key, many[r][i], [(r, i)], shared))
        size += len(key) + len(tie)
    if group:
        yield from ended()
    if pending:
        yield from _told(pending, length, bases if sliced else None)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key (16 bytes: row_key of id and text) and spans (array of [start, end)) of
    every text with repeated bytes; spans of a text may overlap."""
    spark = docs.sparkSession
    batches.for_texts(spark)
    texts = docs.select(F.unhex(row_key(F.col("doc_id"), F.col("text"))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = SPARE * 2 * total // (length - gram_size(length) + 2) + 1
    bits = min(MOST_BITS, max(SEGMENT_BITS + 3, wanted.bit_length()))
    shared = spark.sparkContext.broadcast(repeated_grams(texts, length, bits))  # 2**MOST_BITS bits at most
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = shared.value, [], 0  # the entries of a run, and their bytes
        _write_run.number = 0
        for batch in batches:
            for first, end, data, offsets, base in pieces(batch.column(1), length):
                row, place, start, last, hashes = anchors(data, offsets, length)
                bucket = _buckets(hashes, bits)
                again = (table[bucket >> 3] >> (7 - (bucket & 7))) & 1 == 1
                row, place, start, last, hashes = (x[again] for x in (row, place, start, last, hashes))
                keys = np.frombuffer(b"".join(batch.column(0).slice(first, end - first).to_pylist()), "V16")
                n = last + length - start
                for a in range(0, len(row), ROWS):
                    s = slice(a, a + ROWS)
                    at = np.repeat(start[s] - (np.cumsum(n[s]) - n[s]), n[s]) + np.arange(n[s].sum())
                    held.append((keys[row[s]], start[s] - offsets[row[s]] + base, (place - start)[s], (last + length - place)[s], hashes[s], data[at]))
                    size += len(at)
                    if size > RUN_BYTES:
                        yield _write_run(held, length, parts)
                        held, size = [], 0
        if size:
            yield _write_run(held, length, parts)

    folder = shared_folder(spark, "suffix-runs")
    texts.mapInArrow(
        batches.tidy(sorted_runs), "part int, run bigint, bytes bigint, head binary, keys binary, times binary, owners binary, starts binary"
    ).write.option("compression", "zstd").parquet(folder)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]):
            part, found, n = rows[0]["part"], {}, 0

            def verdicts():
                return pa.RecordBatch.from_pylist(
                    [{"part": part, "run": rows[r]["run"], "verdicts": np.array(v, np.int32).tobytes()} for r, v in found.items()], _MERGED
                )

            run = np.array([row["run"] for row in rows])
            for got in _merged(rows, length, rows[0]["slices"] > 1, most, bases):
                if len(got) == 4:
                    r, i, a, b = got
                    found.setdefault(r, []).append((i, a, b))
                    n += 1
                    if n >= MOST_VERDICTS:
                        yield verdicts()
                        found, n = {}, 0
                    continue
                left, value, check, row, item, window, times = got
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), part, np.int32)), pa.array(run[row]), pa.nulls(len(value), pa.binary()), pa.array(left.astype(np.int32)),
                     pa.array(value), pa.array(check), *(pa.array(x.astype(np.int32)) for x in (item, window, times))], schema=_MERGED,
                )
            if found:
                yield verdicts()

        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["part"], row["slice"]) != (rows[0]["part"], rows[0]["slice"]):
                    yield from out(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from out(rows)

    runs, most = spark.read.parquet(folder), WINDOW_BYTES
    bases = (secrets.randbelow(1 << 60) + (1 << 59), secrets.randbelow(1 << 60) + (1 << 59))
    # at most one row for every MOST_PART_BYTES of entries
    large = runs.groupBy("part").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > MOST_PART_BYTES)
    large = large.select("part", F.ceil(F.col("bytes") / (MOST_PART_BYTES // 2)).cast("int").alias("slices"))
    dealt = runs.select("part", "run", "head", "keys").join(F.broadcast(large), "part", "left")
    dealt = dealt.withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("run"), F.col("slices")).cast("int"))
    dealt = dealt.repartition("part", "slice").sortWithinPartitions("part", "slice", "run")
    found = shared_folder(spark, "suffix-verdicts")
    dealt.mapInArrow(
        batches.tidy(merged), "part int, run bigint, verdicts binary, left int, value bigint, check bigint, item int, window int, times int"
    ).write.option("compression", "zstd").parquet(found)
    found = spark.read.parquet(found)

    # windows of groups in slices: the counts of all slices together
    asked = found.where("value is not null").drop("verdicts")
    repeated = asked.groupBy("part", "left", "value", "check").agg(F.sum("times").alias("total")).where("total > 1").drop("total")
    back = asked.where("times = 1").join(repeated, ["part", "left", "value", "check"]).select("part", "run", "item", "window")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that follow one another in an entry as one verdict."""
        for batch in batches:
            part, run, item, window = (c.to_numpy().astype(np.int64) for c in batch.columns)
            step = np.zeros(len(part) + 1, bool)
            step[1:-1] = (np.diff(part) == 0) & (np.diff(run) == 0) & (np.diff(item) == 0) & (np.diff(window) == 1)
            a, b = np.flatnonzero(~step[:-1]), np.flatnonzero(~step[1:])
            lines = np.stack([item[a], window[a], window[b]], 1).astype(np.int32)
            cut = np.flatnonzero(np.append(True, (np.diff(part[a]) != 0) | (np.diff(run[a]) != 0))) if len(a) else a
            ends = np.append(cut[1:], len(a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[a][cut].astype(np.int32)), pa.array(run[a][cut]),
                 pa.array([lines[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())], ["part", "run", "verdicts"],
            )

    back = back.repartition("part", "run").sortWithinPartitions("part", "run", "item", "window")
    back = back.mapInArrow(batches.tidy(gathered), "part int, run bigint, verdicts binary")
    verdicts = found.where("verdicts is not null").select("part", "run", "verdicts").unionByName(back)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                item, a, b = np.frombuffer(row["verdicts"], np.int32).reshape(-1, 3).T.astype(np.int64)
                times = np.frombuffer(row["times"], np.int32).astype(np.int64)
                first = np.cumsum(times) - times
                n = times[item]
                at = np.repeat(first[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                owners, starts = np.frombuffer(row["owners"], "V16")[at], np.frombuffer(row["starts"], np.int64)[at]
                raw = owners.tobytes()
                keys = pa.Array.from_buffers(
                    pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 16).astype(np.int32)), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(starts + np.repeat(a, n)), pa.array(starts + np.repeat(b, n) + length)], ["key", "start", "end"]
                )

    owners = runs.select("part", "run", "times", "owners", "starts").join(verdicts, ["part", "run"])
    spans = owners.select("verdicts", "times", "owners", "starts").mapInArrow(batches.tidy(placed), "key binary, start bigint, end bigint")
    # rows that repeat in id and text have the same spans: each is kept once
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    kept, removed, runs, at = [], 0, 0, 0
    for s in sorted((s["start"], s["end"]) for s in spans):
        if s[0] > at or not runs:
            kept.append(raw[at : s[0]])
            runs += 1
            at = s[0]
        if s[1] > at:
            removed += s[1] - at
            at = s[1]
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """The documents with their spans in a last column."""
    key, last = free_name(docs, "key"), free_name(docs, "spans")
    spans = repeated_spans(docs, length).withColumnsRenamed({"key": key, "spans": last})
    rows = docs.withColumn(key, F.unhex(row_key(docs["doc_id"], docs["text"])))
    return rows.join(spans, key, "left").select(*docs.columns, last)


def report_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                kept, removed, runs = _cut(raw, spans or [])
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            n = [pa.array([o[i] for o in out], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select("doc_id", "text"), length)
    return rows.mapInArrow(batches.tidy(told), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all their columns, without the repeated bytes of `text`."""
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _cut(t.encode(), s)[0].decode(errors="replace") if s and t is not None else t
                for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    fields = [StructField(f.name, StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return _with_spans(docs, length).mapInArrow(batches.tidy(cut), StructType(fields))
