"""Secrets in texts: named assignments, key formats, and windows of high entropy.

Three kinds are found by their form: `assign` (a name such as `token`, then `:`
or `=`, then a value), `access` (an access key id) and `hex` (a long run of
hexadecimal digits). The others are found by what they look like: for every
character class, each maximal run of its characters that is long enough is a
candidate string, and a window slides over it. A step takes one character out
of the counts and puts one in, so the entropy of every window follows from the
one before. Windows that reach the class's bits are joined to spans, and
candidates on the allow list (identifiers, ids that are public by their form,
placeholders, the caller's own strings) are suppressed. The allow list never
touches the first three kinds.

Entropy is kept in integers: with counts c of a window of W characters,
W * (log2 W - entropy) is the sum of c * log2 c, and each c * log2 c is rounded
once to a multiple of 2^-20. Sums are therefore exact whatever the order of the
steps, and every window is judged alike.

Work is done per Arrow batch on the UTF-8 bytes, without any shuffle: all
characters of all kinds are ASCII, so only places have to be counted in code
points afterwards. Long candidates are cut into pieces that overlap by a window
less one character, which bounds the memory and loses no window.

Defined cases: a null text is empty and has no spans; a null or repeated doc_id
is a row like any other; equal rows give equal results; an empty table stays
empty; only doc_id and text are read, so other columns may have any name;
`redact` gives all columns back and changes `text` only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vouchermill.llm import batches, textbytes as tb

# fixed values: names, value characters and least lengths of the kinds known by form
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = rb"(?:" + "|".join(NAMES).encode() + rb")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")

DIGITS, LETTERS = "0123456789", tb.LETTERS


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a candidate string, window length, and bits from which a window counts."""

    name: str
    characters: str
    window: int
    bits: float


#: random strings reach about 3.4, 4.0 and 4.4 bits, words of a language rarely 3.6
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_alnum", DIGITS + LETTERS, 20, 3.8),
    CharacterClass("entropy_base64", DIGITS + LETTERS + "+/=_-", 28, 4.1),
)
#: candidates that are no secrets: the whole string, or a part of it, has this form
ALLOWED_WHOLE = (
    r"[A-Z]?[a-z]{2,}([-_/A-Z][a-z]{2,})*",  # words and identifiers made of words
    r"[A-Z]{2,}([-_/][A-Z]{2,})*",
    r"[0-9]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)
ALLOWED_PART = (r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]", r"[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]", r"0123456789", r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg]")

SCALE = 1 << 20
#: bytes of candidates whose windows are counted at once
PIECE = 1 << 18


def terms(window: int) -> np.ndarray:
    """c * log2 c for every count of a window, as integers."""
    return np.array([0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)], np.int64)


def most(window: int, bits: float) -> int:
    """Largest sum of terms with which a window still has that many bits."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def window_sums(codes: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of candidates that lie one after another in `codes`
    (`first` and `size` of each), and the sum of the terms of its counts.

    The count of the character that a step takes in, and of the one that it
    takes out, is read from the sorted places of equal characters.
    """
    term = terms(window)
    gain = term[1:] - term[:-1]  # by the count after putting a character in
    run = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(codes))
    group = run.astype(np.int64) * 256 + codes
    order = np.argsort(group, kind="stable")
    far = len(codes) + 2 * window
    _, dense = np.unique(group[order], return_inverse=True)
    key = dense * far + place[order]
    rank = np.arange(len(codes))
    count_in, count_out = np.empty_like(place), np.empty_like(place)
    # a group's places are within `far` of each other, so no search leaves the group
    count_in[order] = rank - np.searchsorted(key, np.maximum(key - window + 1, dense * far)) + 1
    count_out[order] = np.searchsorted(key, key + window) - rank
    step = gain[count_in - 1]
    leaves = place - first[run] >= window
    step[leaves] -= gain[count_out[place[leaves] - window] - 1]
    total = np.cumsum(step)
    total -= (total - step)[first][run]
    ends = np.flatnonzero(place - first[run] >= window - 1)
    return ends - window + 1, total[ends]


def entropy_spans(data: np.ndarray, offsets: np.ndarray, kind: CharacterClass) -> tuple[np.ndarray, ...]:
    """Row, start and end of the joined windows with enough bits, and start and
    end of the candidate each is in."""
    window, limit = kind.window, most(kind.window, kind.bits)
    starts, ends, rows = tb.tokens(tb.byte_table(kind.characters, lower=False, high=False)[data], offsets)
    long_enough = ends - starts >= window
    starts, ends, rows = starts[long_enough], ends[long_enough], rows[long_enough]
    n = np.maximum(1, -(-(ends - starts - window + 1) // PIECE))  # pieces of each candidate
    owner = np.repeat(np.arange(len(starts)), n)
    begin = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    size = np.minimum(ends[owner], begin + PIECE + window - 1) - begin
    found, found_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, "right")))
        own = size[a:b]
        first = np.cumsum(own) - own
        shift = begin[a:b] - first
        at = np.arange(own.sum()) + np.repeat(shift, own)
        window_at, sums = window_sums(data[at], first, own, window)
        window_at = window_at[sums <= limit]
        piece = np.searchsorted(first, window_at, "right") - 1
        found.append(window_at + shift[piece])
        found_owner.append(owner[a:b][piece])
        a = b
    at, of = np.concatenate(found), np.concatenate(found_owner)
    if not len(at):
        return (at,) * 5
    apart = (of[1:] != of[:-1]) | (at[1:] - at[:-1] > window)
    head, tail = np.append(True, apart), np.append(apart, True)
    of = of[head]
    return rows[of], at[head], at[tail] + window, starts[of], ends[of]


def form_spans(data: np.ndarray, offsets: np.ndarray, assign: re.Pattern, access: re.Pattern) -> list[tuple[np.ndarray, ...]]:
    """Row, start and end of the assignments, access keys and hexadecimal runs."""
    lines = np.insert(data, offsets[1:-1], 10).tobytes()  # a line feed, which no kind contains, keeps texts apart
    begins = offsets[:-1] + np.arange(len(offsets) - 1)

    def placed(spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        start, end = np.array(spans, np.int64).reshape(-1, 2).T
        row = np.searchsorted(begins, start, "right") - 1
        return row, start - row, end - row

    out = [
        placed([m.span() for m in assign.finditer(lines) if m.end(1) - m.start(1) >= LEAST_VALUE]),
        placed([m.span() for m in access.finditer(lines) if m.end() - m.start() >= LEAST_ACCESS]),
    ]
    start, end, row = tb.tokens(tb.byte_table(DIGITS + "abcdef", lower=False, high=False)[data], offsets)
    kept = end - start >= LEAST_HEX
    return [*out, (row[kept], start[kept], end[kept])]


class Scanner:
    """Finds the spans of a slice of texts; patterns are compiled once per task."""

    def __init__(self, classes: tuple[CharacterClass, ...], allowed: Iterable[str]):
        self.classes, self.allowed = classes, {s.encode() for s in allowed}
        self.assign, self.access = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS)
        self.whole = re.compile("|".join(f"(?:{p})" for p in ALLOWED_WHOLE).encode())
        self.part = re.compile("|".join(ALLOWED_PART).encode())

    def suppressed(self, candidate: bytes) -> bool:
        return candidate in self.allowed or bool(self.whole.fullmatch(candidate) or self.part.search(candidate))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, end (bytes of the slice) and kind of all spans in order, and the rows of suppressed ones."""
        found = form_spans(data, offsets, self.assign, self.access)
        gone = [np.zeros(0, np.int64)]
        for kind in self.classes:
            row, start, end, a, b = entropy_spans(data, offsets, kind)
            drop = np.array([self.suppressed(data[x:y].tobytes()) for x, y in zip(a, b)], bool)
            gone.append(row[drop])
            found.append((row[~drop], start[~drop], end[~drop]))
        kinds = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        row, start, end = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((end, kinds, start, row))
        return row[order], start[order], end[order], kinds[order], np.concatenate(gone)


def secret_spans(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: Iterable[str] = ()) -> DataFrame:
    """One row per document: doc_id, `spans` (kind, start, end in code points, end
    exclusive; by start, then kind) and `n_suppressed`, the spans that the allow
    list took away. `allowed` are the caller's own harmless strings."""
    batches.for_texts(docs.sparkSession)
    allowed = tuple(allowed)
    names = pa.array([*BASE_KINDS, *(c.name for c in classes)])
    field = docs.schema["doc_id"].dataType.simpleString()

    def scanned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in stream:
            for first, end_row, data, offsets in tb.slices(batch.column(1)):
                row, start, end, kind, gone = scanner.spans(data, offsets)
                points = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                base = points[offsets[row]].astype(np.int64)
                rows = end_row - first
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
                values = pa.StructArray.from_arrays(
                    [names.take(pa.array(kind)), pa.array(points[start] - base), pa.array(points[end] - base)], ["kind", "start", "end"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values),
                     pa.array(np.bincount(gone, minlength=rows))], ["doc_id", "spans", "n_suppressed"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        scanned, f"doc_id {field}, spans array<struct<kind string, start bigint, end bigint>>, n_suppressed bigint"
    )


def redact(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: Iterable[str] = ()) -> DataFrame:
    """The documents, all their columns, with `[kind]` in place of the secrets of
    `text`; spans that overlap become one, named after the first."""
    batches.for_texts(docs.sparkSession)
    allowed = tuple(allowed)
    names = [f"[{n}]".encode() for n in (*BASE_KINDS, *(c.name for c in classes))]
    at = docs.columns.index("text")

    def masked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in stream:
            texts = []
            for first, end_row, data, offsets in tb.slices(batch.column(at)):
                row, start, end, kind, _ = scanner.spans(data, offsets)
                cut = np.searchsorted(row, np.arange(end_row - first + 1))
                for i in range(end_row - first):
                    parts, done = [], offsets[i]
                    for a, b, k in zip(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]], kind[cut[i] : cut[i + 1]]):
                        if a >= done:
                            parts += [data[done:a].tobytes(), names[k]]
                        done = max(done, b)
                    texts.append(b"".join([*parts, data[done : offsets[i + 1]].tobytes()]).decode(errors="replace"))
            columns = list(batch.columns)
            columns[at] = pa.array([t if v else None for t, v in zip(texts, batch.column(at).is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [StructField(f.name, StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(masked, StructType(fields))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")


def report(spans: DataFrame) -> DataFrame:
    """Counts and digests of the rows of `secret_spans`."""
    return spans.select(
        "doc_id",
        *[_count(k) for k in BASE_KINDS],
        F.sha2(_joined(F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_suppressed",
    )
