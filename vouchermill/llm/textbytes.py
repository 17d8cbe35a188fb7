"""Vectorised tokens of Arrow text columns, as numpy arrays over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: bytes of text worked on at once; one longer text makes a slice of its own
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(which: int, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        factors = np.full(max(n, SLICE + 4096), base, np.uint64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors, dtype=np.uint64)
    return _powers[which][:n]


def powers(n: int) -> np.ndarray:
    return _grown(0, _BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _grown(1, _INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about
    `size` bytes together. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


def tokens(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of non-zero bytes; no run
    crosses the end of a text."""
    inside = kinds != 0
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: longest run that is hashed by a sum of powers. Modulo 2**64, sums of longer runs can be equal
#: for regular strings: those of a Thue-Morse string and its complement are from 1,024 bytes on
SUMMED = 128


def run_hashes(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, whatever its place."""
    sums = np.zeros(len(kinds) + 1, np.uint64)
    np.cumsum((kinds.astype(np.uint64) + np.uint64(1)) * powers(len(kinds)), out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse_powers(len(kinds) + 1)[starts] + length_salt(ends - starts))
    for i in np.flatnonzero(ends - starts > SUMMED):
        out[i] = int.from_bytes(blake2b(kinds[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run of each kind, and the kind of every run. Runs of a kind have the same bytes, not just the same hash."""
    _, sample, kind = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    other = size != size[sample[kind]]
    if not other.any():
        differs = data[np.repeat(starts, size) + at] != data[np.repeat(starts[sample[kind]], size) + at]
        other[np.repeat(np.arange(len(starts)), size)[differs]] = True
    if other.any():  # a hash that several strings share
        known: dict[bytes, int] = {}
        kind = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends)], np.int64)
        sample = np.unique(kind, return_index=True)[1]
    return sample, kind


def length_salt(length: np.ndarray | int) -> np.ndarray:
    return np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + b)


def byte_table(keep: str, lower: bool = True, high: bool = True) -> np.ndarray:
    """256 entries: 0 for bytes between tokens, else the byte (A-Z as a-z)."""
    table = np.zeros(256, np.uint8)
    for c in keep.encode():
        table[c] = c + 32 if lower and 65 <= c <= 90 else c
    if high:
        table[128:] = np.arange(128, 256)
    return table


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: the words of `words.words`: digits, letters and everything beyond ASCII
WORD_BYTES = byte_table("0123456789" + LETTERS)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the row it is in."""
    kinds = WORD_BYTES[data]
    starts, ends, rows = tokens(kinds, offsets)
    return run_hashes(kinds, starts, ends), rows
