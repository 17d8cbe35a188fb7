"""Length-limited canonical Huffman codes, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: longest code in bits, which is also the index width of the decoding table; more
#: than 2**LONGEST occurring ids make both as wide as they need, up to WIDEST bits
LONGEST, WIDEST = 16, 24
#: ids between two checkpoints
EVERY = 256


def code_lengths(counts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Bits of each id's code; 0 for ids that do not occur. Package-merge."""
    used = np.flatnonzero(counts)
    longest = longest or min(WIDEST, max(LONGEST, (max(len(used), 1) - 1).bit_length()))
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, row = [], weights
    levels.append(np.ones(len(row), bool))
    for _ in range(longest - 1):
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        levels.append(at < len(weights))
    take, bits = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: ascending by length, then id."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    # each code is the one before plus one, widened: sums of shares of the longest code's range
    shares = np.left_shift(1, int(n.max(initial=0)) - n)
    out[order] = (np.cumsum(shares) - shares) >> (int(n.max(initial=0)) - n)
    return out


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For every run of LONGEST bits (or more, if a code has more), the id that it starts with and the bits of its code (id << 5 | bits)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    width = max(LONGEST, int(n.max(initial=0)))
    table = np.repeat(order << 5 | n, np.left_shift(1, width - n))
    return np.concatenate([table, np.zeros((1 << width) - len(table), np.int64)]).astype(np.uint32)


def encode(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, code: np.ndarray):
    """Bit streams of consecutive texts with `counts` ids each (at least one).

    Returns all bytes, the first byte of each text and, for every EVERY-th id of
    a text, its bit offset in the text's stream.
    """
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(counts)
    begin = ends - counts
    total = np.concatenate([[0], np.cumsum(bits)])
    size = (total[ends] - total[begin] + 7) // 8
    byte = np.cumsum(size) - size
    own = np.repeat(total[begin], counts)
    place = total[:-1] - own + np.repeat(8 * byte, counts)
    word = place >> 5
    value = code[ids].astype(np.uint64) << (64 - bits - (place & 31)).astype(np.uint64)
    fresh = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros(int(word[-1]) + 2 if len(word) else 1, np.uint64)
    out[word[fresh]] += np.add.reduceat(value >> np.uint64(32), fresh)
    out[word[fresh] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), fresh)
    within = np.arange(len(ids)) - np.repeat(begin, counts)
    marks = np.flatnonzero(within % EVERY == 0)
    return out.astype(">u4").view(np.uint8), np.append(byte, byte[-1] + size[-1]), (total[:-1] - own)[marks].astype(np.uint32)


def decode(data: np.ndarray, byte: np.ndarray, counts: np.ndarray, marks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids. Every checkpoint starts a segment of its own, and all segments
    are read in step, one table lookup per id."""
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    width = len(table).bit_length() - 1
    index = np.uint32(len(table) - 1)
    segments = -(-counts // EVERY)
    text = np.repeat(np.arange(len(counts)), segments)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)
    size = np.minimum(counts[text] - nth * EVERY, EVERY)
    to = (np.cumsum(counts) - counts)[text] + nth * EVERY
    at = 8 * byte[text] + marks.astype(np.int64)
    order = np.argsort(-size, kind="stable")
    size, to, at = size[order], to[order], at[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))  # segments with more than t ids
        a = at[:live]
        b = a >> 3
        if width <= 16:
            seen = (data[b] << 16 | data[b + 1] << 8 | data[b + 2]) >> (24 - width - (a & 7)).astype(np.uint32) & index
        else:
            seen = (data[b] << 24 | data[b + 1] << 16 | data[b + 2] << 8 | data[b + 3]) >> (32 - width - (a & 7)).astype(np.uint32) & index
        entry = table[seen]
        out[to[:live] + t] = entry >> 5
        a += (entry & 31).astype(np.int64)
    return out
