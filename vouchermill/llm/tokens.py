"""Byte-level BPE ids of texts, with the tokenizers library.

A text is cut before every blank that a word follows, which is where the
library's own splitting always starts a new piece, so the parts can be encoded
apart; each different part is encoded once.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

from vouchermill.llm import textbytes as tb

#: parts that a worker remembers; others are encoded again in each slice
MOST_PARTS, SLOT_BITS = 1_500_000, 22
#: bytes that may follow a cut: ASCII but for blanks and "<" (special tokens), and
#: first bytes of characters of which none is a blank
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = _FOLLOWS[0xC3:0xE0] = _FOLLOWS[0xE4:] = True
_FOLLOWS[0x3C] = False
_BLANK = "\u0120"  # how the vocabulary writes a blank
JOINED = 500


class Encoder:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a blank
        self.opens[[i for piece, i in vocabulary.items() if piece.startswith(_BLANK)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((1 << SLOT_BITS) + 4096, np.uint64)  # a hash table by open addressing
        self.starts = np.zeros(len(self.keys), np.int64)
        self.sizes = np.zeros(len(self.keys), np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = self.known = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands in the table, or the free slot where it would."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] += 1
            key = self.keys[slot[open_]]
            open_ = open_[(key != hashes[open_]) & (key != 0)]
        return slot

    def _keep(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        while len(hashes):
            slot, first = np.unique(self._slots(hashes), return_index=True)
            self.keys[slot], self.starts[slot], self.sizes[slot] = hashes[first], starts[first], sizes[first]
            self.known += len(slot)
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, starts, sizes = hashes[rest], starts[rest], sizes[rest]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each part's. Parts of a blank and then none go to
        the library some hundreds in one string: each starts with the one id that
        opens with a blank."""
        plain = np.array([p[:1] == " " and len(p.split()) == 1 and not p[-1:].isspace() for p in parts])
        some, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = ["".join([parts[k] for k in some[i : i + JOINED]]) for i in range(0, len(some), JOINED)]
        found = self.tokenizer.encode_batch_fast(joined + [parts[k] for k in others], add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.array(list(itertools.chain.from_iterable(ids[: len(joined)])), np.uint32)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(some):
            raise ValueError("the vocabulary joins pieces over blanks")
        sizes = np.zeros(len(parts), np.int64)
        sizes[some] = np.diff(np.append(starts, len(flat)))
        sizes[others] = [len(i) for i in ids[len(joined) :]]
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine] = flat
        out[~mine] = list(itertools.chain.from_iterable(ids[len(joined) :]))
        return out, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and the number of ids of each."""
        n = len(offsets) - 1
        cut = np.zeros(len(data), bool)
        if len(data):
            cut[:-1] = (data[:-1] == 0x20) & _FOLLOWS[data[1:]]
            cut[offsets[1:][offsets[1:] > 0] - 1] = False  # a text's last byte is followed by another text's
            cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes = tb.run_hashes(data, starts, ends) | np.uint64(1)
        slot = self._slots(hashes)
        first, sizes = self.starts[slot], self.sizes[slot]
        lacking = np.flatnonzero(self.keys[slot] != hashes)
        used = self.used
        if len(lacking):
            new, sample, back = np.unique(hashes[lacking], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), lacking[sample]
            ids, size = self._encode_parts([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            while len(self.ids) < used + len(ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[used : used + len(ids)] = ids
            begin = used + np.cumsum(size) - size
            first[lacking], sizes[lacking] = begin[back], size[back]
            if self.known < MOST_PARTS:
                self._keep(new, begin, size)
                self.used += len(ids)
        counts = np.add.reduceat(sizes, np.searchsorted(starts, offsets[:-1])[offsets[1:] > offsets[:-1]]) if len(starts) else sizes
        total = np.zeros(n, np.int64)
        total[offsets[1:] > offsets[:-1]] = counts
        place = np.arange(int(total.sum()))
        source = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + place
        out = np.full(len(place) + n, end, np.uint32)
        out[place + np.repeat(np.arange(n), total)] = self.ids[source]
        return out, total + 1


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder for each file in a worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
