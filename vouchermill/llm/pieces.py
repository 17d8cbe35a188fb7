"""SentencePiece encoding with sampled segmentations, and lossless decoding.

Each text is a lattice of all the ways to write it in pieces of the model. A
forward pass filters: every place gets the total weight of the ways to reach
it. A backward pass samples one way by those weights. The draws are hashes of
the row's key, the segment's place and the step, so a text gets the same pieces
in every run, on any partitioning; another seed gives another sample.

The weight of a piece falls with its rank in the model as (rank + 3) ** -alpha:
a model made by merging has ranks, not probabilities, and its ranks follow its
frequencies. A large alpha approaches the single best way.

No piece has a blank after another character, so a text is cut before each run
of blanks; a different segment's lattice is made once for a slice of rows, and all lattices of a slice together.

Defined cases: a null text is an empty one and has no pieces; characters that
the model lacks, and the mark that it writes for a blank, become byte pieces,
so every text decodes to itself; rows with equal id and text get equal pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchermill.llm import batches, textbytes as tb

ALPHA = 1.0
_SLOT_BITS = 20
_MARK = "▁"  # how the model writes a blank


class Model:
    """Pieces of a model file as bytes, with a blank for the model's mark."""

    def __init__(self, file: str, alpha: float = ALPHA):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=file)
        n = reader.get_piece_size()
        self.alpha = alpha
        self.bytes_of = [b""] * n
        self.edges: dict[bytes, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int64)
        rank = 0
        for i in range(n):
            if reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i):
                continue
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
                continue
            raw = piece.replace(_MARK, " ").encode()
            self.bytes_of[i] = raw
            self.edges[raw] = (i, (rank + 3.0) ** -alpha)
            rank += 1
        self.byte_weight = (rank + 3.0) ** -alpha
        self.longest = max(map(len, self.edges))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of])
        self.first = np.cumsum(self.size) - self.size
        self._index()

    def _index(self) -> None:
        """A hash table of all beginnings of pieces: slot -> entry."""
        starts = sorted({raw[:k] for raw in self.edges for k in range(1, len(raw) + 1)})
        data = np.frombuffer(b"".join(starts), np.uint8)
        size = np.array([len(b) for b in starts])
        end = np.cumsum(size)
        self.hashes = np.append(tb.run_hashes(data, end - size, end), np.uint64(0))
        self.piece = np.array([self.edges.get(b, (-1, 1.0))[0] for b in starts], np.int32)
        self.weight = np.log([self.edges.get(b, (-1, 1.0))[1] for b in starts])
        self.slots = np.full((1 << _SLOT_BITS) + 64, -1, np.int32)
        at = (self.hashes[:-1] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64).tolist()
        for entry, slot in enumerate(at):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = entry

    def _entries(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        entry = self.slots[slot]
        open_ = np.flatnonzero((entry >= 0) & (self.hashes[entry] != hashes))
        while len(open_):
            slot[open_] += 1
            entry[open_] = self.slots[slot[open_]]
            open_ = open_[(entry[open_] >= 0) & (self.hashes[entry[open_]] != hashes[open_])]
        return entry

    def _edges(self, body: np.ndarray, limit: np.ndarray):
        """Start, end, piece and log weight of every edge over segments that lie one
        after another in `body`; limit[i] is the end of the segment of byte i."""
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * tb.powers(len(body)), out=sums[1:])
        back = tb.inverse_powers(len(body) + 1)
        chars = np.flatnonzero((body & 0xC0) != 0x80)
        lead = body[chars]
        width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        wide = np.zeros(len(body), np.int64)
        wide[chars] = width
        lacking = np.ones(len(body), bool)
        found, at = [], chars
        for n in range(1, self.longest + 1):
            at = at[at + n <= limit[at]]
            if not len(at):
                break
            entry = self._entries(tb.mix((sums[at + n] - sums[at]) * back[at] + tb.length_salt(n)))
            at, entry = at[entry >= 0], entry[entry >= 0]
            whole = self.piece[entry] >= 0
            a, e = at[whole], entry[whole]
            found.append((a, a + n, self.piece[e], self.weight[e]))
            lacking[a[wide[a] == n]] = False
        odd = chars[lacking[chars]]  # characters as bytes: the first has the weight
        n = wide[odd]
        place = np.repeat(odd - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = np.where((body[place] & 0xC0) != 0x80, np.log(self.byte_weight), 0.0)
        found.append((place, place + 1, self.byte_ids[body[place]].astype(np.int32), weight))
        return [np.concatenate(x) for x in zip(*found)]

    def encode(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts, and how many each has. An empty text has none."""
        n_rows = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
        # every text gets the blank that the model puts first; segments start at runs of blanks
        text = np.insert(data, offsets[full], 0x20)
        begin = offsets[full] + np.arange(len(full))
        cut = text == 0x20
        cut[1:] &= text[:-1] != 0x20
        cut[begin] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(text))
        text_of = np.searchsorted(begin, start, "right") - 1
        row, nth = full[text_of], np.arange(len(start)) - np.searchsorted(start, begin)[text_of]
        sample, kind = tb.distinct_runs(text, start, stop)
        # the different segments one after another; place i of a segment is the end of its byte i
        size = (stop - start)[sample]
        ends = np.cumsum(size)
        body = text[np.repeat(start[sample] - (ends - size), size) + np.arange(ends[-1])]
        first, last, piece, weight = self._edges(body, np.repeat(ends, size))
        origin = np.repeat(ends - size, size)
        level = last - origin[last - 1]  # edges by the length of the way to their end, then by place
        order = np.argsort(level << 40 | last, kind="stable")
        first, last, piece, weight, level = first[order], last[order], piece[order], weight[order], level[order]
        fresh = np.flatnonzero(np.append(True, last[1:] != last[:-1]))  # the first edge of each place
        node = np.full(len(body) + 1, -1)
        node[last[fresh]] = np.arange(len(fresh))
        # forward filtering, in logarithms, for all segments a level at a time
        reach = np.zeros(len(body) + 1)
        from_start = first == origin[first]
        cuts = np.searchsorted(level[fresh], np.arange(1, int(level[-1]) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            e0, e1 = fresh[a], fresh[b] if b < len(fresh) else len(last)
            ways = weight[e0:e1] + np.where(from_start[e0:e1], 0.0, reach[first[e0:e1]])
            here = fresh[a:b] - e0
            most = np.maximum.reduceat(ways, here)
            n = np.diff(np.append(here, e1 - e0))
            reach[last[fresh[a:b]]] = most + np.log(np.add.reduceat(np.exp(ways - np.repeat(most, n)), here))
            weight[e0:e1] = ways
        share = np.exp(weight - reach[last])
        total = np.cumsum(share)
        per_node = np.diff(np.append(fresh, len(last)))
        running = total - np.repeat(total[fresh] - share[fresh], per_node)
        running /= np.repeat(running[np.append(fresh[1:], len(last)) - 1], per_node)
        running[np.append(fresh[1:], len(last)) - 1] = 2.0  # a draw never passes a place's last edge
        # backward sampling, all segments a step at a time
        seed = tb.mix(seeds[row] + tb.mix(nth.astype(np.uint64) + np.uint64(0x2545F491)))
        left = (ends - size)[kind]
        where, live, step, drawn = ends[kind], np.arange(len(kind)), 0, []
        while len(live):
            draw = tb.mix(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)
            u = draw.astype(np.float64) * 2.0**-53
            edge = fresh[node[where]]
            later = np.flatnonzero(running[edge] <= u)
            while len(later):
                edge[later] += 1
                later = later[running[edge[later]] <= u[later]]
            drawn.append((live, piece[edge]))
            where = first[edge]
            more = where > left[live]
            live, where = live[more], where[more]
            step += 1
        n = np.zeros(len(kind), np.int64)
        for k, (at, _) in enumerate(drawn):
            n[at] = k + 1
        end = np.cumsum(n)
        out = np.zeros(int(end[-1]), np.int32)
        for k, (at, ids) in enumerate(drawn):
            out[end[at] - 1 - k] = ids
        return out, np.bincount(row, weights=n, minlength=n_rows).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of rows with `counts` ids each."""
        size = self.size[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        raw = self.flat[at].tobytes()
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        begins = np.append(0, ends[:-1])
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(begins.tolist(), ends.tolist())]


#: bytes of text whose lattices are built at once
SLICE = 1 << 18
_models: dict[tuple, Model] = {}


def model(file: str, alpha: float = ALPHA) -> Model:
    if (file, alpha) not in _models:
        _models[file, alpha] = Model(file, alpha)
    return _models[file, alpha]


def _encoded(stream: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id, seed and text."""
    for batch in stream:
        seeds = batch.column(1).to_numpy().view(np.uint64)
        for first, end, data, offsets in tb.slices(batch.column(2), SLICE):
            ids, counts = m.encode(data, offsets, seeds[first:end])
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(ends, pa.array(ids))], ["doc_id", "ids"]
            )


def _seeded(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("seed"), "text")


def encode_texts(docs: DataFrame, file: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, ids (array<int>)."""
    batches.for_texts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(stream, model(file, alpha))

    return _seeded(docs, seed).mapInArrow(batches.tidy(encoded), f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, file: str) -> DataFrame:
    """Rows of `encode_texts` with the text that their ids stand for."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column(1)
                counts = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                texts = m.decode(ids.flatten().to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(batches.tidy(decoded), f"doc_id {kind}, ids array<int>, text string")


def piece_report(docs: DataFrame, file: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, ids_crc32 (of little-endian
    32-bit ids), text_sha256 (of the text decoded from the ids)."""
    batches.for_texts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(file)
        # encoded and read back in one worker, which is half the workers of `encode_texts` and a reader of its rows
        for batch in _encoded(stream, model(file, alpha)):
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column(1)
                counts = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                flat = ids.flatten().to_numpy()
                raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                sums = [crc32(raw[e - 4 * c : e]) for c, e in zip(counts.tolist(), ends)]
                digests = [hashlib.sha256(t).hexdigest() for t in m.decode(flat, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), ids, pa.array(sums, pa.int64()), pa.array(digests, pa.string())],
                    ["doc_id", "n_pieces", "ids", "ids_crc32", "text_sha256"],
                )

    return _seeded(docs, seed).mapInArrow(batches.tidy(told), f"doc_id {kind}, n_pieces bigint, ids array<int>, ids_crc32 bigint, text_sha256 string")
