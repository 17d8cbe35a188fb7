"""Token ids in files: canonical length-limited Huffman codes of ids from their
global counts, decoded by table in independent blocks.

Format (a folder of Parquet tables, so that any store Spark writes to can hold
it): `codebook` has the code length of each id; `blocks` has one row per block
of consecutive documents in ascending doc_id order, as
  file, block       the file's number in the order of ids, the block's in the file
  doc_id, n_tokens  of the block's documents
  first_byte        where each document's bit stream starts in `payload`
  marks             the bit offset of every EVERY-th id of each document in its stream
  payload           the streams, each from a whole byte on
Lengths alone define the canonical code. A block needs nothing but the codebook.

Defined cases: a null text is an empty one and gets the end id alone; rows that
repeat are written again; null ids come first, equal ids in the order of their
texts' hashes; an empty table makes an empty folder of blocks; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vouchermill.llm import batches, huffman, textbytes as tb
from vouchermill.llm.tokens import encoder
from vouchermill.session import shared_folder

#: bytes of streams in a block; a longer document makes a block of its own
BLOCK_BYTES = 1 << 18
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _lists(values: np.ndarray, sizes: np.ndarray, kind=None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, tie (hash of the text) and ids, as little-endian 16-bit numbers where
    they fit, else 32-bit. Every task adds a row without ids: in `counts`, how
    often each id occurs in its rows (pairs of 64-bit numbers)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_file)
        vocabulary = max(len(coder.opens), end_id + 1)
        width, total = "<u2" if vocabulary <= 1 << 16 else "<u4", np.zeros(vocabulary, np.int64)
        for batch in batches:
            for first, end, data, offsets in tb.slices(batch.column(2)):
                ids, counts = coder.encode(data, offsets, end_id)
                total += np.bincount(ids, minlength=vocabulary)
                raw, size = ids.astype(width), int(width[-1])
                ends = np.concatenate([[0], np.cumsum(counts)]) * size
                blobs = pa.Array.from_buffers(
                    pa.large_binary(), end - first, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
                ).cast(pa.binary())
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.full(end - first, size, np.int32)), blobs, pa.nulls(end - first, pa.binary())],
                    ["doc_id", "tie", "width", "ids", "counts"],
                )
        used = np.flatnonzero(total)
        row = {"doc_id": None, "tie": 0, "width": int(width[-1]), "ids": None, "counts": np.stack([used, total[used]]).tobytes()}
        yield pa.RecordBatch.from_pylist([row], pa.schema([
            ("doc_id", _KINDS[kind]), ("tie", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())
        ]))

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, tie bigint, width int, ids binary, counts binary")


def _ids(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch, about SLICE bytes at a time, with all their ids and the number of each."""
    blobs = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
    width = batch.column(batch.schema.get_field_index("width"))[0].as_py() if batch.num_rows else 2
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    first = 0
    while first < len(blobs):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + tb.SLICE, "right")) - 1)
        end = min(end, len(blobs))
        raw = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[first] : offsets[end]]
        ids = np.frombuffer(raw.tobytes(), f"<u{width}").astype(np.int64)
        yield batch.slice(first, end - first), ids, np.diff(offsets[first : end + 1]) // width
        first = end


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows, from the counts of the tasks."""
    total = np.zeros(1, np.int64)
    for row in tokens.where("counts is not null").select("counts").toLocalIterator():  # a row of a task at a time
        ids, n = np.frombuffer(row.counts, np.int64).reshape(2, -1)
        if len(ids) and ids[-1] >= len(total):
            total = np.append(total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64))
        total[ids] += n
    return total


def write_token_files(
    docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, block_bytes: int = BLOCK_BYTES
) -> None:
    """Encode all texts and write `folder`/codebook and `folder`/blocks."""
    spark = docs.sparkSession
    batches.for_texts(spark)
    held = shared_folder(spark, "token-ids")
    tokenise(docs, tokenizer_file, end_id).write.option("compression", "zstd").parquet(held)
    tokens = spark.read.parquet(held)
    lengths = huffman.code_lengths(count_ids(tokens))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id bigint, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((lengths, huffman.codes(lengths)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, code = shared.value
        for batch in batches:
            for own, ids, counts in _ids(batch):
                data, byte, marks = huffman.encode(ids, counts, bits, code)
                raw = data.tobytes()
                streams = [raw[a:b] for a, b in zip(byte[:-1], byte[1:])]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(counts), _lists(marks.astype(np.int64), -(-counts // huffman.EVERY), pa.int32()),
                     pa.array(streams, pa.binary())],
                    ["doc_id", "tie", "n_tokens", "marks", "stream"],
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out():
            sizes = np.array([len(r["stream"]) for r in held])
            return pa.RecordBatch.from_pylist(
                [{
                    "file": file, "block": block, "doc_id": [r["doc_id"] for r in held],
                    "n_tokens": [r["n_tokens"] for r in held], "first_byte": (np.cumsum(sizes) - sizes).tolist(),
                    "marks": [m for r in held for m in r["marks"]], "payload": b"".join(r["stream"] for r in held),
                }], schema,
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and size + len(row["stream"]) > block_bytes:
                    yield out()
                    held, size, block = [], 0, block + 1
                held.append(row)
                size += len(row["stream"])
        if held:
            yield out()

    schema = pa.schema([
        ("file", pa.int32()), ("block", pa.int32()), ("doc_id", pa.list_(_KINDS[kind])), ("n_tokens", pa.list_(pa.int64())),
        ("first_byte", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("payload", pa.binary()),
    ])
    rows = tokens.where("ids is not null").select("doc_id", "tie", "width", "ids")
    streams = rows.mapInArrow(coded, f"doc_id {kind}, tie bigint, n_tokens bigint, marks array<int>, stream binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = streams.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        packed,
        f"file int, block int, doc_id array<{kind}>, n_tokens array<bigint>, first_byte array<bigint>, marks array<int>, payload binary",
    )
    # streams hardly compress any further
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, emit, columns: str) -> DataFrame:
    """Decode all blocks. `emit(ids, n_tokens)` gives the columns (arrays) for the
    documents of a block from their ids; the result also has file, block,
    place (of the document in its block), doc_id and n_tokens."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # a row per id of the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(huffman.decoding_table(lengths))
    rows = spark.read.parquet(f"{folder}/blocks")
    kind = rows.schema["doc_id"].dataType.elementType.simpleString()
    names = ["file", "block", "place", "doc_id", "n_tokens", *[c.split()[0] for c in columns.split(",")]]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            for i in range(batch.num_rows):
                counts = col("n_tokens")[i].values.to_numpy()
                data = np.frombuffer(col("payload")[i].as_buffer(), np.uint8)
                ids = huffman.decode(data, col("first_byte")[i].values.to_numpy(), counts, col("marks")[i].values.to_numpy(), table)
                n = len(counts)
                head = [np.full(n, col("file")[i].as_py(), np.int32), np.full(n, col("block")[i].as_py(), np.int32), np.arange(n, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, head), col("doc_id")[i].values, pa.array(counts), *map(pa.array, emit(ids, counts))], names
                )

    return rows.mapInArrow(decoded, f"file int, block int, place int, doc_id {kind}, n_tokens bigint, {columns}")


def _checksums(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    raw = ids.astype("<u4").tobytes()
    ends = np.cumsum(counts) * 4
    sums = [crc32(raw[a:b]) for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]
    return [np.cumsum(counts) - counts, np.array(sums, np.int64)]


def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("file", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_file"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before_block"))
    starts = blocks.join(files, "file")
    rows = read_token_files(spark, folder, _checksums, "inside bigint, ids_crc32 bigint")
    rows = rows.join(starts, ["file", "block"])
    start = F.col("before_file") + F.col("before_block") + F.col("inside")
    return rows.select("doc_id", start.cast("bigint").alias("start"), "n_tokens", "ids_crc32")
