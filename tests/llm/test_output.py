import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vouchermill.llm import chat, fixity, huffman, pieces, textbytes as tb, token_files, tokens
from vouchermill.session import shared_folder

from .conftest import prose, twins

public = pytest.importorskip("public_tokenizers")
BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "a  b", "a  <|endoftext|>", "a <|endoftext|> b", " x ", "x   c", "it's  the 's \t\n z\n\n  q", "été  Ûber \x1c\x1d b",
       "中文 x", "😀 😀", "trail  ", "▁x the▁ the", "<s>", "\n\t\x00", "x" * 900]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    texts = ODD + [prose(i, 200) for i in range(20)]
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    coder = tokens.Encoder(BPE)
    for _ in range(2):  # from the library, then from the table
        got = [coder.encode(data, offsets, 2) for _, _, data, offsets in tb.slices(pa.array(texts), 700)]
        flat, sizes = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


@pytest.mark.parametrize("counts", [[0, 5], [1, 1], [1] * 40, [2**i for i in range(40)], [3, 0, 1, 7, 7, 100]])
def test_codes_are_prefix_free_and_short(counts):
    n = np.array(counts)
    lengths = huffman.code_lengths(n)
    code = huffman.codes(lengths)
    used = np.flatnonzero(n)
    assert (lengths[used] > 0).all() and lengths.max() <= 16 and (lengths[n == 0] == 0).all()
    words = sorted(format(code[i], f"0{lengths[i]}b") for i in used)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    if max(counts) < 2**10 and len(used) > 1:  # the limit does not bind: as short as Huffman's own
        import heapq

        heap, total = list(n[used]), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert (lengths[used].astype(int) * n[used]).sum() == total


def test_streams_decode():
    rng = np.random.default_rng(1)
    counts = np.array([1, 255, 256, 257, 2000, 1])
    ids = np.minimum(rng.geometric(0.01, counts.sum()), 3000)
    lengths = huffman.code_lengths(np.bincount(ids))
    data, byte, marks = huffman.encode(ids, counts, lengths, huffman.codes(lengths))
    assert (huffman.decode(data, byte[:-1], counts, marks, huffman.decoding_table(lengths)) == ids).all()
    # a document alone, from its own bytes
    part = data[byte[4] : byte[5]]
    first = (-(-counts[:4] // huffman.EVERY)).sum()
    own = huffman.decode(part, np.array([0]), counts[4:5], marks[first : first + 8], huffman.decoding_table(lengths))
    assert (own == ids[counts[:4].sum() : counts[:5].sum()]).all()


def test_token_files(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(edge_docs, BPE, 2, folder, block_bytes=500)
    got = sorted([tuple(r) for r in token_files.token_report(spark, folder).collect()], key=lambda r: r[1])
    texts = collections.defaultdict(list)
    for r in edge_docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        texts[r.doc_id].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted([d for d, v in texts.items() for _ in v], key=lambda d: -1 if d is None else d)
    at = 0
    for doc, start, n, crc in got:
        assert start == at and (n, crc) in texts[doc]
        texts[doc].remove((n, crc))
        at += n
    assert spark.read.parquet(f"{folder}/blocks").count() > 3
    empty = shared_folder(spark, "tokens")
    token_files.write_token_files(no_docs, BPE, 2, empty)
    assert token_files.token_report(spark, empty).count() == 0


def test_pieces_are_lossless_and_repeatable(spark, edge_docs, no_docs):
    rows = pieces.decode_ids(pieces.encode_texts(edge_docs, PIECES, seed=3), PIECES)
    want = collections.Counter((r.doc_id, r.text or "") for r in edge_docs.collect())
    assert collections.Counter((r.doc_id, r.text) for r in rows.collect()) == want
    one = {(r.doc_id, r.text_sha256): r.ids_crc32 for r in pieces.piece_report(edge_docs, PIECES, seed=3).collect()}
    again = {(r.doc_id, r.text_sha256): r.ids_crc32 for r in pieces.piece_report(edge_docs.repartition(3), PIECES, seed=3).collect()}
    other = {(r.doc_id, r.text_sha256): r.ids_crc32 for r in pieces.piece_report(edge_docs, PIECES, seed=4).collect()}
    assert one == again != other
    assert pieces.piece_report(no_docs, PIECES).count() == 0
    m = pieces.model(PIECES)
    for _, end, data, offsets in tb.slices(pa.array(ODD)):
        ids, counts = m.encode(data, offsets, np.arange(end, dtype=np.uint64))
        assert [t.decode() for t in m.decode(ids, counts)] == ODD


@pytest.mark.parametrize("word", ["the", "étés", "▁"])
def test_sampling_follows_the_weights(word):
    m, n = pieces.model(PIECES, 0.4), 40_000
    segment, ways = (" " + word).encode(), []

    def walk(at, ids, weight):
        if at == len(segment):
            ways.append((tuple(ids), weight))
        lead = segment[at] if at < len(segment) else 0
        width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3
        for end in range(at + 1, len(segment) + 1):
            edge = m.edges.get(segment[at:end])
            if edge:
                walk(end, ids + [edge[0]], weight * edge[1])
        if at < len(segment) and segment[at : at + width] not in m.edges:
            walk(at + width, ids + [int(m.byte_ids[b]) for b in segment[at : at + width]], weight * m.byte_weight)

    walk(0, [], 1.0)
    total, got = sum(w for _, w in ways), collections.Counter()
    for first, end, data, offsets in tb.slices(pa.array([word] * n)):
        ids, counts = m.encode(data, offsets, tb.mix(np.arange(first, end).astype(np.uint64)))
        ends = np.cumsum(counts)
        got.update(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends))
    assert set(got) <= {k for k, _ in ways}
    for k, w in ways:
        share = w / total
        assert got[k] / n == pytest.approx(share, abs=4 * (share * (1 - share) / n) ** 0.5 + 1e-4)


TURNS = "conv_id bigint, turn bigint, role string, text string, window string, n bigint"


def test_chat_windows(spark):
    long = " ".join(["word"] * 400)
    rows = [(1, 0, "system", "Be <kind> [now] \\s"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x " * 90) for i in range(1, 30)]]
    rows += [(2, 0, "user", long), (2, 1, "assistant", long), (2, 2, None, None), (2, 2, None, None), (2, None, "assistant", "early")]
    rows += [(None, 0, "assistant", "</s>[INST] ok [/INST] \\l\\b\\"), (3, 0, "system", "only")]
    df = spark.createDataFrame([r + ("w", 1) for r in rows], TURNS)
    windows = chat.format_windows(df, budget=300, history=60)
    kept = windows.collect()
    assert len([w for w in kept if w.conv_id == 1]) > 5
    for w in kept:
        own = [t for t in w.turns if t.own]
        assert own and (w.n_tokens <= 300 or len(own) == 1 or w.over_budget)
        assert w.over_budget == (w.n_tokens > 300)
        if w.conv_id == 1:
            assert not w.over_budget and w.formatted.startswith("<|system|>\nBe \\lkind>")
            assert w.window == 0 or sum(not t.own for t in w.turns) <= 3
        assert w.formatted.count("<|end|>") == len(w.turns)
        assert "[" not in w.formatted and "</s>" not in w.formatted
    back = collections.defaultdict(list)
    for r in chat.read_back(windows).orderBy("conv_id", "place").collect():
        back[r.conv_id].append((r.role, r.text, r.loss))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (None, 1, 2, 3):
        want = [(r[2] or "", r[3] or "", r[2] == "assistant") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert back[conv] == want
    loss = sum(t.loss for w in kept for t in w.turns)
    assert loss == sum(r[2] == "assistant" for r in rows)
    assert chat.report(chat.format_windows(df.where("false"))).count() == 0


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "\\s", "\\\\l", "<|end|>", "[INST]\\b<", "\\sl", "l\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and "<" not in r.e and "[" not in r.e


PAGES = "page_id bigint, url string, html string, archive string, node string, digest string"


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", "<p>" + prose(i, 30)) for i in range(300)]
    rows += [(None, None, None), (None, "u", "<b>"), (5, "u", "<i>"), (5, "u", "<i>")]
    df = spark.createDataFrame([r + ("a", "b", "c") for r in rows], PAGES)
    same = fixity.build_trees([df, df.repartition(3)], per_archive=50, range_bytes=1000, fan=3)
    assert same[0].levels > 3 and fixity.audit(*same, spark).count() == 0
    damaged = df.withColumn("html", F.when(F.col("page_id") == 77, F.concat(F.lit("?"), F.substring("html", F.lit(2), F.length("html")))).otherwise(F.col("html")))
    damaged = damaged.where("page_id is null or page_id <> 148").unionByName(
        spark.createDataFrame([(299, "new", "<u>", "a", "b", "c")], PAGES)
    )
    trees = fixity.build_trees([df, damaged], per_archive=50, range_bytes=1000, fan=3)
    found = {(r.page_id, r.status) for r in fixity.audit(*trees, spark).collect()}
    assert found - {(299, "altered"), (299, "extra"), (299, "moved")} == {(77, "altered"), (148, "missing"), (149, "moved")}
    assert any(page == 299 for page, _ in found)
    report = {r.archive: r for r in fixity.report(*trees, spark).collect()}
    assert sum(r.n_records for r in report.values()) == len(rows) and report[1].intact and not report[2].intact
    assert report[3].bad_records == "148:missing,149:moved"
    none = df.where("false")
    assert fixity.report(*fixity.build_trees([none, none]), spark).count() == 0


def test_root_covers_every_record(spark):
    rows = [(i, "u", f"<p>{i}") for i in range(40)]
    roots = set()
    for changed in (None, 0, 20, 39):
        df = spark.createDataFrame([(i, u, h + "!" * (i == changed)) for i, u, h in rows], "page_id bigint, url string, html string")
        tree = fixity.build_trees([df], per_archive=7, range_bytes=300, fan=2)[0]
        top = tree.level(spark, tree.levels).collect()
        assert len(top) == 1
        roots.add(top[0].digest)
    assert len(roots) == 4


def test_report_of_added_records_and_archives(spark):
    """Archives that only the right replica has are told, and extra records counted."""
    kind = "page_id bigint, url string, html string"
    left = [(i, f"u{i}", f"body {i}") for i in range(4)]
    right = [*left, (9, "u9", "added"), (25, "u25", "new archive"), (26, "u26", "new archive")]
    trees = fixity.build_trees([spark.createDataFrame(x, kind) for x in (left, right)], per_archive=10)
    rows = {r.archive: r for r in fixity.report(*trees, spark).collect()}
    assert [(a, r.n_records, r.intact, r.n_extra, r.bad_records) for a, r in sorted(rows.items())] == [
        (1, 4, False, 1, "9:extra"), (3, 0, False, 2, "25:extra,26:extra"),
    ]


def test_codes_of_more_ids_than_the_narrow_table_has():
    rng = np.random.default_rng(6)
    ids = np.concatenate([np.arange(100_000), rng.integers(0, 50, 50_000)]).astype(np.uint32)
    counts = np.array([1, 70_000, len(ids) - 70_001])
    lengths = huffman.code_lengths(np.bincount(ids))
    assert lengths.max() > 16 and (2.0 ** -lengths.astype(float)).sum() <= 1
    data, byte, marks = huffman.encode(ids, counts, lengths, huffman.codes(lengths))
    assert (huffman.decode(data, byte[:-1], counts, marks, huffman.decoding_table(lengths)) == ids).all()


def test_runs_of_equal_hash_are_told_apart(monkeypatch):
    a, b = twins(1024)
    data = np.frombuffer((a + b + a + "x").encode(), np.uint8)
    starts, ends = np.array([0, 1024, 2048, 3072]), np.array([1024, 2048, 3072, 3073])
    hashes = tb.run_hashes(data, starts, ends)
    assert hashes[0] == hashes[2] != hashes[1]
    for _ in range(2):
        sample, kind = tb.distinct_runs(data, starts, ends)
        assert kind[0] == kind[2] and len(set(kind.tolist())) == 3 == len(sample)
        assert all(data[starts[sample[k]] : ends[sample[k]]].tobytes() == data[s:e].tobytes() for k, s, e in zip(kind, starts, ends))
        monkeypatch.setattr(tb, "run_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))  # then with one hash for all
