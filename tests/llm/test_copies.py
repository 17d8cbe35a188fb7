import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from vouchermill.llm import jaccard, suffixes
from vouchermill.llm.components import components
from vouchermill.llm.merge import Run, common, merge_runs

from .conftest import prose, twins
from .helpers import words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(rows):
    """(links, component's least id) of each row, by its position."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) if sets[i] and sets[j] else (rows[i][1] or "") == (rows[j][1] or "") and not sets[i] and not sets[j]
            if alike:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    ids = {k: min([d for d in v if d is not None], default=None) for k, v in least.items()}
    return [(doc, links[i], ids[find(i)]) for i, (doc, _) in enumerate(rows)]


def near_rows():
    rng, rows, n = random.Random(3), [], 0
    for group in range(12):
        base = prose(100 + group, 120).split()
        for copy in range(rng.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def found_links(df, **options):
    return sorted([(r.doc_id, r.n_links, r.class_id) for r in jaccard.near_classes(df, **options).collect()], key=str)


def test_links_against_brute_force(spark, edge_docs):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_links(df) == sorted(brute_links(rows), key=str)
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert found_links(edge_docs) == sorted(brute_links(edge), key=str)


def test_blocks_lose_no_link(spark, monkeypatch):
    """Groups cut into many pairs of blocks give the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_links(df) == sorted(brute_links(rows), key=str)


def test_keep_one(spark, edge_docs, no_docs):
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    classes = {c for _, _, c in brute_links(rows)}
    assert len(got) == len(classes) + 1  # two texts share the id 9
    assert (6, rows[5][1]) not in got and (5, rows[4][1]) in got
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.near_classes(no_docs).count() == 0


def test_pruning_rule():
    enough = jaccard.least_agreeing(0.8, 128, 1e-6)
    assert list(enough) == list(range(16, 129, 16))
    assert all(0 < m < 0.8 * n for n, m in enough.items() if n >= 32)
    assert enough[128] / 128 > enough[32] / 32  # more is asked the more is known


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {200 + i: 200 for i in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_merge_of_runs():
    rng = random.Random(2)
    assert common(b"a" * 70 + b"b", b"a" * 70 + b"c", 3) == 70
    for n in (1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(n):
            items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"t") for _ in range(rng.randint(0, 30)))
            keys = [k for k, _ in items]
            runs.append(Run(keys, [t for _, t in items], [common(a, b, 0) for a, b in zip([b"", *keys], keys)]))
        out = list(merge_runs(runs))
        keys = [runs[r].keys[i] for r, i, _ in out]
        assert keys == sorted(k for r in runs for k in r.keys)
        assert all(s == common(a, b, 0) for a, b, (_, _, s) in zip(keys, keys[1:], out[1:]))


def brute_cut(rows, length):
    count = collections.Counter()
    for _, b in rows:
        count.update(b[w : w + length] for w in range(len(b) - length + 1))
    out = []
    for doc, b in rows:
        mark = bytearray(len(b))
        for w in range(len(b) - length + 1):
            if count[b[w : w + length]] > 1:
                mark[w : w + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((doc, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cuts(df, length):
    return sorted([tuple(r) for r in suffixes.report_repeats(df, length).collect()], key=str)


def test_cuts_against_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(5)
    parts = ["ab", "ba", "aaa", "b", "é", "abba", "c d"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 30), (104, rows[5][1]), (105, "q" * 15 + rows[7][1] + "z" * 15)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    raw = [(i, (t or "").encode()) for i, t in rows]
    for length in (12, 40):
        assert cuts(df, length) == brute_cut(raw, length)
    edge = [(r.doc_id, (r.text or "").encode()) for r in edge_docs.collect()]
    assert cuts(edge_docs, 200) == brute_cut(edge, 200)
    assert suffixes.report_repeats(no_docs).count() == 0


def test_many_runs_agree(spark, monkeypatch):
    """Small runs, many partitions: what one run cannot see, the merge does."""
    monkeypatch.setattr(suffixes, "RUN_BYTES", 2000)
    passage = prose(50, 60)
    rows = [(i, prose(200 + i, 20) + passage + prose(300 + i, 20)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert cuts(df, 100) == brute_cut([(i, t.encode()) for i, t in rows], 100)


def test_removal_keeps_columns(spark, edge_docs):
    kept = suffixes.remove_repeats(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    texts = {r.doc_id: r.text for r in kept.where("doc_id in (1, 2, 5)").collect()}
    assert texts[1] == "One two three. Four FIVE six, seven!" and texts[2] is None and texts[5] == ""


def test_anchors_cover_all_windows():
    data = np.frombuffer((prose(8, 300) + "a" * 400).encode(), np.uint8)
    offsets = np.array([0, 500, 500, 640, len(data)])
    _, place, start, last, _ = suffixes.anchors(data, offsets, 200)
    windows = [w for a, b in zip(offsets[:-1], offsets[1:]) for w in range(a, b - 199)]
    assert [w for a, b in zip(start, last) for w in range(a, b + 1)] == windows
    assert all(a <= p <= b + 200 - 24 for p, a, b in zip(place, start, last))


def test_shingles_of_slices():
    texts = [prose(i, n) for i, n in enumerate([0, 1, 4, 5, 6, 50])]
    from vouchermill.llm import textbytes as tb

    for _, _, data, offsets in tb.slices(pa.array(texts)):
        row, _ = jaccard.shingles(data, offsets)
        assert np.bincount(row, minlength=6).tolist() == [len(shingle_set(t)) for t in texts]


def test_isolated_pairs_are_all_found(spark):
    """A pair that meets in any bucket is compared, whatever single bytes agree before."""
    rng, rows, want = random.Random(9), [], 0
    for pair in range(6000):
        base = [f"p{pair}w{i}" for i in range(84)]  # 80 shingles
        cut = rng.choice([8, 7, 6, 4, 2])  # of each text's 80: similarity 0.82 to 0.95
        other = [f"q{pair}w{i}" if i >= 84 - cut else w for i, w in enumerate(base)]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
        want += 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    found = jaccard.near_classes(df)
    assert found.where("n_links = 1 and class_id = doc_id - doc_id % 2").count() == want


def shared_passage_rows(n):
    """Texts round one passage: no two have the same edges, some share a longer head or tail."""
    passage = prose(70, 30)
    return [(i, prose(1000 + i // 2, 12) + passage + prose(5000 + i // 3, 12) + f" {i}") for i in range(n)]


def test_groups_in_slices_against_brute_force(spark, monkeypatch):
    """Groups of one gram cut into slices and parts dealt to tasks by run give the same cuts."""
    monkeypatch.setattr(suffixes, "RUN_BYTES", 3000)
    rows = shared_passage_rows(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_cut([(i, t.encode()) for i, t in rows], 100)
    for window_bytes, part_bytes in ((500, 64 << 20), (4 << 20, 1000), (500, 1000)):
        monkeypatch.setattr(suffixes, "WINDOW_BYTES", window_bytes)
        monkeypatch.setattr(suffixes, "MOST_PART_BYTES", part_bytes, raising=False)
        assert cuts(df, 100) == want


def test_no_group_is_compared_as_a_whole(monkeypatch):
    """What is compared at once stays near WINDOW_BYTES, however many texts share a passage."""
    from types import SimpleNamespace

    from vouchermill.llm import textbytes as tb

    monkeypatch.setattr(suffixes, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(suffixes._write_run, "number", 0, raising=False)
    judge, sizes = suffixes._judge, []
    monkeypatch.setattr(suffixes, "_judge", lambda m, x: sizes.append(sum(len(e[0]) + len(e[1]) for e in m)) or judge(m, x))
    passage, entries = prose(71, 60), []
    own = lambda i: hashlib.sha512(str(i).encode()).hexdigest()
    texts = pa.array([own(i) + own(-i) + passage + own(i + 0.5) + own(-i - 0.5) for i in range(60_000)])
    for _, _, data, offsets in tb.slices(texts):
        row, place, start, last, hashes = suffixes.anchors(data, offsets, 200)
        hot = np.isin(hashes, [h for h, n in collections.Counter(hashes.tolist()).items() if n > 100])
        row, place, start, last, hashes = (x[hot] for x in (row, place, start, last, hashes))
        n = last + 200 - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        entries.append((np.zeros(len(row), "V16"), start, place - start, last + 200 - place, hashes, data[at]))
    rows = suffixes._write_run(entries, 200, 1).to_pylist()
    assert len(list(suffixes._merged(rows, 200))) and max(sizes) < 2.1 * suffixes.WINDOW_BYTES


def test_hashes_of_slices_tell_regular_strings_apart():
    """Windows that a sum of powers modulo 2**64 would take for one; equal ones agree in any slice."""
    a, b = (t.encode() for t in twins(2048))
    rng = random.Random(4)
    texts = [a, b, *(bytes(rng.choice(b"ab") for _ in range(2048)) for _ in range(5))]
    members = [suffixes.Member(t[:1000], t[1000:], 0, [(0, i)], 0) for i, t in enumerate(texts)]
    for base in (2**59 + 12345, 2**60 + 7):
        hashes = suffixes._Hashes(members, base, 1024)
        got = {}
        for place in range(0, 1025, 16):
            for i, h in enumerate(hashes.at(np.arange(len(texts)), np.full(len(texts), place), 1024).tolist()):
                got.setdefault(h, set()).add(texts[i][place : place + 1024])
        assert all(len(strings) == 1 for strings in got.values())
        want = sum(texts[0][1024 + i] * 0 + (c + 1) * pow(base, i, 2**61 - 1) for i, c in enumerate(texts[0][:1024]))
        assert hashes.at(np.array([0]), np.array([0]), 1024)[0] == want * pow(base, 2048, 2**61 - 1) % (2**61 - 1)


def test_many_equal_rows_keep_their_spans_once(spark):
    """A third of all rows with one id and text: as many spans as one of them has."""
    text = prose(31, 60)
    rows = [(None, text)] * 2000 + [(i, prose(400 + i, 40)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    spans = suffixes.repeated_spans(df).collect()
    assert len(spans) == 1 and len(spans[0].spans) <= len(text.encode())
    assert len({(s.start, s.end) for s in spans[0].spans}) == len(spans[0].spans)
    got = cuts(df, 200)
    assert [r for r in got if r[0] is None] == [(None, len(text.encode()), len(text.encode()), 1, hashlib.sha256(b"").hexdigest())] * 2000
    assert sum(r[2] for r in got if r[0] is not None) == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than a piece: no window is lost where pieces meet."""
    texts = [prose(60, 400), prose(61, 400)]
    rows = [(0, texts[0] + texts[1]), (1, texts[1][500:900] + texts[0][300:2000]), (2, prose(62, 500)), (3, "short")]
    want = [w for _, t in rows for w in range(max(0, len(t.encode()) - 199))]
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    seen = []
    for first, end, data, offsets, base in suffixes.pieces(pa.array([t for _, t in rows]), 200):
        row, _, start, last, _ = suffixes.anchors(data, offsets, 200)
        seen += [w - offsets[r] + base for r, a, b in zip(row, start, last) for w in range(a, b + 1)]
    assert seen == want
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert cuts(df, 200) == brute_cut([(i, t.encode()) for i, t in rows], 200)


def test_columns_of_any_name_stay(spark):
    long = prose(41, 80)
    names = ["key", "spans", "__key", "__spans", "first_id", "first_text", "rows_like_first", "__id", "__text", "__same"]
    rows = [(1, long, *map(str, range(10))), (2, long, *map(str, range(10, 20))), (3, prose(42, 80), *["x"] * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    kept = suffixes.remove_repeats(df)
    assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {r[2:] for r in rows}
    one = jaccard.keep_one(df)
    assert one.columns == df.columns and {tuple(r) for r in one.collect()} == {rows[0], rows[2]}
