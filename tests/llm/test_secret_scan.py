import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from vouchermill.llm import secret_scan as scan

LETTERS = "abcdefghijklmnopqrstuvwxyz"
FORMS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
)
SETS = ("[0-9a-fA-F]+", "[0-9A-Za-z]+", "[0-9A-Za-z+/=_-]+")


def plain(text):
    """Spans of a text, every window counted anew."""
    text, found, off = text or "", [], 0
    for k, (kind, pattern, group, least) in enumerate(FORMS):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    for k, (c, pattern) in enumerate(zip(scan.CLASSES, SETS)):
        for m in re.finditer(pattern, text):
            runs = []
            for i in range(m.start(), m.end() - c.window + 1):
                counts = collections.Counter(text[i : i + c.window]).values()
                if -sum(n / c.window * math.log2(n / c.window) for n in counts) >= c.bits:
                    if runs and i - runs[-1][1] <= 0:
                        runs[-1][1] = i + c.window
                    else:
                        runs.append([i, i + c.window])
            allowed = any(re.fullmatch(p, m[0]) for p in scan.ALLOWED_WHOLE) or any(re.search(p, m[0]) for p in scan.ALLOWED_PART)
            off += len(runs) if allowed else 0
            found += [] if allowed else [(a, k + 3, b, c.name) for a, b in runs]
    return [(kind, a, b) for a, _, b, kind in sorted(found)], off


def texts():
    rng = random.Random(3)

    def key(n, of=LETTERS + LETTERS.upper() + "0123456789"):
        return "".join(rng.choice(of) for _ in range(n))

    hexes = "0123456789abcdef"
    out = [
        None, "", " ", f"token = \"{key(40, hexes)}\" é", f"é中😀 API_KEY:'{key(12)}' PassWord  =  {key(9)}", "token:token = abcdef", "token: abc token=abcdefg",
        "AKIA" + key(16, "ABCDEFGHIJ0123456789"), "xAKIAKIA" + key(15, "QRSTUV01"), "AKIA" + key(15, "QRSTUV01") + " AKIA", key(24, hexes) + "é" + key(23, hexes),
        "ſecret: abcdefgh toKen = abcdefgh", f"{key(8, hexes)}-{key(4, hexes)}-{key(4, hexes)}-{key(4, hexes)}-{key(12, hexes)}",
        "abcdefghijklmnopqrstuvwxyz0123456789ABCDEF", "some_long-identifier_of/many-words_here" * 3, "x" * 5000, key(30) + "EXAMPLE" + key(30), "secret=" + "\x00" * 3,
        key(3000), key(200, LETTERS + "+/=_-"), " ".join(key(rng.randint(1, 60)) for _ in range(50)), "a" * 40 + key(25) + "b" * 40 + key(45) + "c" * 30,
    ]
    return out + out[3:6]


def as_plain(rows):
    return {r.doc_id: ([tuple(s) for s in r.spans], r.n_suppressed) for r in rows}


def test_spans_equal_plain_form(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: plain(t) for i, t in rows}
    assert as_plain(scan.secret_spans(docs).collect()) == want
    assert {k for spans, _ in want.values() for k, _, _ in spans} == {*scan.BASE_KINDS, *(c.name for c in scan.CLASSES)}
    got = {r.doc_id: r for r in scan.report(scan.secret_spans(docs)).collect()}
    for i, (spans, off) in want.items():
        base = [s for s in spans if s[0] in scan.BASE_KINDS]
        text = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        assert (got[i].spans, got[i].base_sha256) == (text(spans), hashlib.sha256(text(base).encode()).hexdigest())
        assert [got[i][f"n_{k}"] for k in scan.BASE_KINDS] == [sum(s[0] == k for s in base) for k in scan.BASE_KINDS]
        assert got[i].n_suppressed == off


def test_a_short_value_takes_the_name_in_it():
    spans, _ = plain("token:token = abcdef")
    assert spans == []


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_pieces_of_long_candidates(monkeypatch, piece):
    monkeypatch.setattr(scan, "PIECE", piece)
    text = "".join(random.Random(piece).choices("0123456789abcdef" + "0" * 8, k=400))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 150, 150, 400])
    row, start, end, _, _ = scan.entropy_spans(data, offsets, scan.CLASSES[0])
    want = []
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        want += [(i, x + a, y + a) for k, x, y in plain(text[a:b])[0] if k == "entropy_hex"]
    assert sorted(zip(row.tolist(), start.tolist(), end.tolist())) == want and want


def test_allow_list_and_redaction(spark):
    own = "Zx81Qm4Lk09TtVvB37nnPqR5"
    docs = spark.createDataFrame([(1, f"a {own} b", "u"), (2, None, "v"), (3, "token = deadbeefdeadbeefdeadbeef01 é", "w")], "doc_id int, text string, spans string")
    assert scan.secret_spans(docs).where("doc_id = 1").first().spans[0].kind == "entropy_alnum"
    first = scan.secret_spans(docs, allowed=[own]).where("doc_id = 1").first()
    assert first.spans == [] and first.n_suppressed == 1
    assert {r.doc_id: (r.text, r.spans) for r in scan.redact(docs).collect()} == {
        1: ("a [entropy_alnum] b", "u"), 2: (None, "v"), 3: ("[assign] é", "w"),
    }


def test_edges(spark, edge_docs, no_docs):
    rows = edge_docs.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), [tuple(s) for s in r.spans], r.n_suppressed) for r in scan.secret_spans(edge_docs).collect())
    assert got == sorted(((r.doc_id is None, r.doc_id or 0), *plain(r.text)) for r in rows)
    assert scan.report(scan.secret_spans(no_docs)).count() == 0 and scan.redact(no_docs).count() == 0
    assert scan.redact(edge_docs).columns == edge_docs.columns
