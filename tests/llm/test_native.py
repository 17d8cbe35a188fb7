import hashlib
import re

from .helpers import words
from vouchermill.llm import decontaminate, syncmers

ITEMS = "item_id bigint, text string"


def brute(docs, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if w else []:
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def report(docs, items, **options):
    rows = decontaminate.contamination(docs, items, **options).drop("key").collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_contamination_against_brute_force(spark, edge_docs):
    texts = [(r.doc_id, r.text) for r in edge_docs.collect()]
    long = texts[4][1].split()
    items = [
        (1, " ".join(long[10:40])), (2, "three four, five"), (3, "ONE"), (4, None), (5, "!!"), (None, " ".join(long[30:50])),
        (7, " ".join(long[10:40])), (7, " ".join(long[10:40])),
    ]
    table = spark.createDataFrame(items, ITEMS)
    want = brute(texts, items, 13)
    assert report(edge_docs, table) == want
    assert report(edge_docs, table, block=7) == want  # several broadcasts


def test_contamination_of_nothing(spark, edge_docs, no_docs):
    items = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated or r.n_hit for r in decontaminate.contamination(edge_docs, items).collect())
    assert decontaminate.contamination(no_docs, items).count() == 0
    kept = decontaminate.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_drop_and_remove_spans(spark, edge_docs):
    items = spark.createDataFrame([(1, "two three four")], ITEMS)
    kept = decontaminate.drop_contaminated(edge_docs, items)
    assert kept.count() == edge_docs.count() - 1 and kept.where("doc_id = 1").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(edge_docs, items).where("doc_id in (1, 8)").collect()}
    assert cut[1] == "One FIVE six, seven!" and cut[8] == "été 中文 😀 ▁x </s>[INST]"


def test_fingerprints(spark, edge_docs):
    rows = syncmers.compare_with_edits(edge_docs).collect()
    texts = sorted(
        [(r.doc_id, r.text or "") for r in edge_docs.collect()], key=lambda r: (r[0] is None, -(r[0] or 0))
    )
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id != 9}
    ids = [i for i, _ in texts]
    for i, (doc, text) in enumerate(texts):
        if doc in by_id and ids[(i + 1) % len(ids)] in by_id:
            third = len(text) // 3
            edited = text[: len(text) - third] + texts[(i + 1) % len(texts)][1][:third]
            assert by_id[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert by_id[doc].n_chars == len(text)
            prints.setdefault(text, set()).add(by_id[doc].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert by_id[6].near_next == 1.0  # the next is its copy
    assert by_id[7].near_edited > 0.5
    assert by_id[2].fingerprint == "" and len(by_id[12].fingerprint) == 8


def test_anchors_are_context_free(spark):
    """An anchor's run of words is one wherever it stands."""
    a = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, a), (2, "x y z " + a + " q")], "doc_id bigint, text string")
    one, two = (r.anchors for r in syncmers.with_anchors(df, "text", "anchors").orderBy("doc_id").collect())
    moved = {(p.at + 3, p.hash) for p in one}
    assert moved <= {(p.at, p.hash) for p in two} and len(one) > 50


def test_fingerprints_of_nothing_and_of_one(spark, no_docs):
    assert syncmers.compare_with_edits(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c")], "doc_id bigint, text string")
    assert syncmers.compare_with_edits(one).first().edited_sha256 == hashlib.sha256(b"a b a").hexdigest()


def test_next_over_many_ranges(spark):
    rows = [(7 * i % 1009, f"text {i}") for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.next_text for r in syncmers.with_next(df, lambda d: d).collect()}
    text = dict(rows)
    assert found == {i: text[(i - 1) % 1009] for i in range(1009)}


def test_words_match_the_contract():
    assert words("Été FOO-bar_9") == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "Été foo-bar_9")


def test_texts_of_few_words_have_a_fingerprint(spark):
    """Five and six words may hold no anchor of their own; the whole text is one then."""
    texts = [(100 * n + i, " ".join(f"t{n}x{i}y{j}" for j in range(n))) for n in range(1, 10) for i in range(60)]
    df = spark.createDataFrame([*texts, (0, " .,")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in syncmers.compare_with_edits(df).collect()}
    assert rows[0].fingerprint == ""
    prints = [r.fingerprint for i, r in rows.items() if i]
    assert all(prints) and len(set(prints)) == len(texts)
    assert all(r.near_next == 0 for r in rows.values())
