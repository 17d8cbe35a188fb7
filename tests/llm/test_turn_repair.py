import hashlib
import random
import re
import zlib

import pytest

from vouchermill.llm import edit_lattice as lattice, turn_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def plain(rows, marks):
    """Least (cost, audit, turns) by a table over rows and states, from the end."""
    after = {q: (0, "", ()) if q in (0, 3) else None for q in range(4)}

    def with_insertions(best):
        for _ in range(3):
            for q in range(4):
                for role in ("user", "assistant"):
                    then = best.get(NEXT.get((q, role[0])))
                    if then:
                        new = (then[0] + 3, "I" + then[1], ((role, ""),) + then[2])
                        best[q] = min(filter(None, (best[q], new)), key=lambda z: z[:2])
        return best

    after = with_insertions(after)
    for (_, _, role, text), mark in reversed(list(zip(rows, marks))):
        best = {}
        for q in range(4):
            ways = [(4, "D", q, ())]
            if mark not in ("blank", "duplicate"):
                extra = 3 if mark == "truncated" else 0
                ways += [(extra, "K", NEXT.get((q, role[:1])), ((role, text),))]
                ways += [(3 + extra, "R", NEXT.get((q, r[0])), ((r, text),)) for r in ("user", "assistant")]
            ways = [(c + after[to][0], letter + after[to][1], turns + after[to][2]) for c, letter, to, turns in ways if to is not None and after[to]]
            best[q] = min(ways, key=lambda z: z[:2]) if ways else None
        after = with_insertions(best)
    return after[0]


def expected(rows, damage=True):
    out, then = {}, damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c in {r[0] for r in rows}:
        own = sorted((r for r in then if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        marks, turns = faults(own), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = plain(own, marks)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
        out[c] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", *repair.COUNTS, "cost", "audit", "repaired_sha256").collect()}


def made(n, seed):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", None, "x \n", " ", "é?", "end. \x0b"]
    rows = [
        (rng.choice([None, None, None, 1, 2, 3, 7]), rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "assistant", "tool", "", None]),
         rng.choice([*texts, f"number {i}.", f"open {i}"]))
        for i in range(n)
    ]
    return rows + rows[: n // 5] * 3


@pytest.mark.parametrize("seed", range(400))
def test_lattice_equals_table(seed):
    rng = random.Random(seed)
    rows = [(1, i, rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), "x") for i in range(rng.randint(0, 9))]
    marks = [rng.choice(["", "", "", "blank", "truncated"]) for _ in rows]
    items = tuple(lattice.Item("", False, 1) if m == "blank" else lattice.Item(r[2][0], m == "truncated") for r, m in zip(rows, marks))
    want = plain(rows, marks)[:2]
    assert lattice.cheapest(items) == want
    # in blocks, from the last to the first
    cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(3))})
    rest = {q: (0, None) for q in lattice.ACCEPTING}
    for block, (a, b) in reversed(list(enumerate(zip(cuts, cuts[1:])))):
        labels = [(e, x, *found) for e in range(4) for x in range(4) if (found := lattice.cheapest(items[a:b], e, (x,)))]
        rest = lattice.prepend(block, labels, rest)
    cost, chain = rest[lattice.START]
    audit = ""
    while chain:
        audit, chain = audit + chain.audit, chain.rest
    assert (cost, audit) == want


def test_many_forced_rows_are_one_edge():
    items = (lattice.Item("u", False), lattice.Item("", False, 5), lattice.Item("a", False))
    assert lattice.cheapest(items) == (20, "KDDDDDK")


@pytest.mark.parametrize("damage", [True, False])
def test_long_conversations_in_blocks(spark, damage):
    """A null conversation with some thousand rows, equal rows, equal and null turns."""
    rows = made(1500, 5)
    turns = repair.rows_of(spark.createDataFrame(rows, SCHEMA))
    assert result(repair.report(repair.damage(turns) if damage else turns)) == expected(rows, damage)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "and?"), (1, 2, "assistant", "yes"), (2, 0, "assistant", " "), (3, 5, "system", "be kind."), (3, 6, "user", "ok."), (3, 9, "assistant", "fine.")]
    got = [tuple(r) for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    want = []
    for c in (1, 3):
        own = [r for r in rows if r[0] == c]
        want += [(c, i, *turn) for i, turn in enumerate(plain(own, faults(own))[2])]
    assert got == want
    assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in got if r[0] == 3))


def test_dropped_conversations_empty_tables_and_other_columns(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (5, None, None, None)]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], SCHEMA + ", seq string, copies int")
    assert result(repair.report(repair.damage(repair.rows_of(df)))) == expected(rows)
    assert expected(rows)[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = repair.rows_of(df.where("false"))
    assert repair.report(none).count() == 0 and repair.repaired(df.where("false")).count() == 0
