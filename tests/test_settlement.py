import random
from decimal import Decimal

from conftest import rows_of
from vouchermill.operators.settlement import ageing_report, days_to_payment, fifo_settlement, open_items


def brute_force(invoices, receipts):
    """Match in date order, oldest invoice first."""
    open_invoices = [[d, a] for d, a in sorted(invoices)]
    out = {}
    for day, amount in sorted(receipts):
        while amount > 0 and open_invoices:
            first = open_invoices[0]
            part = min(first[1], amount)
            out[(first[0], day)] = out.get((first[0], day), Decimal(0)) + part
            first[1] -= part
            amount -= part
            if first[1] == 0:
                open_invoices.pop(0)
    return out


def test_equals_brute_force(make_ledger):
    rnd = random.Random(5)
    rows, want = [], {}
    for party in ("a", "b", "c"):
        def amounts(n, party=party):
            return [(f"2024-{rnd.randint(1, 6):02d}-{rnd.randint(1, 28):02d}", Decimal(rnd.randint(1, 9999)) / 100) for _ in range(n)]

        invoices, receipts = amounts(40), amounts(30)
        if party == "b":  # a receipt that ends exactly where an invoice ends
            receipts = [("2024-01-01", invoices[0][1])] + receipts
        rows += [(d, party, "Sales", a) for d, a in invoices] + [(d, party, "Receipt", a) for d, a in receipts]
        for (i, r), amount in brute_force(invoices, receipts).items():
            want[(party, i, r)] = amount
    rows += [("2024-01-01", None, "Sales", 5), ("2024-01-01", "d", "Sales", 5), ("2024-01-01", "e", "Receipt", 5)]
    rows += [("2024-01-02", "a", "Sales", 0), ("2024-01-02", "a", "Payment", 3)]
    got = {
        (r["customer"], str(r["invoice_date"]), str(r["receipt_date"])): r["matched"]
        for r in rows_of(fifo_settlement(make_ledger(rows)))
    }
    assert got == want


def test_average_days(make_ledger):
    rows = [("2024-01-01", "a", "Sales", 100), ("2024-01-31", "a", "Receipt", 50), ("2024-03-01", "a", "Receipt", 25)]
    got = rows_of(days_to_payment(make_ledger(rows)))
    assert got == [
        {"customer": "a", "settled_amount": 75.0, "avg_days_to_payment": 40.0, "min_days": 30, "max_days": 60}
    ]


def test_open_items_and_settled_pieces_add_up(make_ledger):
    """Settled up to a date and open at that date are all that was invoiced and received up to it."""
    rnd = random.Random(11)
    rows = []
    for party, receipts in (("under", 15), ("over", 60), ("never", 0)):
        for category, n in (("Sales", 30), ("Receipt", receipts)):
            rows += [
                (f"2024-{rnd.randint(1, 6):02d}-{rnd.randint(1, 28):02d}", party, category, Decimal(rnd.randint(1, 9999)) / 100)
                for _ in range(n)
            ]
    rows += [("2024-03-01", "first", "Receipt", 7), ("2024-03-01", None, "Sales", 5), ("2024-03-02", "never", "Contra", 5)]
    as_of = "2024-04-15"
    before = [r for r in rows if r[0] <= as_of and r[1]]
    got = rows_of(open_items(make_ledger(rows), as_of))
    want = {}
    for party in {r[1] for r in before}:
        invoices = [(d, a) for d, p, c, a in before if (p, c) == (party, "Sales")]
        receipts = [(d, a) for d, p, c, a in before if (p, c) == (party, "Receipt")]
        settled = brute_force(invoices, receipts)
        for kind, side, place in (("invoice", invoices, 0), ("advance", receipts, 1)):
            for day, amount in side:
                want[(party, kind, day)] = want.get((party, kind, day), Decimal(0)) + amount
            for pair, amount in settled.items():
                want[(party, kind, pair[place])] -= amount
    assert {(r["customer"], r["kind"], str(r["txn_date"])): r["open_amount"] for r in got} == {
        k: v for k, v in want.items() if v > 0
    }
    assert len({(r["customer"], r["kind"]) for r in got}) == len({r["customer"] for r in got})


def test_ageing_bands(make_ledger):
    rows = [
        ("2024-01-01", "a", "Sales", 100), ("2024-03-01", "a", "Sales", 40), ("2024-03-31", "a", "Receipt", 30),
        ("2024-03-31", "b", "Receipt", 8), ("2024-03-30", "c", "Sales", 5), ("2024-03-31", "c", "Receipt", 5),
        ("2024-05-01", "c", "Receipt", 5),
    ]
    a, b, c = rows_of(ageing_report(make_ledger(rows), "2024-03-31"), "customer")
    assert (a["settled"], a["open_amount"], a["open_0_to_30"], a["open_61_to_90"]) == (30.0, 110.0, 40.0, 70.0)
    assert a["oldest_open_days"] == 90 and a["advances"] == 0.0
    assert (b["invoiced"], b["advances"], b["oldest_open_days"]) == (0.0, 8.0, None)
    assert (c["settled"], c["open_amount"], c["advances"]) == (5.0, 0.0, 0.0)
    last = rows_of(ageing_report(make_ledger(rows)), "customer")  # the last date counts: a second receipt of c
    assert last[2]["advances"] == 5.0
    assert rows_of(open_items(make_ledger(rows[:0]))) == []
