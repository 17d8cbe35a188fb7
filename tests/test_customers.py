import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.config import ActionTexts
from vouchermill.operators import customers, parties, reports

BANDS = [
    # recency, frequency, monetary: r, f, m
    ((0, 1, "0.01"), (5, 1, 1)),
    ((15, 3, "100000"), (5, 1, 1)),
    ((16, 4, "100000.01"), (4, 2, 2)),
    ((45, 10, "500000"), (4, 2, 2)),
    ((46, 11, "500000.01"), (3, 3, 3)),
    ((90, 30, "1000000"), (3, 3, 3)),
    ((91, 31, "1000000.01"), (2, 4, 4)),
    ((180, 100, "5000000"), (2, 4, 4)),
    ((181, 101, "5000000.01"), (1, 5, 5)),
    ((9999, 9999, "999999999"), (1, 5, 5)),
    ((12000, 12000, "2000000000.01"), (1, 5, 5)),  # the last bands are open
    ((-1, 0, "0"), (None, None, None)),
]


def test_bands_are_right_closed(spark):
    rows = [(r, f, Decimal(m)) for (r, f, m), _ in BANDS]
    df = spark.createDataFrame(rows, "recency bigint, frequency bigint, monetary decimal(28,2)")
    got = {(r.recency, r.frequency): r for r in customers.rfm_score_columns(df).collect()}
    for (r, f, _), want in BANDS:
        row = got[(r, f)]
        assert (row.r_score, row.f_score, row.m_score) == want
        if want[0]:
            assert float(row.rfm_score) == round(want[0] * 0.3 + want[1] * 0.3 + want[2] * 0.4, 2)
    # outside the bands there is no score, and without a score the customer is lost
    assert got[(-1, 0)].rfm_score is None
    assert got[(-1, 0)].segment == "Lost"


SEGMENTS = [
    ("4.00", 5, 4, "Champion"), ("3.99", 3, 4, "Loyal"), ("3.00", 3, 3, "Loyal"), ("3.00", 2, 4, "At Risk"),
    ("2.99", 3, 1, "Promising"), ("2.00", 3, 1, "Promising"), ("2.00", 2, 3, "At Risk"), ("1.99", 1, 3, "At Risk"),
    ("1.99", 3, 3, "Lost"), ("2.50", 2, 2, "Lost"), ("1.00", 1, 1, "Lost"),
]


def test_segments(spark):
    rows = [(Decimal(s), r, m, w) for s, r, m, w in SEGMENTS]
    df = spark.createDataFrame(rows, "s decimal(10,2), r int, m int, want string")
    assert df.filter(customers.rfm_segment(F.col("s"), F.col("r"), F.col("m")) != F.col("want")).count() == 0


def test_rfm_from_ledger(make_ledger):
    ledger = make_ledger(
        [
            ("2024-06-30", "A", "Sales", 100), ("2024-05-01", "A", "Sales", 50.5), ("2024-07-30", "A", "Sales", 0),
            ("2024-01-01", "B", "Sales", 7_000_000), ("2024-08-30", "C", "Receipt", 5),
        ]
    )
    a, b = rows_of(customers.rfm_banded(ledger), "customer")
    # zero sales and other categories count for nothing, not even the reference date
    assert (a["recency"], a["frequency"], a["monetary"], a["first_purchase"]) == (1, 2, 150.5, "2024-05-01")
    assert (b["recency"], b["m_score"], b["revenue_lakhs"]) == (182, 5, 70.0)
    assert a["recommended_action"] == ActionTexts.default().rfm[a["segment"]]
    named = customers.rfm_banded(ledger, texts=ActionTexts.default("Ms Rao"))
    assert any("Ms Rao" in r["recommended_action"] for r in rows_of(named))


def test_minmax_labels(make_ledger):
    ledger = make_ledger(
        [("2024-01-01", "old", "Sales", 1)] + [("2024-12-31", "new", "Sales", 100)] * 4 + [("2024-07-01", "mid", "Sales", 50)] * 2
    )
    got = {r["customer"]: r for r in rows_of(customers.rfm_minmax(ledger))}
    assert (got["old"]["rfm_score"], got["old"]["segment"]) == (0.0, None)
    assert (got["new"]["rfm_score"], got["new"]["segment"]) == (1.0, "Champion")
    assert got["mid"]["segment"] == "Growing"


def test_minmax_of_one_customer(make_ledger):
    got = rows_of(customers.rfm_minmax(make_ledger([("2024-01-01", "only", "Sales", 1)])))
    # no spread: recency counts in full, the others not at all
    assert got[0]["rfm_score"] == pytest.approx(0.35)


TIERS = [
    # invoiced, received, tier
    ("1000.00", "1000.40", "Excellent"),  # 100.04 rounds to 100.0
    ("1000.00", "1000.60", "Advance Payer"),
    ("1000.00", "950.00", "Excellent"),
    ("1000.00", "949.40", "Good"),
    ("1000.00", "949.60", "Excellent"),  # 94.96 rounds to 95.0
    ("1000.00", "850.00", "Good"),
    ("1000.00", "849.00", "Moderate Risk"),
    ("1000.00", "700.00", "Moderate Risk"),
    ("1000.00", "699.00", "High Risk"),
    ("1000.00", "0.00", "High Risk"),
    ("0.00", "5.00", "Advance Payer"),
    ("0.00", "0.00", "High Risk"),
]


def test_payment_tiers(make_ledger):
    rows = []
    for i, (invoiced, received, _) in enumerate(TIERS):
        rows.append(("2024-05-01", f"C{i:02d}", "Sales", invoiced))
        if received != "0.00":
            rows.append(("2024-06-01", f"C{i:02d}", "Receipt", received))
    rows += [("2024-06-15", "Bank loan", "Receipt", 999), ("2024-07-01", "x", "Journal", 1)]
    ledger = make_ledger(rows)
    got = rows_of(customers.payment_profile(ledger, ledger), "customer")
    # receipts of parties that never bought do not make a customer
    assert [r["customer"] for r in got] == [f"C{i:02d}" for i in range(len(TIERS))]
    assert [r["risk_tier"] for r in got] == [t for _, _, t in TIERS]
    assert (got[0]["days_since_pay"], got[0]["last_payment"]) == (30, "2024-06-01")
    assert (got[9]["days_since_pay"], got[9]["last_payment"], got[9]["num_receipts"]) == (999, "No payment", 0)
    assert (got[0]["collection_rate_pct"], got[10]["collection_rate_pct"]) == (100.0, None)
    total = {r["risk_tier"]: r for r in rows_of(customers.tier_summary(ledger))}["all"]
    assert total["customers"] == len(TIERS)
    assert total["outstanding"] < total["positive_outstanding"]


def test_semi_join_of_receipts(make_ledger):
    ledger = make_ledger([("2024-05-01", "A", "Sales", 1), ("2024-05-01", "A", "Receipt", 1), ("2024-05-01", "B", "Receipt", 1)])
    kept = parties.customer_receipts(ledger.filter("txn_category = 'Receipt'"), ledger.filter("txn_category = 'Sales'"))
    assert [r["particulars"] for r in rows_of(kept)] == ["A"]


def churn_ledger(make_ledger, as_of):
    def day(n):
        return (as_of - dt.timedelta(days=n)).isoformat()

    rows = [("2023-05-01", p, "Sales", 100_000) for p in ("d30", "d31", "d90", "d91", "d180", "d181")]
    rows += [(day(int(p[1:])), p, "Sales", 50_000) for p in ("d30", "d31", "d90", "d91", "d180", "d181")]
    rows += [("2023-06-01", "gone", "Sales", 300_000), ("2024-06-01", "new", "Sales", 70_000)]
    rows += [("2021-06-01", "ancient", "Sales", 10_000), ("2023-06-01", "zero", "Sales", 0), (day(0), "zero", "Sales", 10)]
    return make_ledger(rows)


def test_churn(make_ledger):
    as_of = dt.date(2024, 12, 31)
    got = {r["customer"]: r for r in rows_of(customers.churn_profile(churn_ledger(make_ledger, as_of), "2023-24", "2024-25"))}
    want = {
        "d30": "Active", "d31": "Low Risk", "d90": "Low Risk", "d91": "Medium Risk", "d180": "Medium Risk",
        "d181": "High Risk", "gone": "Churned", "new": "New Customer", "ancient": "High Risk", "zero": "Active",
    }
    assert {k: r["churn_status"] for k, r in got.items()} == want
    assert got["gone"]["revenue_change_pct"] == -100.0
    assert got["d30"]["revenue_change_lakhs"] == -0.5
    # orders without value make no base for a growth rate
    assert (got["zero"]["orders_prior"], got["zero"]["revenue_change_pct"]) == (1, None)
    assert got["new"]["revenue_change_pct"] is None
    at_risk = {k for k, r in got.items() if r["revenue_at_risk_lakhs"] > 0}
    assert at_risk == {"gone", "d91", "d180", "d181", "ancient"}


def test_churn_order_lists_and_impact(make_ledger):
    churn = customers.churn_profile(churn_ledger(make_ledger, dt.date(2024, 12, 31)), "2023-24", "2024-25")
    order = [r["churn_status"] for r in rows_of(customers.by_status(churn))]
    ranks = ["Churned", "High Risk", "Medium Risk", "Low Risk", "Active", "New Customer"]
    assert order == sorted(order, key=ranks.index)
    assert [r["churn_status"] for r in rows_of(customers.churn_summary(churn))] == ranks
    impact = rows_of(customers.churn_impact(churn))[0]
    assert (impact["churned_lakhs"], impact["new_lakhs"], impact["net_impact_lakhs"]) == (3.0, 0.7, -2.3)
    lists = rows_of(customers.churn_lists(churn))
    names = [r["customer"] for r in lists if r["list_name"] == "both_years"]
    # no growth rate sorts last
    assert len(names) == 7 and names[-1] == "zero"


def test_rows_after_the_reference_date_do_not_count(make_ledger):
    ledger = make_ledger([("2024-05-01", "A", "Sales", 1), ("2024-09-01", "A", "Sales", 1)])
    got = rows_of(customers.churn_profile(ledger, "2023-24", "2024-25", as_of="2024-06-30"))[0]
    assert (got["days_since_last"], got["total_orders"]) == (60, 1)


def test_declining(make_ledger):
    rows = [("2023-05-01", "A", "Sales", 1)] * 4 + [("2024-05-01", "A", "Sales", 1)]
    rows += [("2023-05-01", "B", "Sales", 1), ("2023-05-01", "C", "Sales", 1), ("2024-05-01", "C", "Sales", 1)]
    got = rows_of(customers.declining_customers(make_ledger(rows), "2023-24", "2024-25"))
    assert [(r["customer"], r["drop_pct"]) for r in got] == [("A", 75.0)]


def test_canonical_names(spark, make_ledger):
    alias = spark.createDataFrame([("ACME LTD", "Acme"), ("Acme Ltd.", "Acme")], "variant string, canonical string")
    ledger = make_ledger([("2024-05-01", p, "Sales", 1) for p in ("ACME LTD", "Acme Ltd.", "Acme", "acme ltd", "Other")])
    got = rows_of(reports.invoice_summary(parties.canonical_party(ledger, alias)), "customer")
    assert [(r["customer"], r["invoices"]) for r in got] == [("Acme", 3), ("Other", 1), ("acme ltd", 1)]


def test_a_variant_named_twice_keeps_the_rows(spark, make_ledger):
    ledger = make_ledger([("2024-04-01", "M/S A", "Sales", 10), ("2024-04-02", "B", "Sales", 5)])
    alias = spark.createDataFrame([("M/S A", "Z"), ("M/S A", "A"), ("M/S A", "A")], "variant string, canonical string")
    assert [r["particulars"] for r in rows_of(parties.canonical_party(ledger, alias), "particulars")] == ["A", "B"]
