from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.operators import slicers

ROWS = [
    ("2024-04-05", "A", "Sales", 100), ("2024-05-05", "A", "Sales", 50), ("2024-07-05", "B", "Sales", 10),
    ("2025-01-01", "A", "Receipt", 30), ("2025-04-01", "A", "Sales", 7), ("2025-04-02", "C", "Payment", 5),
    ("2025-04-03", None, "Sales", 2),
]


def test_slices_count_each_party_once(make_ledger):
    got = {(r["fiscal_year"], r["quarter"]): r for r in rows_of(slicers.measures_by_slicers(make_ledger(ROWS)))}
    counts = {k: (r["active_customers"], r["parties"], r["gross_sales"]) for k, r in got.items()}
    assert counts == {
        ("2024-25", "Q1"): (1, 1, 150.0), ("2024-25", "Q2"): (1, 1, 10.0), ("2024-25", "Q4"): (0, 1, 0.0),
        ("2025-26", "Q1"): (1, 2, 9.0), ("2024-25", "all"): (2, 2, 160.0), ("2025-26", "all"): (1, 2, 9.0),
        ("all", "Q1"): (1, 2, 159.0), ("all", "Q2"): (1, 1, 10.0), ("all", "Q4"): (0, 1, 0.0), ("all", "all"): (2, 3, 169.0),
    }
    assert slicers.measures_by_slicers(make_ledger(ROWS[:0])).count() == 0


def test_bitmaps_equal_distinct_counts(spark, monkeypatch):
    """Blocks of more than one bitmap in a range, a party that has a third of all rows."""
    monkeypatch.setattr(slicers, "RANGES", 2)
    rows = spark.range(210_000).select(
        F.date_add(F.lit("2023-04-01").cast("date"), (F.col("id") % 730).cast("int")).alias("txn_date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 80_000).cast("string"))).alias("particulars"),
        F.lit("x").alias("vch_no"), F.lit(1).cast("decimal(18,2)").alias("debit_amount"),
        F.lit(0).cast("decimal(18,2)").alias("credit_amount"),
        F.when(F.col("id") % 5 < 3, "Sales").otherwise("Journal").alias("txn_category"),
    )
    got = {(r["fiscal_year"], r["quarter"]): (r["active_customers"], r["parties"]) for r in rows_of(slicers.measures_by_slicers(rows))}
    sold = F.countDistinct(F.when(F.col("txn_category") == "Sales", F.col("particulars")))
    total = rows.agg(sold.alias("a"), F.countDistinct("particulars").alias("p")).first()
    assert got["all", "all"] == (total.a, total.p) and total.p > 2 * 32768
    first = rows.filter("month(txn_date) between 4 and 6").agg(sold.alias("a"), F.countDistinct("particulars").alias("p")).first()
    assert got["all", "Q1"] == (first.a, first.p)


def test_customer_slices_add_up(make_ledger):
    got = {(r["customer"], r["fiscal_year"], r["quarter"]): r for r in rows_of(slicers.customers_by_slicers(make_ledger(ROWS)))}
    assert {c for c, *_ in got} == {"A", "B", "C"}
    every = got["A", "all", "all"]
    assert (every["gross_sales"], every["receipts"], every["sales_vouchers"], every["avg_invoice_value"]) == (157.0, 30.0, 3, 52.33)
    assert got["A", "all", "Q1"]["gross_sales"] == 157.0 and got["A", "2024-25", "Q4"]["receipts"] == 30.0
