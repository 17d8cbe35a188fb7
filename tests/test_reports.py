from conftest import rows_of
from vouchermill.functions.calendar import with_calendar
from vouchermill.operators import reports
from vouchermill.plans import feeds

ROWS = [
    ("2024-04-05", "A", "Sales", 1000, "S1"),
    ("2024-04-20", "B", "Sales", 500, "S2"),
    ("2024-05-05", "A", "Sales", 250.5, None),
    ("2024-04-06", "Mill", "Purchase", 600, "P1"),
    ("2024-04-07", "A", "Debit Note", 100, "D1"),
    ("2024-04-08", "B", "Credit Note", 50, "C1"),
    ("2024-04-09", "Power", "Journal", 30, "J1"),
    ("2024-04-10", "A", "Receipt", 700, "R1"),
    ("2024-06-10", "Owner CAPITAL", "Payment", 200, "Y1"),
    ("2024-06-11", "Bank Loan", "Payment", 80, "Y2"),
    ("2024-06-12", "Loan desk", "Journal", 7, "J2"),
    ("2025-04-05", "A", "Sales", 400, "S3"),
    ("2024-07-01", "A", "Contra", 99, "X1"),
]


def test_financial_summary(make_ledger):
    first, second = rows_of(reports.measures_by_year(make_ledger(ROWS)), "fiscal_year")
    assert (first["fiscal_year"], first["gross_sales"], first["net_sales"]) == ("2024-25", 1750.5, 1800.5)
    assert (first["gross_margin"], first["operating_expenses"], first["net_profit"]) == (1200.5, 37.0, 1163.5)
    # cash out counts payments and expenses, the narrower measure payments only
    assert (first["cash_out"], first["net_cash"], first["net_cash_payments_only"]) == (317.0, 383.0, 420.0)
    # by keyword in any category
    assert (first["owner_drawings"], first["loan_payments"]) == (200.0, 87.0)
    # an invoice without a number has value but does not count as a voucher
    assert (first["sales_vouchers"], first["avg_invoice_value"]) == (2, 875.25)
    assert (first["active_customers"], first["parties"]) == (2, 7)
    assert first["top1_concentration"] == round(1250.5 / 1750.5, 6)
    assert (second["gross_margin_pct"], second["parties"]) == (100.0, 1)
    in_year = rows_of(reports.financial_summary(make_ledger(ROWS), "2024-25"))
    assert len(in_year) == 1 and in_year[0]["fiscal_year"] == "2024-25"


def test_payment_only_keywords(make_ledger):
    rows = [(d, p, c, float(a) * 1e7, n) for d, p, c, a, n in ROWS]
    got = rows_of(reports.financial_summary(make_ledger(rows)), "fiscal_year")[0]
    assert (got["owner_drawings"], got["loan_payments"]) == (200.0, 80.0)


def test_yoy(make_ledger):
    rows = [(d, p, c, float(a) * 1e7, n) for d, p, c, a, n in ROWS]
    got = {r["metric"]: r for r in rows_of(reports.yoy_comparison(make_ledger(rows), "2024-25", "2025-26"))}
    assert len(got) == 6
    assert (got["Net Sales"]["first_year"], got["Net Sales"]["second_year"]) == (1800.5, 400.0)
    assert got["Net Sales"]["growth_pct"] == round((400 - 1800.5) / 1800.5 * 100, 1)
    # no base year: growth is 0, not an error
    empty = {r["metric"]: r for r in rows_of(reports.yoy_comparison(make_ledger(rows), "2020-21", "2025-26"))}
    assert (empty["Net Sales"]["first_year"], empty["Net Sales"]["growth_pct"]) == (0.0, 0.0)


def test_cash_flow_variants(make_ledger):
    ledger = make_ledger(ROWS)
    all_months = rows_of(reports.cash_flow_receipt_credit(ledger), "month")
    some = rows_of(reports.cash_flow_filtered(ledger), "month")
    assert [r["month"] for r in all_months] == ["2024-04", "2024-05", "2024-06", "2024-07", "2025-04"]
    assert [r["month"] for r in some] == ["2024-04", "2024-06"]
    assert all(r["net_cash_flow"] == r["cash_in"] - r["cash_out"] for r in all_months)
    assert rows_of(reports.cash_flow_receipt_debit(ledger), "month")[0]["cash_in"] == 0.0
    running = rows_of(reports.cumulative_cash(ledger), "month")
    assert [(r["sign"], r["cumulative_in"], r["cumulative_out"]) for r in running] == [
        ("inflow", 700.0, 0.0), ("outflow", 700.0, 280.0),
    ]
    best = rows_of(feeds.cash_extremes(ledger))[0]
    assert (best["best_month"], best["worst_month"]) == ("2024-04", "2024-06")


def test_growth_needs_the_same_month(make_ledger):
    rows = [("2024-04-05", "A", "Sales", 0), ("2024-06-05", "A", "Sales", 50), ("2025-04-05", "A", "Sales", 5),
            ("2025-05-05", "A", "Sales", 5), ("2025-06-05", "A", "Sales", 75)]
    got = {r["month"]: r for r in rows_of(reports.sales_growth(make_ledger(rows)))}
    assert (got["2025-04"]["sales_last_year"], got["2025-04"]["growth_pct"]) == (0.0, 0.0)
    assert (got["2025-05"]["sales_last_year"], got["2025-05"]["growth_pct"]) == (None, 0.0)
    assert got["2025-06"]["growth_pct"] == 50.0


def test_month_and_quarter_reports(make_ledger):
    ledger = make_ledger(ROWS)
    april = rows_of(reports.monthly_revenue_fy(ledger, "2024-25"), "month")[0]
    assert (april["month"], april["month_name"], april["num_invoices"], april["avg_invoice_value"]) == ("2024-04", "Apr", 2, 750.0)
    q = rows_of(reports.quarterly_performance(ledger), "fiscal_year", "quarter")
    assert (q[0]["quarter"], q[0]["sales_invoices"], q[1]["sales_invoices"]) == ("Q1", 3, 0)
    tax = rows_of(reports.tax_liability(ledger), "fiscal_year")[0]
    assert tax["net_liability"] == 58.0  # 5 % of 1150.5 is 57.525
    days = {r["day_of_week"]: r["total_txns"] for r in rows_of(reports.volume_by_weekday(ledger))}
    assert days == {"Friday": 1, "Saturday": 2, "Sunday": 1}
    gross = rows_of(reports.monthly_gross_margin(ledger))
    assert [(r["month"], r["margin_pct"]) for r in gross] == [("2024-04", 60.0)]


def test_rounding_is_half_up(make_ledger):
    ledger = make_ledger([("2024-04-01", "A", "Sales", "0.5"), ("2024-05-01", "A", "Sales", "2.5"), ("2024-06-01", "A", "Sales", "-1.5")])
    assert [r["total_sales"] for r in rows_of(reports.monthly_sales_trend(ledger), "month")] == [1.0, 3.0, -2.0]


def test_profile_counts_parties_once(make_ledger):
    got = {r["fiscal_year"]: r for r in rows_of(reports.ledger_profile(make_ledger(ROWS)))}
    assert (got["all"]["rows"], got["all"]["parties"], got["2025-26"]["parties"]) == (13, 7, 1)


def test_duplicate_vouchers(make_ledger):
    ledger = make_ledger([("2024-04-01", "A", "Sales", 1, n) for n in ("a", "b", "a", None, None, "c")])
    assert [(r["vch_no"], r["count"]) for r in rows_of(reports.duplicate_vouchers(ledger))] == [("a", 2)]  # missing numbers match nothing


def test_slices(make_ledger, spark):
    ledger = with_calendar(make_ledger(ROWS))
    assert feeds.slice_ledger(ledger, "2024-25", "Q1").count() == 11
    segments = spark.createDataFrame([("A", "Loyal"), ("B", "Lost")], "customer string, segment string")
    only_b = feeds.slice_ledger(ledger, segments=segments, segment="Lost")
    assert {r["particulars"] for r in rows_of(only_b)} == {"B"}


def test_gauge_and_colours(make_ledger):
    gauge = rows_of(feeds.margin_gauge(make_ledger(ROWS)), "fiscal_year")
    assert (gauge[0]["target_met"], gauge[0]["needle"], gauge[1]["needle"]) == (True, 1.0, 1.0)
    rows = [("2024-04-01", "A", "Sales", 100), ("2024-04-01", "S", "Purchase", 70), ("2024-05-01", "A", "Sales", 100),
            ("2024-05-01", "S", "Purchase", 69), ("2024-06-01", "A", "Sales", 100), ("2024-06-01", "S", "Purchase", 86)]
    got = rows_of(feeds.margin_colours(make_ledger(rows)), "month")
    assert [r["colour"] for r in got] == ["yellow", "green", "red"]


def test_matrix_has_fixed_columns(make_ledger):
    got = rows_of(feeds.customer_month_matrix(make_ledger(ROWS), "2024-25"), "customer")
    assert list(got[0]) == "customer apr may jun jul aug sep oct nov dec jan feb mar".split()
    assert (got[0]["apr"], got[0]["may"], got[0]["jun"]) == (1000.0, 251.0, 0.0)


def test_missing_numbers_and_parties(spark, make_ledger):
    """Missing voucher numbers match nothing; a missing party is no customer, in both counts of active customers."""
    ledger = with_calendar(make_ledger([
        ("2024-04-05", None, "Sales", 10, None), ("2024-04-06", "A", "Sales", 10, None), ("2024-04-07", "A", "Sales", 10, "S1"),
        ("2024-04-08", "A", "Sales", 10, "S1"),
    ]))
    assert [(r["vch_no"], r["count"]) for r in rows_of(reports.duplicate_vouchers(ledger))] == [("S1", 2)]
    assert rows_of(reports.measures_by_year(ledger))[0]["active_customers"] == 1
    assert rows_of(feeds.kpi_cards(ledger))[0]["active_customers"] == 1
