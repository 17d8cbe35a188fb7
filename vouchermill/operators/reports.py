"""Aggregation reports over a ledger or a register."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window, functions as F

from vouchermill.functions.calendar import (
    fiscal_label,
    fiscal_quarter_num,
    fiscal_start_year,
    of_fiscal_years,
    iso,
    month_bucket,
    month_name,
)
from vouchermill.functions.categories import is_category
from vouchermill.functions.measures import (
    Names,
    count_where,
    crores,
    derived_measures,
    measure_totals,
    measures_per_party,
    sum_of,
    sum_where,
)
from vouchermill.functions.numeric import as_double, from_cents, half_up, percent, percent_of, ratio, whole_cents
from vouchermill.operators.ranking import top_with_running_total, with_grand_total

MONTH = "month"


def _month():
    # grouping by the first day is cheap, its text is made after aggregation
    return F.trunc("txn_date", "MM").alias("_m")


def _month_text():
    return month_bucket(F.col("_m")).alias(MONTH)


def _year():
    return fiscal_start_year(F.col("txn_date")).alias("_y")


def _year_text():
    return fiscal_label(F.col("_y")).alias("fiscal_year")


def _mean(total: str, n: str):
    return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))


def monthly_sales_trend(ledger: DataFrame) -> DataFrame:
    sales = ledger.filter(is_category("Sales"))
    totals = sales.groupBy(_month()).agg(F.sum("debit_amount").alias("s"))
    return totals.select(_month_text(), half_up(F.col("s"), 0).alias("total_sales")).orderBy(MONTH)


def monthly_revenue_fy(ledger: DataFrame, fy: str) -> DataFrame:
    sales = of_fiscal_years(ledger, fy).filter(is_category("Sales"))
    totals = sales.groupBy(_month()).agg(
        F.sum("debit_amount").alias("s"), F.count(F.lit(1)).alias("num_invoices")
    )
    return totals.select(
        _month_text(),
        month_name(F.col("_m")).alias("month_name"),
        half_up(F.col("s"), 2).alias("total_sales"),
        "num_invoices",
        half_up(_mean("s", "num_invoices"), 2).alias("avg_invoice_value"),
    ).orderBy(MONTH)


def party_revenue(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    """Sales per party; the input of both Pareto reports."""
    sales = ledger.filter(is_category("Sales"))
    return sales.groupBy(F.col(party).alias("customer")).agg(
        F.sum("debit_amount").alias("revenue"), F.count(F.lit(1)).alias("transactions")
    )


def pareto_top(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Shares over revenues that were rounded to whole units first."""
    totals = party_revenue(ledger).select(
        "customer", F.round("revenue", 0).cast("decimal(28,0)").alias("revenue")
    )
    top = with_top_totals(totals, "revenue", n)
    return top.select(
        "customer",
        as_double(F.col("revenue")).alias("revenue"),
        half_up(percent(F.col("revenue"), F.col("grand_total")), 1).alias("pct"),
        half_up(percent(F.col("running_total"), F.col("grand_total")), 1).alias("cumulative_pct"),
    ).orderBy(F.col("revenue").desc(), "customer")


def with_top_totals(totals: DataFrame, value: str, n: int) -> DataFrame:
    top = top_with_running_total(totals, value, n, ["customer"])
    return with_grand_total(top, totals, value)


def pareto_ranked(ledger: DataFrame, n: int = 15) -> DataFrame:
    top = with_top_totals(party_revenue(ledger), "revenue", n)
    return top.select(
        "rank",
        "customer",
        half_up(F.col("revenue"), 0).alias("revenue_inr"),
        half_up(percent(F.col("revenue"), F.col("grand_total")), 2).alias("revenue_pct"),
        half_up(percent(F.col("running_total"), F.col("grand_total")), 1).alias("cumulative_pct"),
    ).orderBy("rank")


def supplier_totals(register: DataFrame, names: Names | None = None) -> DataFrame:
    """Spend per supplier. With ``names`` the register holds codes, which are named once a supplier; suppliers
    of one name count as one."""
    totals = register.groupBy("supplier_name").agg(
        F.sum("purchase_amount").alias("s"),
        F.count(F.lit(1)).alias("num_bills"),
        F.min("txn_date").alias("first_purchase"),
        F.max("txn_date").alias("last_purchase"),
    )
    if names:
        totals = names(totals).groupBy("supplier_name").agg(
            F.sum("s").alias("s"),
            F.sum("num_bills").alias("num_bills"),
            F.min("first_purchase").alias("first_purchase"),
            F.max("last_purchase").alias("last_purchase"),
        )
    return totals.select(
        "supplier_name",
        half_up(F.col("s"), 0).alias("total_spend"),
        "num_bills",
        half_up(_mean("s", "num_bills"), 0).alias("avg_bill_value"),
        iso(F.col("first_purchase")).alias("first_purchase"),
        iso(F.col("last_purchase")).alias("last_purchase"),
    )


def supplier_spend(register: DataFrame, n: int = 15, names: Names | None = None) -> DataFrame:
    return supplier_totals(register, names).orderBy(F.col("total_spend").desc(), "supplier_name").limit(n)


def monthly_sales_purchase(ledger: DataFrame, keys: tuple = ()) -> DataFrame:
    """Sales and purchase per month, months that have both: one conditional
    aggregate in place of two aggregates and an inner join."""
    rows = ledger.filter(is_category("Sales", "Purchase"))
    totals = rows.groupBy(*keys, F.trunc("txn_date", "MM").alias("month_start")).agg(
        sum_of("Sales", "debit_amount").alias("sales"),
        sum_of("Purchase", "credit_amount").alias("purchase"),
        count_where(is_category("Sales")).alias("n_sales"),
        count_where(is_category("Purchase")).alias("n_purchase"),
    )
    both = totals.filter((F.col("n_sales") > 0) & (F.col("n_purchase") > 0))
    return both.select(
        *keys, "month_start", month_bucket(F.col("month_start")).alias(MONTH), "sales", "purchase"
    )


def monthly_gross_margin(ledger: DataFrame) -> DataFrame:
    s, p = F.col("sales"), F.col("purchase")
    return (
        monthly_sales_purchase(ledger)
        .select(
            MONTH,
            half_up(s, 0).alias("sales_inr"),
            half_up(p, 0).alias("purchase_inr"),
            half_up(s - p, 0).alias("gross_margin"),
            half_up(percent(s - p, s), 1).alias("margin_pct"),
        )
        .orderBy(MONTH)
    )


def _cash_flow(rows: DataFrame, receipt_amount: str) -> DataFrame:
    totals = rows.groupBy(_month()).agg(
        sum_of("Receipt", receipt_amount).alias("i"), sum_of("Payment", "debit_amount").alias("o")
    )
    return totals.select(
        _month_text(),
        half_up(F.col("i"), 0).alias("cash_in"),
        half_up(F.col("o"), 0).alias("cash_out"),
        half_up(F.col("i") - F.col("o"), 0).alias("net_cash_flow"),
    ).orderBy(MONTH)


def cash_flow_receipt_debit(ledger: DataFrame) -> DataFrame:
    return _cash_flow(ledger, "debit_amount")


def cash_flow_receipt_credit(ledger: DataFrame) -> DataFrame:
    return _cash_flow(ledger, "credit_amount")


def cash_flow_filtered(ledger: DataFrame) -> DataFrame:
    """Only payment and receipt rows: a month without either does not appear."""
    return _cash_flow(ledger.filter(is_category("Payment", "Receipt")), "credit_amount")


def cumulative_cash(ledger: DataFrame) -> DataFrame:
    """Running cash in and out over the months."""
    rows = ledger.filter(is_category("Payment", "Receipt"))
    totals = rows.groupBy(_month()).agg(
        sum_of("Receipt", "credit_amount").alias("i"), sum_of("Payment", "debit_amount").alias("o")
    )
    # one row per calendar month: small whatever the ledger
    upto = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("i") - F.col("o")
    return totals.select(
        _month_text(),
        half_up(net, 0).alias("net_cash"),
        F.when(net >= 0, "inflow").otherwise("outflow").alias("sign"),
        half_up(F.sum("i").over(upto), 0).alias("cumulative_in"),
        half_up(F.sum("o").over(upto), 0).alias("cumulative_out"),
    ).orderBy(MONTH)


def volume_by_weekday(ledger: DataFrame) -> DataFrame:
    sales = ledger.filter(is_category("Sales"))
    totals = sales.groupBy(F.dayofweek("txn_date").alias("dow")).agg(
        F.min("txn_date").alias("d"), F.count(F.lit(1)).alias("total_txns"), F.sum("debit_amount").alias("s")
    )
    return totals.select(
        F.date_format("d", "EEEE").alias("day_of_week"),
        "total_txns",
        half_up(F.col("s"), 0).alias("total_debit"),
        half_up(_mean("s", "total_txns"), 0).alias("avg_debit"),
    ).orderBy(F.col("total_txns").desc(), "day_of_week")


def tax_liability(ledger: DataFrame, rate: str = "0.05") -> DataFrame:
    totals = ledger.groupBy(_year()).agg(
        sum_of("Sales", "debit_amount").alias("o"), sum_of("Purchase", "credit_amount").alias("i")
    )
    net = (F.col("o") - F.col("i")) * F.lit(Decimal(rate))
    return totals.select(
        _year_text(),
        half_up(F.col("o"), 0).alias("output_taxable"),
        half_up(F.col("i"), 0).alias("input_taxable"),
        half_up(net, 0).alias("net_liability"),
    ).orderBy("fiscal_year")


def quarterly_performance(ledger: DataFrame) -> DataFrame:
    totals = ledger.groupBy(_year(), fiscal_quarter_num(F.col("txn_date")).alias("_q")).agg(
        sum_of("Sales", "debit_amount").alias("s"),
        sum_of("Purchase", "credit_amount").alias("p"),
        count_where(is_category("Sales")).alias("sales_invoices"),
    )
    return totals.select(
        _year_text(),
        F.concat(F.lit("Q"), F.col("_q").cast("string")).alias("quarter"),
        half_up(F.col("s"), 0).alias("sales"),
        half_up(F.col("p"), 0).alias("purchases"),
        "sales_invoices",
    ).orderBy("fiscal_year", "quarter")


def top_buyers(register: DataFrame, n: int = 10, names: Names | None = None) -> DataFrame:
    """Buyers by revenue. With ``names`` the register holds codes, which are named once a buyer."""
    rows = register.filter(F.col("rate") > 0)
    totals = rows.groupBy("buyer_name").agg(
        F.sum("rate").alias("r"),
        F.sum("quantity").alias("q"),
        F.sum("gross_total").alias("g"),
        F.count(F.lit(1)).alias("num_orders"),
    )
    if names:
        sums = [F.sum(c).alias(c) for c in ("r", "q", "g", "num_orders")]
        totals = names(totals).groupBy("buyer_name").agg(*sums)
    out = totals.select(
        "buyer_name",
        half_up(_mean("r", "num_orders"), 2).alias("avg_rate"),
        half_up(F.col("q"), 0).alias("total_qty"),
        half_up(F.col("g"), 0).alias("total_revenue"),
        "num_orders",
    )
    return out.orderBy(F.col("total_revenue").desc(), "buyer_name").limit(n)


# the amounts of a financial summary, in output order
SUMMARY_AMOUNTS = (
    "gross_sales", "debit_notes", "credit_notes", "net_sales", "purchase", "gross_margin",
    "operating_expenses", "net_profit", "receipts", "cash_out", "net_cash", "owner_drawings",
    "loan_payments",
)


def financial_summary(ledger: DataFrame, fy: str | None = None, names: Names | None = None) -> DataFrame:
    """Profit and cash figures per fiscal year, in crores, with two ratios."""
    rows = of_fiscal_years(ledger, fy) if fy else ledger
    totals = measure_totals(rows, [_year()], names=names)
    return totals.select(
        _year_text(),
        *[crores(F.col(n)).alias(n) for n in SUMMARY_AMOUNTS],
        half_up(F.col("gross_margin_pct"), 1).alias("gross_margin_pct"),
        half_up(F.col("net_profit_pct"), 1).alias("net_profit_pct"),
    ).orderBy("fiscal_year")


# Metrics of the year-on-year comparison and their measures.
YOY_METRICS = {
    "Net Sales": "net_sales",
    "Purchase": "purchase",
    "Gross Margin": "gross_margin",
    "Net Profit": "net_profit",
    "Cash In": "receipts",
    "Net Cash Flow": "net_cash",
}


def yoy_comparison(ledger: DataFrame, fy_a: str, fy_b: str, names: Names | None = None) -> DataFrame:
    """Six metrics in long form with growth in percent, 0 when the base is 0."""
    rows = of_fiscal_years(ledger, fy_a, fy_b)
    totals = measure_totals(rows, [_year()], names=names).withColumn("fiscal_year", fiscal_label(F.col("_y")))
    pairs = ", ".join(f"'{label}', cast({c} as decimal(38,2))" for label, c in YOY_METRICS.items())
    long = totals.select("fiscal_year", F.expr(f"stack({len(YOY_METRICS)}, {pairs}) as (metric, amount)"))

    def of(fy: str):
        return sum_where(F.col("fiscal_year") == fy, "amount")

    wide = long.groupBy("metric").agg(of(fy_a).alias("a"), of(fy_b).alias("b"))
    a, b = F.col("a"), F.col("b")
    growth = F.coalesce(percent(b - a, F.abs(a)), F.lit(0.0))
    return wide.select(
        "metric",
        crores(a).alias("first_year"),
        crores(b).alias("second_year"),
        half_up(growth, 1).alias("growth_pct"),
    ).orderBy("metric")


def category_counts(ledger: DataFrame) -> DataFrame:
    counts = ledger.groupBy(_year(), "txn_category").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(_year_text(), "txn_category", "rows").orderBy("fiscal_year", F.col("rows").desc(), "txn_category")


def ledger_profile(ledger: DataFrame, names: Names | None = None) -> DataFrame:
    """Rows, date range and parties per fiscal year and over all years.

    One aggregate by year and party feeds both levels; parties of all years are
    counted after a second, map-side combined step.
    """
    pairs = ledger.groupBy(_year(), "particulars").agg(
        F.count(F.lit(1)).alias("n"), F.min("txn_date").alias("lo"), F.max("txn_date").alias("hi")
    )
    if names:
        pairs = names(pairs).groupBy("_y", "particulars").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
    columns = [
        F.sum("n").alias("rows"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count("particulars").alias("parties"),
    ]
    by_year = pairs.groupBy("_y").agg(*columns).select(_year_text(), "rows", "lo", "hi", "parties")
    by_party = pairs.groupBy("particulars").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    overall = by_party.agg(*columns).select(F.lit("all").alias("fiscal_year"), "rows", "lo", "hi", "parties")
    both = by_year.unionByName(overall)
    return both.select(
        "fiscal_year", "rows", iso(F.col("lo")).alias("first_date"), iso(F.col("hi")).alias("last_date"), "parties"
    ).orderBy("fiscal_year")


def duplicate_vouchers(ledger: DataFrame) -> DataFrame:
    """Voucher numbers that occur more than once; missing numbers match nothing."""
    counts = ledger.filter(F.col("vch_no").isNotNull()).groupBy("vch_no").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > 1).orderBy(F.col("count").desc(), "vch_no")


def distinct_categories(ledger: DataFrame) -> DataFrame:
    return ledger.select("txn_category").distinct().orderBy("txn_category")


def measures_by_year(ledger: DataFrame, names: Names | None = None) -> DataFrame:
    """All measures per fiscal year.

    Rows collapse to one per year and party first, so that distinct parties are
    counted and the largest party is found without expanding the rows.
    """
    per_party = measures_per_party(ledger, [_year()], any_category=True, names=names)
    years = per_party.groupBy("_y").agg(
        *[F.sum(n).alias(n) for n in per_party.columns[2:]],
        count_where((F.col("sales_rows") > 0) & F.col("particulars").isNotNull()).alias("active_customers"),
        F.count("particulars").alias("parties"),
        F.max("gross_sales").alias("top_party_sales"),
    )
    full = years.withColumns(derived_measures())
    amounts = [
        "gross_sales", "debit_notes", "credit_notes", "net_sales", "purchase", "gross_margin",
        "blueprint_margin", "operating_expenses", "net_profit", "receipts", "payments", "cash_out",
        "net_cash", "net_cash_payments_only", "owner_drawings", "loan_payments",
    ]
    return full.select(
        _year_text(),
        *[half_up(F.col(n), 2).alias(n) for n in amounts],
        half_up(F.col("gross_margin_pct"), 1).alias("gross_margin_pct"),
        half_up(F.col("blueprint_margin_ratio"), 4).alias("blueprint_margin_ratio"),
        half_up(F.col("net_profit_pct"), 1).alias("net_profit_pct"),
        half_up(F.col("avg_invoice_value"), 2).alias("avg_invoice_value"),
        "sales_vouchers",
        "active_customers",
        "parties",
        half_up(F.coalesce(ratio(F.col("top_party_sales"), F.col("gross_sales")), F.lit(0.0)), 6).alias(
            "top1_concentration"
        ),
    ).orderBy("fiscal_year")


def sales_growth(ledger: DataFrame) -> DataFrame:
    """Monthly sales against the same month a year earlier.

    A self-join on the month, so that a missing month stays missing; growth is 0
    when there is no base.
    """
    sales = ledger.filter(is_category("Sales"))
    months = sales.groupBy(F.trunc("txn_date", "MM").alias("m")).agg(F.sum("debit_amount").alias("s"))
    last_year = months.select(F.add_months("m", 12).alias("m"), F.col("s").alias("ly"))
    joined = months.join(last_year, "m", "left")
    growth = F.coalesce(percent(F.col("s") - F.col("ly"), F.col("ly")), F.lit(0.0))
    return joined.select(
        month_bucket(F.col("m")).alias(MONTH),
        half_up(F.col("s"), 2).alias("sales"),
        half_up(F.col("ly"), 2).alias("sales_last_year"),
        half_up(growth, 1).alias("growth_pct"),
    ).orderBy(MONTH)


def invoice_summary(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    sales = ledger.filter(is_category("Sales"))
    totals = sales.groupBy(F.col(party).alias("customer")).agg(
        F.min("txn_date").alias("lo"),
        F.max("txn_date").alias("hi"),
        F.count(F.lit(1)).alias("invoices"),
        F.sum("debit_amount").alias("s"),
    )
    return totals.select(
        "customer",
        iso(F.col("lo")).alias("first_invoice"),
        iso(F.col("hi")).alias("last_invoice"),
        "invoices",
        half_up(F.col("s"), 2).alias("invoiced"),
        half_up(_mean("s", "invoices"), 2).alias("avg_invoice"),
    )


def order_frequency(ledger: DataFrame) -> DataFrame:
    """Orders, average order value and orders per active month of a party."""
    sales = ledger.filter(is_category("Sales"))
    monthly = sales.groupBy(F.col("particulars").alias("customer"), F.trunc("txn_date", "MM").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("debit_amount").alias("s")
    )
    totals = monthly.groupBy("customer").agg(
        F.sum("n").alias("orders"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("active_months")
    )
    return totals.select(
        "customer",
        "orders",
        "active_months",
        half_up(_mean("orders", "active_months"), 2).alias("orders_per_active_month"),
        half_up(_mean("s", "orders"), 2).alias("avg_order_value"),
    )


def revenue_by_product_type(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Net revenue per product type.

    Lines collapse to one row per part first; the join then runs on that
    partitioning and only the parts are shuffled for it.
    """
    net = from_cents(percent_of(whole_cents(F.col("l_extendedprice")), 100 - whole_cents(F.col("l_discount"))))
    per_part = lines.groupBy("l_partkey").agg(F.sum(net).alias("s"), F.count(F.lit(1)).alias("n"))
    joined = per_part.join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    totals = joined.groupBy("p_type").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return totals.select(
        F.col("p_type").alias("product_type"), half_up(F.col("s"), 2).alias("revenue"), F.col("n").alias("line_count")
    ).orderBy("product_type")
