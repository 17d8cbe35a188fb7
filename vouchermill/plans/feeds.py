"""Result tables behind dashboard visuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouchermill.config import ChurnConfig
from vouchermill.functions.calendar import (
    FISCAL_MONTH_NAMES,
    fiscal_label,
    fiscal_start_year,
    of_fiscal_years,
    iso,
    month_bucket,
    month_name,
)
from vouchermill.functions.categories import is_category
from vouchermill.functions.measures import Names, base_measures, count_where, derived_measures, sum_of
from vouchermill.functions.numeric import half_up, percent, ratio
from vouchermill.operators.anomalies import iqr_anomalies
from vouchermill.operators.joins import attach_row, join_per_key
from vouchermill.operators.margin import monthly_margin
from vouchermill.operators.ranking import running_total_by_value, top_k_per_group, with_grand_total
from vouchermill.operators.reports import MONTH, monthly_sales_purchase, party_revenue, supplier_totals


def slice_ledger(
    ledger: DataFrame,
    fy: str | None = None,
    quarter: str | None = None,
    segments: DataFrame | None = None,
    segment: str | None = None,
) -> DataFrame:
    """Slicers shared by the feeds: fiscal year, quarter, customer segment.

    ``segments`` has the columns ``customer`` and ``segment``.
    """
    out = ledger
    if fy:
        out = of_fiscal_years(out, fy)
    if quarter:
        out = out.filter(F.col("quarter") == quarter)
    if segment:
        members = segments.filter(F.col("segment") == segment).select(F.col("customer").alias("particulars"))
        out = join_per_key(out, members, "particulars", "left_semi")
    return out


def kpi_cards(ledger: DataFrame, names: Names | None = None) -> DataFrame:
    """Revenue, margin ratio, net cash and active customers.

    Rows collapse to one per party first, so the distinct count needs no
    expansion of the rows.
    """
    wanted = ("gross_sales", "purchase", "receipts", "payments")
    base = {n: c for n, c in base_measures().items() if n in wanted}
    per_party = ledger.groupBy("particulars").agg(
        *[c.alias(n) for n, c in base.items()], count_where(is_category("Sales")).alias("_n")
    )
    if names:  # the ledger holds codes; parties of one name count as one
        sums = [F.sum(n).alias(n) for n in (*base, "_n")]
        per_party = names(per_party).groupBy("particulars").agg(*sums)
    t = per_party.agg(
        *[F.sum(n).alias(n) for n in base],
        count_where((F.col("_n") > 0) & F.col("particulars").isNotNull()).alias("active_customers"),
    )
    derived = derived_measures()
    return t.select(
        half_up(F.col("gross_sales"), 2).alias("total_revenue"),
        half_up(derived["blueprint_margin_ratio"], 4).alias("gross_margin_ratio"),
        half_up(derived["net_cash_payments_only"], 2).alias("net_cash_flow"),
        "active_customers",
    )


def revenue_with_average(timeline: DataFrame) -> DataFrame:
    """Timeline of actual and forecast months with the mean of the actual ones."""
    mean = timeline.filter(F.col("type") == "Actual").agg(F.avg("forecast_revenue").alias("m"))
    joined = attach_row(timeline, mean)
    return joined.select(*timeline.columns, half_up(F.col("m"), 0).alias("average_line")).orderBy(MONTH)


def sales_vs_purchase(ledger: DataFrame, target: float = 0.65) -> DataFrame:
    m = monthly_sales_purchase(ledger)
    r = ratio(F.col("purchase"), F.col("sales"))
    return m.select(
        MONTH,
        half_up(F.col("sales"), 0).alias("sales"),
        half_up(F.col("purchase"), 0).alias("purchase"),
        half_up(r, 4).alias("purchase_to_sales"),
        (r < target).alias("within_target"),
    ).orderBy(MONTH)


def margin_gauge(ledger: DataFrame, target: float = 30.0, full: float = 60.0) -> DataFrame:
    t = ledger.groupBy(fiscal_start_year(F.col("txn_date")).alias("_y")).agg(
        sum_of("Sales", "debit_amount").alias("s"), sum_of("Purchase", "credit_amount").alias("p")
    )
    pct = F.coalesce(percent(F.col("s") - F.col("p"), F.col("s")), F.lit(0.0))
    shown = half_up(pct, 2)
    return t.select(
        fiscal_label(F.col("_y")).alias("fiscal_year"),
        shown.alias("margin_pct"),
        F.lit(target).alias("target_pct"),
        (shown >= target).alias("target_met"),
        half_up(F.greatest(F.least(pct / full, F.lit(1.0)), F.lit(0.0)), 4).alias("needle"),
    ).orderBy("fiscal_year")


def revenue_by_customer(ledger: DataFrame, rfm: DataFrame) -> DataFrame:
    """Revenue and invoices of each customer with its segment."""
    t = party_revenue(ledger)
    joined = t.join(rfm.select("customer", "segment"), "customer", "left")
    return joined.select(
        "customer", half_up(F.col("revenue"), 2).alias("revenue"), F.col("transactions").alias("invoices"), "segment"
    )


def cumulative_sales(ledger: DataFrame) -> DataFrame:
    """For each customer the sales of all customers that sold at least as much."""
    t = running_total_by_value(party_revenue(ledger), "revenue", total="cumulative_sales", above="rank")
    return t.select(
        "customer",
        "rank",
        half_up(F.col("revenue"), 2).alias("revenue"),
        half_up(F.col("cumulative_sales"), 2).alias("cumulative_sales"),
    )


def pareto_line(ledger: DataFrame, line: float = 80.0) -> DataFrame:
    """Every customer with cumulative share and which side of the line it is on."""
    totals = party_revenue(ledger)
    t = running_total_by_value(totals, "revenue")
    t = with_grand_total(t, totals, "revenue")
    share = half_up(percent(F.col("running_total"), F.col("grand_total")), 4)
    return t.select(
        "customer",
        "rank",
        half_up(F.col("revenue"), 2).alias("revenue"),
        share.alias("cumulative_pct"),
        (share <= line).alias("within_line"),
    )


def customer_month_matrix(ledger: DataFrame, fy: str) -> DataFrame:
    """Customer by month of one fiscal year; the column list is fixed, so no pass
    over the data looks for it."""
    sales = of_fiscal_years(ledger, fy).filter(is_category("Sales")).select(
        F.col("particulars").alias("customer"), "debit_amount", month_name(F.col("txn_date")).alias("m")
    )
    wide = sales.groupBy("customer").pivot("m", list(FISCAL_MONTH_NAMES)).agg(F.sum("debit_amount"))
    zero = F.lit(0.0)
    return wide.select(
        "customer", *[F.coalesce(half_up(F.col(m), 0), zero).alias(m.lower()) for m in FISCAL_MONTH_NAMES]
    )


def sales_by_quarter(ledger: DataFrame) -> DataFrame:
    sales = ledger.filter(is_category("Sales"))
    quarters = ["Q1", "Q2", "Q3", "Q4"]
    wide = sales.groupBy("fiscal_year").pivot("quarter", quarters).agg(F.sum("debit_amount"))
    return wide.select(
        "fiscal_year", *[F.coalesce(half_up(F.col(q), 0), F.lit(0.0)).alias(q.lower()) for q in quarters]
    ).orderBy("fiscal_year")


def supplier_buckets(
    register: DataFrame, edges: tuple = (1_000_000, 10_000_000, 20_000_000), names: Names | None = None
) -> DataFrame:
    """Supplier detail with a spend bucket: the number of edges reached."""
    t = supplier_totals(register, names)
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("total_spend") >= e, 1).otherwise(0)
    return t.withColumn("spend_bucket", bucket)


def cash_extremes(ledger: DataFrame) -> DataFrame:
    """Best and worst cash month; the earlier month wins a tie."""
    rows = ledger.filter(is_category("Payment", "Receipt"))
    net = sum_of("Receipt", "credit_amount") - sum_of("Payment", "debit_amount")
    months = rows.groupBy(F.trunc("txn_date", "MM").alias("m")).agg(net.alias("net"))
    high = F.struct("net", (-F.unix_date("m")).alias("k"), "m")
    t = months.agg(F.max(high).alias("hi"), F.min(F.struct("net", "m")).alias("lo"))
    return t.select(
        month_bucket(F.col("hi.m")).alias("best_month"),
        half_up(F.col("hi.net"), 0).alias("best_net_cash"),
        month_bucket(F.col("lo.m")).alias("worst_month"),
        half_up(F.col("lo.net"), 0).alias("worst_net_cash"),
    )


def cash_kpis(ledger: DataFrame, payment: DataFrame) -> DataFrame:
    """Best and worst cash month and the total outstanding value."""
    due = payment.agg(F.sum(F.col("outstanding").cast("decimal(28,2)")).alias("d"))
    t = attach_row(cash_extremes(ledger), due)
    return t.select(
        "best_month", "best_net_cash", "worst_month", "worst_net_cash", half_up(F.col("d"), 0).alias("total_outstanding")
    )


def top_payers_per_month(ledger: DataFrame, k: int = 5) -> DataFrame:
    rows = ledger.filter(is_category("Receipt"))
    t = rows.groupBy(F.trunc("txn_date", "MM").alias("m"), F.col("particulars").alias("customer")).agg(
        F.sum("credit_amount").alias("s")
    )
    top = top_k_per_group(t, ["m"], [F.col("s").desc(), F.col("customer")], k)
    return top.select(month_bucket(F.col("m")).alias(MONTH), "position", "customer", half_up(F.col("s"), 2).alias("received")).orderBy(
        MONTH, "position"
    )


def rfm_scatter(rfm: DataFrame) -> DataFrame:
    return rfm.select("customer", "frequency", "monetary", "recency", "segment")


def at_risk_count(rfm: DataFrame) -> DataFrame:
    t = rfm.agg(
        count_where(F.col("segment") == "At Risk").alias("at_risk_customers"), F.count(F.lit(1)).alias("customers")
    )
    return t.withColumn("action_needed", F.col("at_risk_customers") > 0)


def margin_colours(ledger: DataFrame, green: float = 30.0, yellow: float = 15.0) -> DataFrame:
    m = monthly_margin(ledger)
    pct = F.col("margin_pct")
    colour = F.when(pct > green, "green").when(pct >= yellow, "yellow").otherwise("red")
    return m.select(MONTH, pct.cast("double").alias("margin_pct"), colour.alias("colour")).orderBy(MONTH)


def anomaly_series(ledger: DataFrame) -> DataFrame:
    """Sales with the flag of their voucher number and the mean of all sales."""
    sales = ledger.filter(is_category("Sales") & (F.col("debit_amount") > 0)).select(
        "txn_date", "particulars", "vch_no", "debit_amount"
    )
    flagged = iqr_anomalies(sales, "particulars", "debit_amount")
    flags = flagged.groupBy("vch_no").agg(F.min("flag_type").alias("flag_type"))
    mean = sales.agg(F.sum("debit_amount").alias("s"), F.count(F.lit(1)).alias("n"))
    joined = attach_row(join_per_key(sales, flags, "vch_no", "left"), mean)
    return joined.select(
        iso(F.col("txn_date")).alias("txn_date"),
        "vch_no",
        half_up(F.col("debit_amount"), 2).alias("amount"),
        F.coalesce("flag_type", F.lit("Normal")).alias("flag_type"),
        half_up(ratio(F.col("s"), F.col("n")), 2).alias("overall_mean"),
    )


def recency_bands(churn: DataFrame, config: ChurnConfig = ChurnConfig()) -> DataFrame:
    days = F.col("days_since_last")
    band = (
        F.when(days <= config.active_days, 1)
        .when(days <= config.low_days, 2)
        .when(days <= config.medium_days, 3)
        .otherwise(4)
    )
    return churn.select("customer", days, "churn_status", band.alias("threshold_band"))


def year_comparison(churn: DataFrame, n: int = 15) -> DataFrame:
    """Customers of both years with the largest current revenue."""
    both = churn.filter((F.col("orders_prior") > 0) & (F.col("orders_current") > 0))
    top = both.orderBy(F.col("revenue_current_lakhs").desc(), "customer").limit(n)
    return top.select("customer", "churn_status", "revenue_prior_lakhs", "revenue_current_lakhs")


def collection_rates(payment: DataFrame, cap: float = 150.0) -> DataFrame:
    """Collection rate per customer, cut off for display."""
    return payment.select(
        "customer", "risk_tier", F.least(F.col("collection_rate_pct"), F.lit(cap)).alias("shown_rate_pct")
    )
