"""Customer scoring: recency-frequency-monetary, payment risk and churn.

Every profile is one conditional aggregate per party over the ledger rows. The
reference date is a one-row aggregate used as a scalar subquery, never collected.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from vouchermill.config import ActionTexts, ChurnConfig, PaymentConfig, RfmConfig, RfmMinMaxConfig
from vouchermill.functions.calendar import in_fiscal_year, iso
from vouchermill.functions.categories import is_category
from vouchermill.functions.measures import count_where, sum_where
from vouchermill.functions.numeric import band, exact, half_up, lakhs, lakhs_exact, percent
from vouchermill.functions.parsing import label_rank, label_text
from vouchermill.operators.joins import attach_row
from vouchermill.operators.ranking import top_k_per_group

_TEXTS = ActionTexts.default()


def _until(df: DataFrame, as_of: str | None) -> DataFrame:
    """Rows known on a given reference date."""
    return df.filter(F.col("txn_date") <= F.lit(as_of).cast("date")) if as_of else df


def _with_as_of(totals: DataFrame, as_of: str | None, days_after: int = 0) -> DataFrame:
    """Attach the reference date: a given day, or the last day of all parties.

    The subquery reads every column of ``totals``, so it needs the very shuffle of
    the outer query and Spark runs that once.
    """
    if as_of:
        return totals.withColumn("as_of", F.lit(as_of).cast("date"))
    latest = totals.agg(*[F.max(c).alias(f"max_{c}") for c in totals.columns])
    dated = attach_row(totals, latest)
    return dated.select(*totals.columns, F.date_add("max_last", days_after).alias("as_of"))


# ---------------------------------------------------------------- RFM


def rfm_totals(ledger: DataFrame, as_of: str | None = None, party: str = "particulars") -> DataFrame:
    """Recency, frequency and monetary value of each party with positive sales."""
    sales = _until(ledger, as_of).filter(is_category("Sales") & (F.col("debit_amount") > 0))
    totals = sales.groupBy(F.col(party).alias("customer")).agg(
        F.max("txn_date").alias("last"),
        F.min("txn_date").alias("first"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("debit_amount").alias("monetary"),
    )
    dated = _with_as_of(totals, as_of, days_after=1)
    return dated.withColumn("recency", F.datediff("as_of", "last").cast("bigint")).drop("as_of")


def rfm_segment(score: Column, r: Column, m: Column) -> Column:
    return (
        F.when(score >= 4, "Champion")
        .when((score >= 3) & (r >= 3), "Loyal")
        .when((score >= 3) & (r < 3), "At Risk")
        .when((score >= 2) & (r >= 3), "Promising")
        .when((r <= 2) & (m >= 3), "At Risk")
        .otherwise("Lost")
    )


def rfm_score_columns(df: DataFrame, config: RfmConfig = RfmConfig()) -> DataFrame:
    """Band scores, weighted score (DECIMAL) and segment from the three totals."""
    scored = df.withColumns(
        {
            "r_score": band(F.col("recency"), config.recency_edges, config.recency_scores),
            "f_score": band(F.col("frequency"), config.frequency_edges, config.frequency_scores),
            "m_score": band(F.col("monetary"), config.monetary_edges, config.monetary_scores),
        }
    )
    wr, wf, wm = config.weights
    points = F.col("r_score") * wr + F.col("f_score") * wf + F.col("m_score") * wm
    scored = scored.withColumn("rfm_score", F.round(points.cast("decimal(10,0)") * F.lit(Decimal("0.01")), 2))
    return scored.withColumn("segment", rfm_segment(F.col("rfm_score"), F.col("r_score"), F.col("m_score")))


def rfm_banded(
    ledger: DataFrame,
    as_of: str | None = None,
    config: RfmConfig = RfmConfig(),
    texts: ActionTexts = _TEXTS,
    party: str = "particulars",
) -> DataFrame:
    scored = rfm_score_columns(rfm_totals(ledger, as_of, party), config)
    return scored.select(
        "customer",
        "segment",
        F.col("rfm_score").cast("double").alias("rfm_score"),
        "r_score",
        "f_score",
        "m_score",
        "recency",
        "frequency",
        half_up(F.col("monetary"), 2).alias("monetary"),
        lakhs(F.col("monetary")).alias("revenue_lakhs"),
        iso(F.col("first")).alias("first_purchase"),
        iso(F.col("last")).alias("last_purchase"),
        label_text(F.col("segment"), texts.rfm).alias("recommended_action"),
    )


def by_score(rfm: DataFrame) -> DataFrame:
    """Presentation order. The name breaks ties, which also lets Spark split the
    many customers that share a score over several tasks."""
    return rfm.orderBy(F.col("rfm_score").desc(), "customer")


def rfm_minmax(
    ledger: DataFrame, as_of: str | None = None, config: RfmMinMaxConfig = RfmMinMaxConfig()
) -> DataFrame:
    """Min-max normalised scores with left-open label ranges."""
    totals = rfm_totals(ledger, as_of)
    names = ("recency", "frequency", "monetary")
    limits = totals.agg(
        *[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]
    )
    joined = attach_row(totals, limits)

    def scaled(n: str) -> Column:
        low = F.col(f"lo_{n}").cast("double")
        return F.coalesce(
            F.try_divide(F.col(n).cast("double") - low, F.col(f"hi_{n}").cast("double") - low), F.lit(0.0)
        )

    n = joined.withColumns(
        {
            "recency_n": 1.0 - scaled("recency"),
            "frequency_n": scaled("frequency"),
            "monetary_n": scaled("monetary"),
        }
    )
    wr, wf, wm = config.weights
    score = F.col("recency_n") * wr + F.col("frequency_n") * wf + F.col("monetary_n") * wm
    n = n.withColumn("score", exact(score, 6))
    label = F.lit(None).cast("string")
    for low, high, name in zip(config.cuts, config.cuts[1:], config.labels):
        test = (F.col("score") > Decimal(str(low))) & (F.col("score") <= Decimal(str(high)))
        label = F.when(test, name).otherwise(label)
    return n.select(
        "customer",
        "recency",
        "frequency",
        half_up(F.col("monetary"), 2).alias("monetary"),
        *[half_up(F.col(c), 6).alias(c) for c in ("recency_n", "frequency_n", "monetary_n")],
        F.col("score").cast("double").alias("rfm_score"),
        label.alias("segment"),
    )


def segment_summary(rfm: DataFrame) -> DataFrame:
    totals = rfm.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("monetary").cast("decimal(28,2)")).alias("m"),
        F.sum("recency").alias("r"),
        F.sum("frequency").alias("f"),
    )
    mean = lambda c: F.try_divide(F.col(c).cast("double"), F.col("customers").cast("double"))
    return totals.select(
        "segment",
        "customers",
        lakhs(F.col("m"), 1).alias("revenue_lakhs"),
        half_up(mean("r"), 0).alias("avg_recency"),
        half_up(mean("f"), 1).alias("avg_frequency"),
    ).orderBy("segment")


def top_customers_per_segment(rfm: DataFrame, k: int = 5) -> DataFrame:
    order = [F.col("rfm_score").desc(), F.col("monetary").desc(), F.col("customer")]
    top = top_k_per_group(rfm, ["segment"], order, k)
    return top.select("segment", "position", "customer", "rfm_score", "revenue_lakhs", "last_purchase").orderBy(
        "segment", "position"
    )


# ---------------------------------------------------------------- payment risk


def payment_tier(rate: Column, received: Column, invoiced: Column, config: PaymentConfig = PaymentConfig()) -> Column:
    """Tier from the rounded collection rate.

    Without invoiced value the rate has no number: money received makes an
    advance payer, nothing received is high risk.
    """
    return (
        F.when((invoiced == 0) & (received > 0), "Advance Payer")
        .when(invoiced == 0, "High Risk")
        .when(rate > 100, "Advance Payer")
        .when((received == 0) & (invoiced > 0), "High Risk")
        .when(rate >= config.excellent, "Excellent")
        .when(rate >= config.good, "Good")
        .when(rate >= config.moderate, "Moderate Risk")
        .otherwise("High Risk")
    )


def payment_totals(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    """Invoices and receipts of each customer.

    Sales and receipts share one aggregate; parties without a sale drop out
    afterwards, which is what the semi join and the left join would give.
    """
    sale, receipt = is_category("Sales"), is_category("Receipt")
    rows = ledger.filter(is_category("Sales", "Receipt"))
    totals = rows.groupBy(F.col(party).alias("customer")).agg(
        sum_where(sale, "debit_amount").alias("invoiced"),
        count_where(sale).alias("num_invoices"),
        F.min(F.when(sale, F.col("txn_date"))).alias("first_invoice"),
        F.max(F.when(sale, F.col("txn_date"))).alias("last_invoice"),
        sum_where(receipt, "credit_amount").alias("received"),
        count_where(receipt).alias("num_receipts"),
        F.max(F.when(receipt, F.col("txn_date"))).alias("last_payment"),
    )
    return totals.filter(F.col("num_invoices") > 0)


def payment_profile(
    ledger: DataFrame,
    all_dates: DataFrame,
    as_of: str | None = None,
    config: PaymentConfig = PaymentConfig(),
    texts: ActionTexts = _TEXTS,
    party: str = "particulars",
) -> DataFrame:
    """Payment behaviour, tier and action of each customer.

    ``all_dates`` is the whole ledger: its last day is the default reference
    date, read as a one-row aggregate of the date column only.
    """
    totals = payment_totals(_until(ledger, as_of), party)
    if as_of:
        dated = totals.withColumn("as_of", F.lit(as_of).cast("date"))
    else:
        dated = attach_row(totals, all_dates.agg(F.max("txn_date").alias("as_of")))
    invoiced, received = F.col("invoiced"), F.col("received")
    rate = exact(percent(received, invoiced), 1)
    days = F.datediff("as_of", "last_payment")
    rated = dated.withColumns(
        {
            "rate": rate,
            "outstanding": invoiced - received,
            "days": F.coalesce(days, F.lit(config.never_paid_days)).cast("bigint"),
        }
    ).withColumn("risk_tier", payment_tier(F.col("rate"), received, invoiced, config))
    return rated.select(
        "customer",
        "risk_tier",
        F.col("rate").cast("double").alias("collection_rate_pct"),
        lakhs(invoiced).alias("invoiced_lakhs"),
        lakhs(received).alias("received_lakhs"),
        lakhs(F.col("outstanding")).alias("outstanding_lakhs"),
        half_up(F.col("outstanding"), 2).alias("outstanding"),
        "num_invoices",
        "num_receipts",
        iso(F.col("first_invoice")).alias("first_invoice"),
        iso(F.col("last_invoice")).alias("last_invoice"),
        F.coalesce(iso(F.col("last_payment")), F.lit(config.never_paid_text)).alias("last_payment"),
        F.col("days").alias("days_since_pay"),
        label_text(F.col("risk_tier"), texts.payment).alias("recommended_action"),
    )


def by_tier(payment: DataFrame) -> DataFrame:
    return payment.orderBy("risk_tier", F.col("outstanding_lakhs").desc(), "customer")


def receipt_summary(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    """Received amount, count and last payment of customers that paid."""
    paid = payment_totals(ledger, party).filter(F.col("num_receipts") > 0)
    return paid.select(
        "customer",
        half_up(F.col("received"), 2).alias("received"),
        "num_receipts",
        iso(F.col("last_payment")).alias("last_payment"),
    )


def tier_summary(ledger: DataFrame, config: PaymentConfig = PaymentConfig(), party: str = "particulars") -> DataFrame:
    """Customers, invoiced and outstanding value per tier, and over all tiers the
    collection rate, the total and the positive-only outstanding value."""
    totals = payment_totals(ledger, party)
    invoiced, received = F.col("invoiced"), F.col("received")
    rated = totals.select(
        payment_tier(exact(percent(received, invoiced), 1), received, invoiced, config).alias("risk_tier"),
        invoiced,
        received,
        (invoiced - received).alias("due"),
        lakhs_exact(invoiced).alias("il"),
        lakhs_exact(invoiced - received).alias("ol"),
    )
    per_tier = rated.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("il").alias("il"),
        F.sum("ol").alias("ol"),
        F.sum("invoiced").alias("i"),
        F.sum("received").alias("r"),
        F.sum(F.greatest(F.col("due"), F.lit(0).cast("decimal(18,2)"))).alias("pos"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "il", "ol", "i", "r", "pos")]
    overall = per_tier.agg(*sums).select(F.lit("all").alias("risk_tier"), "n", "il", "ol", "i", "r", "pos")
    return (
        per_tier.unionByName(overall)
        .select(
            "risk_tier",
            F.col("n").cast("bigint").alias("customers"),
            half_up(F.col("il"), 2).alias("invoiced_lakhs"),
            half_up(F.col("ol"), 2).alias("outstanding_lakhs"),
            half_up(percent(F.col("r"), F.col("i")), 1).alias("collection_rate_pct"),
            half_up(F.col("i") - F.col("r"), 2).alias("outstanding"),
            half_up(F.col("pos"), 2).alias("positive_outstanding"),
        )
        .orderBy("risk_tier")
    )


# ---------------------------------------------------------------- churn


def churn_status(days: Column, prior: Column, current: Column, config: ChurnConfig = ChurnConfig()) -> Column:
    return (
        F.when((prior > 0) & (current == 0), "Churned")
        .when((prior == 0) & (current > 0), "New Customer")
        .when(days <= config.active_days, "Active")
        .when(days <= config.low_days, "Low Risk")
        .when(days <= config.medium_days, "Medium Risk")
        .otherwise("High Risk")
    )


def fiscal_split(ledger: DataFrame, prior: str, current: str, party: str = "particulars") -> DataFrame:
    """Sales of each party overall and in two fiscal years, in one aggregate."""
    sales = ledger.filter(is_category("Sales"))
    was, now = in_fiscal_year(prior), in_fiscal_year(current)
    return sales.groupBy(F.col(party).alias("customer")).agg(
        F.min("txn_date").alias("first"),
        F.max("txn_date").alias("last"),
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("debit_amount").alias("revenue"),
        count_where(was).alias("orders_prior"),
        count_where(now).alias("orders_current"),
        sum_where(was, "debit_amount").alias("revenue_prior"),
        sum_where(now, "debit_amount").alias("revenue_current"),
    )


def fy_split_per_customer(ledger: DataFrame, prior: str, current: str, party: str = "particulars") -> DataFrame:
    return fiscal_split(ledger, prior, current, party).select(
        "customer",
        "orders_prior",
        half_up(F.col("revenue_prior"), 2).alias("revenue_prior"),
        "orders_current",
        half_up(F.col("revenue_current"), 2).alias("revenue_current"),
    )


def churn_profile(
    ledger: DataFrame,
    prior: str,
    current: str,
    as_of: str | None = None,
    config: ChurnConfig = ChurnConfig(),
    texts: ActionTexts = _TEXTS,
    party: str = "particulars",
) -> DataFrame:
    """Status, revenue change and revenue at risk of each customer."""
    split = fiscal_split(_until(ledger, as_of), prior, current, party)
    totals = _with_as_of(split, as_of)
    prior_l, current_l = lakhs_exact(F.col("revenue_prior")), lakhs_exact(F.col("revenue_current"))
    days = F.datediff("as_of", "last").cast("bigint")
    change = percent(F.col("revenue_current") - F.col("revenue_prior"), F.col("revenue_prior"))
    named = totals.withColumn("days", days).withColumn(
        "churn_status", churn_status(F.col("days"), F.col("orders_prior"), F.col("orders_current"), config)
    )
    revenue = lakhs(F.col("revenue"))
    at_risk = F.col("churn_status").isin(*config.at_risk)
    return named.select(
        "customer",
        "churn_status",
        F.col("days").alias("days_since_last"),
        revenue.alias("revenue_lakhs"),
        prior_l.cast("double").alias("revenue_prior_lakhs"),
        current_l.cast("double").alias("revenue_current_lakhs"),
        F.round(current_l - prior_l, 2).cast("double").alias("revenue_change_lakhs"),
        F.when(F.col("revenue_prior") > 0, half_up(change, 1)).alias("revenue_change_pct"),
        "total_orders",
        "orders_prior",
        "orders_current",
        iso(F.col("first")).alias("first_purchase"),
        iso(F.col("last")).alias("last_purchase"),
        F.when(at_risk, revenue).otherwise(0.0).alias("revenue_at_risk_lakhs"),
        label_text(F.col("churn_status"), texts.churn).alias("recommended_action"),
    )


def by_status(churn: DataFrame, config: ChurnConfig = ChurnConfig()) -> DataFrame:
    rank = label_rank(F.col("churn_status"), config.order)
    return churn.orderBy(rank, F.col("revenue_lakhs").desc(), "customer")


def churn_summary(churn: DataFrame, config: ChurnConfig = ChurnConfig()) -> DataFrame:
    def total(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(28,2)"))

    totals = churn.groupBy("churn_status").agg(
        F.count(F.lit(1)).alias("customers"),
        total("revenue_lakhs").alias("a"),
        total("revenue_at_risk_lakhs").alias("b"),
    )
    return totals.select(
        (label_rank(F.col("churn_status"), config.order) + 1).alias("status_order"),
        "churn_status",
        "customers",
        half_up(F.col("a"), 2).alias("revenue_lakhs"),
        half_up(F.col("b"), 2).alias("revenue_at_risk_lakhs"),
    ).orderBy("status_order")


def churn_impact(churn: DataFrame) -> DataFrame:
    """Revenue lost, at risk and gained, and the net effect."""

    def total(status: str, c: str) -> Column:
        value = F.when(F.col("churn_status") == status, F.col(c).cast("decimal(28,2)"))
        return F.coalesce(F.sum(value), F.lit(0).cast("decimal(28,2)"))

    t = churn.agg(
        total("Churned", "revenue_prior_lakhs").alias("lost"),
        total("High Risk", "revenue_lakhs").alias("risk"),
        total("New Customer", "revenue_current_lakhs").alias("new"),
    )
    return t.select(
        half_up(F.col("lost"), 1).alias("churned_lakhs"),
        half_up(F.col("risk"), 1).alias("high_risk_lakhs"),
        half_up(F.col("new"), 1).alias("new_lakhs"),
        half_up(F.col("new") - F.col("lost"), 1).alias("net_impact_lakhs"),
    )


def churn_lists(churn: DataFrame) -> DataFrame:
    """Four ordered lists: churned, high risk, new, and buyers of both years.

    Each customer is emitted once per list it belongs to, from one pass.
    """
    status = F.col("churn_status")
    both = (F.col("orders_prior") > 0) & (F.col("orders_current") > 0)

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("list_name"), value.alias("order_value"))

    entries = F.array(
        F.when(status == "Churned", entry("churned", -F.col("revenue_prior_lakhs"))),
        F.when(status == "High Risk", entry("high_risk", -F.col("revenue_lakhs"))),
        F.when(status == "New Customer", entry("new", -F.col("revenue_current_lakhs"))),
        F.when(both, entry("both_years", F.col("revenue_change_pct"))),
    )
    listed = churn.select("*", F.explode(entries).alias("e")).filter(F.col("e").isNotNull())
    return listed.select(
        F.col("e.list_name").alias("list_name"),
        F.col("e.order_value").alias("order_value"),
        "customer",
        "churn_status",
        "revenue_lakhs",
        "revenue_prior_lakhs",
        "revenue_current_lakhs",
        "revenue_change_pct",
        "last_purchase",
        "days_since_last",
    ).orderBy("list_name", F.col("order_value").asc_nulls_last(), "customer")


def declining_customers(ledger: DataFrame, prior: str, current: str, party: str = "particulars") -> DataFrame:
    """Customers that still order, but less often than the year before."""
    t = fiscal_split(ledger, prior, current, party)
    was, now = F.col("orders_prior"), F.col("orders_current")
    falling = t.filter((now > 0) & (now < was))
    return falling.select(
        "customer",
        was,
        now,
        half_up(percent(was - now, was), 1).alias("drop_pct"),
        iso(F.col("last")).alias("last_purchase"),
    )

