"""Named measures: aggregate expressions usable under any ``groupBy``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vouchermill.config import CRORE
from vouchermill.functions.categories import is_category, party_contains
from vouchermill.functions.numeric import half_up, percent, ratio

#: puts party names in place of the codes of a column, keeping rows and the order of columns
Names = Callable[[DataFrame], DataFrame]


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def sum_where(condition: Column, amount: str) -> Column:
    """Conditional sum, 0 when no row qualifies."""
    # rows that do not qualify are NULL, which the sum skips without adding
    return F.coalesce(F.sum(F.when(condition, F.col(amount))), _zero())


def sum_of(category: str, amount: str) -> Column:
    return sum_where(is_category(category), amount)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _keyword(word: str, any_category: bool) -> Column:
    test = party_contains(word)
    # the cheap test first: the text is then searched in payments only
    return test if any_category else is_category("Payment") & test


def _additive(drawings: Column, loans: Column, vouchers: Column, sales_rows: Column) -> dict[str, Column]:
    return {
        "gross_sales": sum_of("Sales", "debit_amount"),
        "debit_notes": sum_of("Debit Note", "debit_amount"),
        "credit_notes": sum_of("Credit Note", "credit_amount"),
        "purchase": sum_of("Purchase", "credit_amount"),
        "operating_expenses": sum_of("Journal", "debit_amount"),
        "receipts": sum_of("Receipt", "credit_amount"),
        "payments": sum_of("Payment", "debit_amount"),
        "owner_drawings": sum_where(drawings, "debit_amount"),
        "loan_payments": sum_where(loans, "debit_amount"),
        "sales_vouchers": vouchers,
        "sales_rows": sales_rows,
    }


def base_measures(any_category: bool = False) -> dict[str, Column]:
    """Additive measures as aggregate expressions, one conditional sum each.

    ``any_category`` counts drawings and loan repayments whatever the voucher
    category; by default only payments count.
    """
    return _additive(
        _keyword("capital", any_category),
        _keyword("loan", any_category),
        F.count(F.when(is_category("Sales"), F.col("vch_no"))),
        count_where(is_category("Sales")),
    )


def derived_measures() -> dict[str, Column]:
    """Measures computed from the additive ones after aggregation."""
    gross, purchase = F.col("gross_sales"), F.col("purchase")
    net = gross + F.col("debit_notes") - F.col("credit_notes")
    margin = net - purchase
    profit = margin - F.col("operating_expenses")
    cash_out = F.col("payments") + F.col("operating_expenses")
    zero = F.lit(0.0)
    return {
        "net_sales": net,
        "gross_margin": margin,
        "gross_margin_pct": F.coalesce(percent(margin, net), zero),
        "blueprint_margin": gross - purchase,
        "blueprint_margin_ratio": F.coalesce(ratio(gross - purchase, gross), zero),
        "net_profit": profit,
        "net_profit_pct": F.coalesce(percent(profit, net), zero),
        "cash_out": cash_out,
        "net_cash": F.col("receipts") - cash_out,
        "net_cash_payments_only": F.col("receipts") - F.col("payments"),
        "avg_invoice_value": F.coalesce(ratio(gross, F.col("sales_vouchers")), zero),
    }


def _by_category(df: DataFrame, keys: list) -> DataFrame:
    """Sums by category: two a row in place of one per measure."""
    sales = is_category("Sales")
    return df.groupBy(*keys, "txn_category").agg(
        F.sum("debit_amount").alias("debit_amount"),
        F.sum("credit_amount").alias("credit_amount"),
        F.count(F.when(sales, F.col("vch_no"))).alias("_vouchers"),
        F.count(F.when(sales, F.lit(1))).alias("_sales"),
    )


def measure_totals(df: DataFrame, keys: list, any_category: bool = False, names: Names | None = None) -> DataFrame:
    """Every additive and derived measure per key, one pass over the rows.

    All measures are sums by category, so rows collapse to one per key and
    category first. A ledger whose parties are codes collapses per party as well;
    ``names`` then puts the names in, and only those groups meet the dimension.
    """
    if names:
        rows = names(_by_category(df, [*keys, "particulars"]))
        drawings, loans = _keyword("capital", any_category), _keyword("loan", any_category)
    else:
        words = [_keyword("capital", any_category).alias("_drawings"), _keyword("loan", any_category).alias("_loans")]
        rows = _by_category(df, [*keys, *words])
        drawings, loans = F.col("_drawings"), F.col("_loans")
    measures = _additive(drawings, loans, F.sum("_vouchers"), F.sum("_sales"))
    totals = rows.groupBy(*rows.columns[: len(keys)]).agg(*[c.alias(n) for n, c in measures.items()])
    return totals.withColumns(derived_measures())


def measures_per_party(
    df: DataFrame, keys: list, any_category: bool = False, party: str = "particulars", names: Names | None = None
) -> DataFrame:
    """Additive measures per key and party. Rows collapse to one per party and
    category first, so names are searched (and by ``names`` put in place of codes)
    once a group and not once a row."""
    rows = _by_category(df, [*keys, party])
    if names:
        rows = names(rows)
    measures = _additive(
        _keyword("capital", any_category), _keyword("loan", any_category), F.sum("_vouchers"), F.sum("_sales")
    )
    return rows.groupBy(*rows.columns[: len(keys)], party).agg(*[c.alias(n) for n, c in measures.items()])


def crores(c: Column, digits: int = 2) -> Column:
    return half_up(c.cast("double") / float(CRORE), digits)
