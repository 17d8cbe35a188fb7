"""Measures for every combination of slicers in one pass.

Rows collapse to one per fiscal year, quarter and party, and the slices are
grouping sets over those. Distinct parties are not additive, their bitmaps are:
a party has a number, each year and quarter a bitmap of the numbers it saw, and a
slice counts the bits of the bitmaps it covers, whichever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchermill.functions.calendar import fiscal_label, fiscal_quarter_num, fiscal_start_year
from vouchermill.functions.measures import Names, derived_measures, measures_per_party
from vouchermill.functions.numeric import half_up

#: what a slicer shows when it selects everything
ALL = "all"
#: independent ranges of party numbers; a range is numbered in one task
RANGES = 256

_AMOUNTS = ("gross_sales", "purchase", "receipts", "payments", "net_sales", "gross_margin", "net_profit", "net_cash")


def per_period_party(ledger: DataFrame, names: Names | None = None) -> DataFrame:
    """Additive measures per fiscal year (``_y``), quarter (``_q``) and party; ``names`` as in the reports."""
    year = fiscal_start_year(F.col("txn_date")).alias("_y")
    return measures_per_party(ledger, [year, fiscal_quarter_num(F.col("txn_date")).alias("_q")], names=names)


def _additive(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_y", "_q", "particulars")]


def number_parties(rows: DataFrame) -> DataFrame:
    """Number of each party within a range (``_range``, ``_number``, from 0), equal
    for all its rows. Ranges are hashes of the party, so no task numbers them all."""
    ranged = rows.withColumn("_range", F.pmod(F.xxhash64("particulars"), F.lit(RANGES)).cast("int"))
    order = Window.partitionBy("_range").orderBy(F.col("particulars").asc_nulls_last())
    return ranged.withColumn("_number", F.dense_rank().over(order) - 1)


def party_bitmaps(rows: DataFrame) -> DataFrame:
    """Measures and bitmaps (all parties, those with sales) per year, quarter and
    block of party numbers. A row without a party sets no bit."""
    numbered = number_parties(rows).withColumn("_number", F.col("_number").cast("bigint"))
    bit = F.when(F.col("particulars").isNotNull(), F.bitmap_bit_position("_number"))
    block = F.bitmap_bucket_number("_number").alias("_block")
    return numbered.groupBy("_y", "_q", "_range", block).agg(
        *[F.sum(n).alias(n) for n in _additive(rows)],
        F.bitmap_construct_agg(bit).alias("_parties"),
        F.bitmap_construct_agg(F.when(F.col("sales_rows") > 0, bit)).alias("_buyers"),
    )


def _shown(level: str, text: Column, rolled_up: Column) -> Column:
    return F.when(rolled_up, F.lit(ALL)).otherwise(text).alias(level)


def _context(year_up: Column, quarter_up: Column) -> list[Column]:
    return [
        _shown("fiscal_year", fiscal_label(F.col("_y")), year_up),
        _shown("quarter", F.concat(F.lit("Q"), F.col("_q").cast("string")), quarter_up),
    ]


def measures_by_slicers(ledger: DataFrame, names: Names | None = None) -> DataFrame:
    """Measures, buyers and parties of every fiscal year, quarter, both and neither."""
    bitmaps = party_bitmaps(per_period_party(ledger, names))
    additive = [c for c in bitmaps.columns if not c.startswith("_")]
    block = ["_range", "_block"]
    sets = [[*block, *kept] for kept in (["_y", "_q"], ["_y"], ["_q"], [])]
    merged = bitmaps.groupingSets(sets, *block, "_y", "_q").agg(
        *[F.sum(n).alias(n) for n in additive],
        F.bitmap_count(F.bitmap_or_agg("_parties")).alias("parties"),
        F.bitmap_count(F.bitmap_or_agg("_buyers")).alias("active_customers"),
        F.grouping("_y").alias("_y_up"),
        F.grouping("_q").alias("_q_up"),
    )
    # blocks hold different parties, so their counts add up
    slices = merged.groupBy("_y", "_q", "_y_up", "_q_up").agg(
        *[F.sum(n).alias(n) for n in (*additive, "parties", "active_customers")]
    )
    full = slices.withColumns(derived_measures())
    return full.select(
        *_context(F.col("_y_up") == 1, F.col("_q_up") == 1),
        *[half_up(F.col(n), 2).alias(n) for n in _AMOUNTS],
        half_up(F.col("gross_margin_pct"), 1).alias("gross_margin_pct"),
        half_up(F.col("avg_invoice_value"), 2).alias("avg_invoice_value"),
        "sales_vouchers",
        "active_customers",
        "parties",
    )


def customers_by_slicers(ledger: DataFrame) -> DataFrame:
    """Sales, receipts and invoices of each customer for every year, quarter, both and neither.
    Rows without a party belong to no customer."""
    rows = per_period_party(ledger).filter(F.col("particulars").isNotNull())
    sets = [["particulars", *kept] for kept in (["_y", "_q"], ["_y"], ["_q"], [])]
    totals = rows.groupingSets(sets, "particulars", "_y", "_q").agg(
        *[F.sum(n).alias(n) for n in ("gross_sales", "receipts", "sales_vouchers")],
        F.grouping("_y").alias("_y_up"),
        F.grouping("_q").alias("_q_up"),
    )
    average = F.coalesce(
        F.try_divide(F.col("gross_sales").cast("double"), F.col("sales_vouchers").cast("double")), F.lit(0.0)
    )
    return totals.select(
        F.col("particulars").alias("customer"),
        *_context(F.col("_y_up") == 1, F.col("_q_up") == 1),
        half_up(F.col("gross_sales"), 2).alias("gross_sales"),
        half_up(F.col("receipts"), 2).alias("receipts"),
        "sales_vouchers",
        half_up(average, 2).alias("avg_invoice_value"),
    )


def ledger_of_days(stored: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a stored ledger on the days of a filtered calendar.

    The calendar names each day's fiscal year, by which the ledger is partitioned: the
    folders of years that the filter leaves no day of are pruned when the query runs.
    Days that occur twice do not double rows; days outside the ledger match nothing.
    """
    keys = days.select(F.col("date").alias("_day"), F.col("fy").alias("_fy"))
    # a calendar has one row per day of history, some ten thousand at most
    return stored.join(
        F.broadcast(keys), (F.col("fiscal_year") == F.col("_fy")) & (F.col("txn_date") == F.col("_day")), "left_semi"
    )
