"""Fiscal-calendar columns. All are plain Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

FY_START = 4

# Month names in fiscal order for an April start.
FISCAL_MONTH_NAMES = (
    "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Jan", "Feb", "Mar",
)


def fiscal_start_year(d: Column, start_month: int = FY_START) -> Column:
    return F.year(d) - F.when(F.month(d) < start_month, 1).otherwise(0)


def fiscal_label(y: Column) -> Column:
    """``2024-25`` for the start year 2024."""
    return F.concat(
        y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0")
    )


def fiscal_year(d: Column, start_month: int = FY_START) -> Column:
    """``2024-25`` for dates from April 2024 to March 2025."""
    return fiscal_label(fiscal_start_year(d, start_month))


def fiscal_month_num(d: Column, start_month: int = FY_START) -> Column:
    return F.pmod(F.month(d) - start_month, F.lit(12)) + 1


def fiscal_quarter_num(d: Column, start_month: int = FY_START) -> Column:
    return F.floor(F.pmod(F.month(d) - start_month, F.lit(12)) / 3) + 1


def fiscal_quarter(d: Column, start_month: int = FY_START) -> Column:
    return F.concat(F.lit("Q"), fiscal_quarter_num(d, start_month).cast("string"))


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMM")


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def month_bucket(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def fiscal_year_bounds(fy: str, start_month: int = FY_START) -> tuple[dt.date, dt.date]:
    """First day of the fiscal year and first day after it."""
    y = int(fy[:4])
    return dt.date(y, start_month, 1), dt.date(y + 1, start_month, 1)


def in_fiscal_year(fy: str, date: str = "txn_date", start_month: int = FY_START) -> Column:
    """Date-range form of ``fiscal_year = fy``: a plain comparison on the date
    reaches the Parquet row-group statistics, a derived label does not."""
    first, after = fiscal_year_bounds(fy, start_month)
    return (F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(after))


def of_fiscal_years(ledger: DataFrame, *years: str) -> DataFrame:
    """Rows of some fiscal years. Where the ledger has the year as a column, which
    a stored one is partitioned by, an equality on it prunes whole folders."""
    wanted = in_fiscal_year(years[0])
    for fy in years[1:]:
        wanted = wanted | in_fiscal_year(fy)
    if "fiscal_year" in ledger.columns:
        wanted = wanted & F.col("fiscal_year").isin(*years)
    return ledger.filter(wanted)


def calendar_columns(d: Column, start_month: int = FY_START) -> dict[str, Column]:
    return {
        "fiscal_year": fiscal_year(d, start_month),
        "month_num": F.month(d),
        "fiscal_month_num": fiscal_month_num(d, start_month),
        "month_name": month_name(d),
        "day_of_week": day_name(d),
        "quarter": fiscal_quarter(d, start_month),
    }


def with_calendar(df: DataFrame, date: str = "txn_date", start_month: int = FY_START) -> DataFrame:
    """Add every derived date column; those a query does not read are pruned."""
    return df.withColumns(calendar_columns(F.col(date), start_month))


def calendar(bounds: DataFrame, start_month: int = FY_START) -> DataFrame:
    """One row per day between ``bounds.start`` and ``bounds.end`` (inclusive)."""
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("date"))
    d = F.col("date")
    return days.select(
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month_num"),
        month_name(d).alias("month_name"),
        fiscal_quarter(d, start_month).alias("quarter"),
        fiscal_year(d, start_month).alias("fy"),
        fiscal_month_num(d, start_month).alias("month_sort"),
        F.weekofyear(d).alias("week_no"),
    )


def ledger_calendar(ledger: DataFrame, start_month: int = FY_START) -> DataFrame:
    """Calendar over the whole fiscal years the ledger touches."""
    span = ledger.agg(F.min("txn_date").alias("lo"), F.max("txn_date").alias("hi"))
    bounds = span.select(
        F.make_date(fiscal_start_year(F.col("lo"), start_month), F.lit(start_month), F.lit(1)).alias("start"),
        F.date_sub(
            F.make_date(fiscal_start_year(F.col("hi"), start_month) + 1, F.lit(start_month), F.lit(1)), 1
        ).alias("end"),
    )
    return calendar(bounds.filter(F.col("start").isNotNull()), start_month)
