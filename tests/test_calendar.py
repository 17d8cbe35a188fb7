import datetime as dt

from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.functions import calendar as cal

CASES = {
    # date: fiscal year, fiscal month, quarter, month, weekday
    "2024-03-31": ("2023-24", 12, "Q4", "Mar", "Sunday"),
    "2024-04-01": ("2024-25", 1, "Q1", "Apr", "Monday"),
    "2024-12-31": ("2024-25", 9, "Q3", "Dec", "Tuesday"),
    "2025-01-01": ("2024-25", 10, "Q4", "Jan", "Wednesday"),
    "2000-02-29": ("1999-00", 11, "Q4", "Feb", "Tuesday"),
    "1999-04-01": ("1999-00", 1, "Q1", "Apr", "Thursday"),
    "2025-07-15": ("2025-26", 4, "Q2", "Jul", "Tuesday"),
}


def test_derived_columns(spark):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in CASES], "txn_date date")
    for r in cal.with_calendar(df).collect():
        want = CASES[r.txn_date.isoformat()]
        assert (r.fiscal_year, r.fiscal_month_num, r.quarter, r.month_name, r.day_of_week) == want
        assert r.month_num == r.txn_date.month


def test_other_start_month(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 30),), (dt.date(2024, 7, 1),)], "txn_date date")
    got = [r[0] for r in df.select(cal.fiscal_year(F.col("txn_date"), 7)).collect()]
    assert got == ["2023-24", "2024-25"]


def test_fiscal_year_range_equals_label(spark):
    days = spark.sql("select explode(sequence(date'1998-03-20', date'2002-04-10', interval 1 day)) as txn_date")
    both = days.select(
        cal.in_fiscal_year("1999-00").alias("a"), (cal.fiscal_year(F.col("txn_date")) == "1999-00").alias("b")
    )
    assert both.filter("a <> b").count() == 0
    assert both.filter("a").count() == 366


def test_calendar_covers_whole_years(spark):
    ledger = spark.createDataFrame([(dt.date(1999, 12, 5),), (dt.date(2000, 6, 1),)], "txn_date date")
    days = rows_of(cal.ledger_calendar(ledger), "date")
    assert (days[0]["date"], days[-1]["date"], len(days)) == (dt.date(1999, 4, 1), dt.date(2001, 3, 31), 731)
    jan = next(d for d in days if d["date"] == dt.date(2000, 1, 15))
    assert (jan["fy"], jan["quarter"], jan["month_num"], jan["month_sort"], jan["year"]) == ("1999-00", "Q4", 1, 10, 2000)


def test_calendar_of_nothing(spark):
    assert cal.ledger_calendar(spark.createDataFrame([], "txn_date date")).count() == 0
