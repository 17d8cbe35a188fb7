"""Every registered query against its SQL statement, on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as driver
import check

FOLDER = "/root/testdata/sf0.001"

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = check.connect(FOLDER)
    yield connection
    connection.close()


def own(names):
    """Names of the ledger queries; text queries have tests of their own."""
    return sorted(n for n in names if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_a_statement():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert own(driver.queries()) == own(driver.oracle_sql())


@needs_data
def test_entry(spark):
    assert driver.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", own(driver.queries()))
def test_query(spark, db, name):
    rows, problem = check.difference(driver.queries()[name](spark, FOLDER), db, driver.oracle_sql()[name])
    assert problem == ""


@needs_data
def test_reports_by_party_agree(spark):
    """Market totals are all sales, every customer has a market, and the feed flags what the list flags."""
    queries = driver.queries()
    star = queries["star_join"](spark, FOLDER).collect()
    total = sum(r.total_sales for r in queries["monthly_sales_trend"](spark, FOLDER).collect())
    assert all(r.market and r.nation for r in star)
    assert abs(sum(r.sales for r in star) - total) < 100  # the trend is rounded per month
    flagged = {r.vch_no for r in queries["iqr_anomalies"](spark, FOLDER).collect()}
    assert flagged == {r.vch_no for r in queries["feed_anomaly_series"](spark, FOLDER).collect() if r.flag_type != "Normal"}


@needs_data
def test_a_year_of_a_stored_ledger_reads_its_folders_only(spark, tmp_path):
    from vouchermill.functions.calendar import of_fiscal_years
    from vouchermill.sources import trade_tables
    from vouchermill.sources.readers import read_clean_ledger
    from vouchermill.sources.writers import write_ledger
    from vouchermill.schemas import LEDGER
    from pyspark.sql import functions as F

    rows = trade_tables.ledger(spark, FOLDER, derived=True).withColumn("source_year", F.lit("x"))
    write_ledger(rows.select(*LEDGER.fieldNames()), str(tmp_path / "ledger"))
    year = of_fiscal_years(read_clean_ledger(spark, str(tmp_path / "ledger")), "1999-00")
    plan = year._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert filters and all("fiscal_year" in f for f in filters)
    assert year.count() == rows.filter("fiscal_year = '1999-00'").count() > 0


@needs_data
@pytest.mark.parametrize("name", ["yoy_comparison", "feed_kpi_cards_sliced"])
def test_dates_reach_the_scans(spark, name):
    plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for date in ("o_orderdate", "l_shipdate"):
        assert f"GreaterThanOrEqual({date}" in plan and f"LessThan({date}" in plan
