"""Reports over a ledger that holds party codes, which are named after the rows have collapsed."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as driver
from conftest import rows_of
from vouchermill.operators import reports
from vouchermill.operators.slicers import measures_by_slicers
from vouchermill.plans import feeds
from vouchermill.sources import trade_tables as tables

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINES = (
    "l_orderkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture()
def folder(spark, tmp_path):
    """Customers and suppliers without a row, without a name, of one name, and a NULL key."""
    day = dt.datetime(2000, 3, 20)
    people = [(1, "Ann"), (2, "Ann"), (3, None), (5, "Eve"), (25, "Loan House")]
    orders = [(k, c, "F", 10.0 * k, day + dt.timedelta(k), "1-URGENT") for k, c in enumerate((1, 2, 3, 5, 5, 5, 25, 99, None), 1)]
    firms = [(1, "Loan Street"), (2, "Twin"), (3, "Twin"), (4, None), (10, "Ten")]
    lines = [(k, s, n, 2.0, 30.0 + k, 0.05, 0.1, "R", "F", day + dt.timedelta(k)) for k, s in enumerate((1, 2, 3, 4, 10, 77, None), 1) for n in (1, 2)]
    for name, rows, ddl in (
        ("customer", people, "c_custkey bigint, c_name string"), ("orders", orders, ORDERS),
        ("supplier", firms, "s_suppkey bigint, s_name string"), ("lineitem", lines, LINES),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(
    "report", [reports.financial_summary, reports.ledger_profile, reports.measures_by_year, feeds.kpi_cards, measures_by_slicers]
)
def test_ledger_reports_agree(spark, folder, report):
    plain = report(tables.ledger(spark, folder))
    coded = report(tables.ledger(spark, folder, party=tables.CODE), names=tables.with_names(spark, folder))
    assert rows_of(coded, *coded.columns) == rows_of(plain, *plain.columns) != []


def test_registers_agree(spark, folder):
    for report, register, column in (
        (reports.supplier_spend, tables.purchase_register, "supplier_name"),
        (feeds.supplier_buckets, tables.purchase_register, "supplier_name"),
        (reports.top_buyers, tables.sales_register, "buyer_name"),
    ):
        coded = report(register(spark, folder, tables.CODE), names=tables.with_names(spark, folder, column))
        assert rows_of(coded, column) == rows_of(report(register(spark, folder)), column) != []


def test_last_dates(spark, folder):
    last = max(r.txn_date for r in tables.last_dates(spark, folder).collect())
    assert last == max(r.txn_date for r in tables.ledger(spark, folder, party=False).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["financial_summary", "yoy_comparison", "supplier_spend", "feed_kpi_cards"])
def test_rows_collapse_before_they_meet_names(spark, name):
    plan = driver.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.split("\n")) if re.search(r"\bJoin\b", line)]
    first_scan = min(i for i, line in enumerate(plan.split("\n")) if "l_shipdate" in line and "Relation" in line)
    between = plan.split("\n")[joins[-1] : first_scan]
    assert len(joins) == 1 and any("Aggregate" in line for line in between)
