import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.functions.calendar import ledger_calendar, with_calendar
from vouchermill.operators.slicers import ledger_of_days
from vouchermill.plans import catalog
from vouchermill.schemas import LEDGER
from vouchermill.sources.ledger_store import published_number, read_store, replace_years
from vouchermill.sources.readers import read_clean_ledger
from vouchermill.sources.writers import write_ledger

FIRST = [
    ("2023-05-01", "A", "Sales", 5), ("2023-06-01", "B", "Contra", 1), ("2024-05-01", "A", "Sales", 7),
    ("2024-06-01", "B", "Purchase", 9),
]


def full(ledger):
    return with_calendar(ledger).withColumn("source_year", F.lit("x")).select(*LEDGER.fieldNames())


def short(df):
    return [(r["fiscal_year"], r["txn_category"], int(r["debit_amount"] + r["credit_amount"])) for r in rows_of(df, "txn_date", "vch_no")]


def files_of(store):
    found = {}
    for folder, _, names in os.walk(os.path.join(store, "data")):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(folder, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def test_a_year_is_replaced_and_others_stay(spark, make_ledger, tmp_path):
    store = str(tmp_path / "store")
    assert published_number(spark, store) == 0 and read_store(spark, store).count() == 0
    assert replace_years(full(make_ledger(FIRST)), store, ("2023-24", "2024-25")) == 1
    before, old = files_of(store), read_store(spark, store)
    assert read_store(spark, store).columns == LEDGER.fieldNames()
    # the new rows of the year have no Contra any more
    assert replace_years(full(make_ledger([("2023-07-01", "C", "Sales", 8)])), store, ("2023-24",)) == 2
    assert short(read_store(spark, store)) == [("2023-24", "Sales", 8), ("2024-25", "Sales", 7), ("2024-25", "Purchase", 9)]
    assert {p: t for p, t in files_of(store).items() if p in before} == before
    # a reader that began before still sees the old year, whole
    assert short(old)[:2] == [("2023-24", "Sales", 5), ("2023-24", "Contra", 1)]
    assert short(read_store(spark, store, "2023-24")) == [("2023-24", "Sales", 8)]
    # a year without rows is empty afterwards, a store without years too
    replace_years(full(make_ledger([])), store, ("2024-25",))
    assert short(read_store(spark, store)) == [("2023-24", "Sales", 8)]
    assert replace_years(full(make_ledger([])), store, ("2023-24",)) == 4
    assert read_store(spark, store).count() == 0


def test_a_new_year_made_from_the_store_itself(spark, make_ledger, tmp_path):
    store = str(tmp_path / "store")
    replace_years(full(make_ledger(FIRST)), store, ("2023-24", "2024-25"))
    more = read_store(spark, store, "2023-24").withColumn("debit_amount", (F.col("debit_amount") * 2).cast("decimal(18,2)"))
    replace_years(more, store, ("2023-24",))
    got = [r["debit_amount"] for r in rows_of(read_store(spark, store, "2023-24"), "txn_date")]
    assert got == [Decimal("10.00"), Decimal("0.00")]


def test_nothing_is_published_by_a_failed_write(spark, make_ledger, tmp_path):
    store = str(tmp_path / "store")
    replace_years(full(make_ledger(FIRST)), store, ("2023-24", "2024-25"))
    with pytest.raises(Exception, match="another fiscal year"):
        replace_years(full(make_ledger(FIRST)), store, ("2023-24",))
    no_year = full(make_ledger(FIRST)).withColumn("fiscal_year", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="another fiscal year"):
        replace_years(no_year, store, ("2023-24",))
    with pytest.raises(ValueError, match="came after"):
        replace_years(full(make_ledger(FIRST[:2])), store, ("2023-24",), read_number=0)
    # a publication that has begun and has no file yet
    os.makedirs(os.path.join(store, "published", "number=2", "_temporary"))
    assert published_number(spark, store) == 1 and len(short(read_store(spark, store))) == 4


def test_years_without_a_day_of_the_calendar_are_pruned_at_run_time(spark, make_ledger, tmp_path):
    rows = [("2020-12-31", "A", "Sales", 5), ("2020-12-31", "B", "Purchase", 6), ("2020-12-20", "A", "Sales", 8), ("2022-12-31", "A", "Sales", 7)]
    path = str(tmp_path / "ledger")
    write_ledger(full(make_ledger(rows)), path)
    stored = read_clean_ledger(spark, path)
    days = ledger_calendar(stored).filter(F.col("week_no") == 53)
    found = ledger_of_days(stored, days.unionByName(days))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(short(found)) == [("2020-21", "Purchase", 6), ("2020-21", "Sales", 5)]


def test_columns_that_follow_from_others_are_not_shuffled(spark, make_ledger, tmp_path, monkeypatch):
    asked, path = [], str(tmp_path / "ledger")
    monkeypatch.setattr(catalog, "shared_folder", lambda spark, purpose: path)
    monkeypatch.setattr(catalog.tables, "ledger", lambda spark, folder, derived=False: make_ledger(FIRST))
    monkeypatch.setattr(catalog, "write_ledger", lambda df, *a, **b: asked.append(df.columns) or write_ledger(df, *a, **b))
    got = rows_of(catalog._stored_ledger(spark, ""), "txn_date", "vch_no")
    want = rows_of(full(make_ledger(FIRST)).withColumn("source_year", F.lit("trade")), "txn_date", "vch_no")
    assert got == want
    assert not {"month_name", "day_of_week", "quarter", "month_num", "source_year"} & set(asked[0])
