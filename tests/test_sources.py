import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from conftest import rows_of
from vouchermill.functions.calendar import with_calendar
from vouchermill.schemas import LEDGER, PURCHASE_REGISTER, SALES_REGISTER, apply_schema, ledger_schemas
from vouchermill.sources.readers import read_clean_ledger, read_daybook, read_register
from vouchermill.sources.writers import write_ledger, write_result


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Party,Value\n"Two\tlines\n",1\nplain,2\n"with ""quotes""",3\n')
    schema = StructType([StructField("party", StringType()), StructField("value", StringType())])
    got = rows_of(read_register(spark, str(path), schema), "value")
    assert [r["party"] for r in got] == ["Two\tlines", "plain", 'with "quotes"']


def test_daybook_is_all_text(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Banner\nDate,Particulars,Vch Type,Vch No.,Debit,Credit\n2024-05-01,A,Contra,1,5,\n")
    df = read_daybook(spark, str(path), keep_source_file=True)
    assert df.columns == [f"_c{i}" for i in range(6)] + ["_source_file"]
    assert df.count() == 3
    assert df.filter(F.col("_source_file").endswith("d.csv")).count() == 3


def test_exported_ledger(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text(
        "Date,Particulars,Vch_Type,Vch_No,Debit_Amount,Credit_Amount,FY,Month_Name,Day_of_Week,Month_Num,Quarter,Txn_Category\n"
        "2024-05-01,A,Contra,1,5.50,,2024-25,May,Wednesday,2,Q1,Contra\n"
        "01-06-2024,B,Contra,2,,7,2024-25,Jun,Saturday,3,Q1,Contra\n"
        "bad,C,Contra,3,,7,2024-25,Jun,Saturday,3,Q1,Contra\n"
    )
    df = read_clean_ledger(spark, str(path), "csv")
    assert df.columns == LEDGER.fieldNames()
    a, b = rows_of(df, "particulars")
    assert (a["debit_amount"], a["credit_amount"], a["fiscal_year"]) == (Decimal("5.50"), 0, "2024-25")
    assert (str(b["txn_date"]), b["fiscal_month_num"]) == ("2024-06-01", 3)


def test_schemas(spark):
    assert ledger_schemas() == {
        "ledger": LEDGER, "purchase_register": PURCHASE_REGISTER, "sales_register": SALES_REGISTER,
    }
    df = spark.createDataFrame(
        [(dt.date(2024, 5, 1), "A", None), (None, "B", 1.0), (dt.date(2024, 5, 1), None, 1.0)],
        "txn_date date, supplier_name string, purchase_amount double",
    )
    got = apply_schema(df, PURCHASE_REGISTER)
    assert got.columns == PURCHASE_REGISTER.fieldNames()
    assert rows_of(got)[0]["purchase_amount"] == 0 and got.count() == 1


def test_ledger_round_trip_prunes_folders(spark, make_ledger, tmp_path):
    rows = [("2024-05-01", "A", "Sales", 5), ("2025-05-01", "B", "Purchase", 7), ("2025-06-01", "A", "Sales", 9)]
    path = str(tmp_path / "ledger")
    write_ledger(with_calendar(make_ledger(rows)).withColumn("source_year", F.lit("x")), path)
    back = read_clean_ledger(spark, path)
    assert back.count() == 3
    one = back.filter("fiscal_year = '2025-26' and txn_category = 'Sales'")
    assert [int(r.debit_amount) for r in one.collect()] == [9]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fiscal_year" in plan


def test_large_folder_is_split_between_tasks(spark, tmp_path):
    # most rows in one folder: the writer must not send them to one task
    df = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 20 == 0, "2023-24").otherwise("2024-25").alias("fiscal_year"),
        F.lit("Sales").alias("txn_category"),
        F.expr("date'2024-05-01' + cast(id % 300 as int)").alias("txn_date"),
        F.xxhash64("id").alias("noise"),
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500KB")
    try:
        write_ledger(df, str(tmp_path / "ledger"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = list((tmp_path / "ledger" / "fiscal_year=2024-25").rglob("*.parquet"))
    assert len(files) > 2


def test_results_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_result(df, path, fmt)
        write_result(df.limit(1), path, fmt, order_by=["n"])
        reader = spark.read.option("header", True)
        assert (reader.csv(path) if fmt == "csv" else reader.parquet(path)).count() == 1
