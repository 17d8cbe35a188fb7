from decimal import Decimal

from pyspark.sql import Observation, functions as F

from conftest import rows_of
from vouchermill.config import CATEGORY_PATTERNS, VOUCHER_TYPES
from vouchermill.functions.categories import categorise_exact, categorise_pattern, party_contains
from vouchermill.operators import cleaning
from vouchermill.schemas import LEDGER, RAW_DAYBOOK

RAW = [
    ("Company", None, None, None, None, None),  # banner
    ("Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit"),
    ("2024-05-01", "  Alpha Box\t", " GST Sales New ", " S/1 ", "100.50", None),
    ("02-05-2024", "Beta Pack", "Purchase New", "P/1", None, "75.25"),
    ("Inwards Qty", None, None, None, None, None),
    ("not a date", "Gamma", "Contra", "C/1", "1", "1"),
    ("31-02-2024", "Gamma", "Contra", "C/2", "1", "1"),
    ("2024-05-03", "Delta", "Journal New", None, "abc", "x"),
    ("2024-05-03", "Grand Total", "Contra", "C/3", "9", "9"),
    ("2024-05-03", "total sales", "Contra", "C/4", "9", "9"),
    ("2024-05-03", "Closing Balance", "Contra", "C/5", "9", "9"),
    ("2024-05-03", "OPENING BALANCE", "Contra", "C/6", "9", "9"),
    ("2024-05-03", "  ", "Contra", "C/7", "9", "9"),
    ("2024-05-03", None, "Contra", "C/8", "9", "9"),
    ("2024-05-03", "nan", "Contra", "C/9", "9", "9"),
    ("2026-01-05", "Epsilon", "Stock Journal", "J/1", "-5", "0"),
    ("2024-05-04", "Grandeur Ltd", "Payment", "Y/1", "9", "0"),
    ("2024-05-04", "A Grand Hall", "Payment", "Y/2", "9", "0"),
]


def clean(spark):
    return cleaning.clean_daybook(spark.createDataFrame(RAW, RAW_DAYBOOK), "2024-25")


def test_clean_daybook(spark):
    df = clean(spark)
    assert df.columns == LEDGER.fieldNames()
    rows = {r["particulars"]: r for r in rows_of(df)}
    # "Grandeur" starts with "grand": the prefix rule drops it too
    assert sorted(rows) == ["A Grand Hall", "Alpha Box", "Beta Pack", "Delta", "Epsilon"]
    alpha = rows["Alpha Box"]
    assert (alpha["vch_type"], alpha["vch_no"], alpha["txn_category"]) == ("GST Sales New", "S/1", "Sales")
    assert (alpha["debit_amount"], alpha["credit_amount"]) == (Decimal("100.50"), Decimal("0.00"))
    assert str(rows["Beta Pack"]["txn_date"]) == "2024-05-02"
    delta = rows["Delta"]
    assert (delta["debit_amount"], delta["credit_amount"], delta["vch_no"]) == (0, 0, None)
    # fiscal year comes from the date, the source label is kept beside it
    assert (rows["Epsilon"]["fiscal_year"], rows["Epsilon"]["source_year"]) == ("2025-26", "2024-25")
    assert rows["Epsilon"]["txn_category"] == "Other"


def test_cleaning_is_one_narrow_stage(spark):
    plan = clean(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_zero_and_positive_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 2), (-3, 0), (-3, 1)], "debit_amount int, credit_amount int")
    assert cleaning.drop_zero_rows(df).count() == 4
    assert cleaning.keep_positive_rows(df).count() == 3


def test_every_exact_label(spark):
    labels = [(name, category) for category, names in VOUCHER_TYPES.items() for name in names]
    labels += [(f" {n}\t", c) for n, c in labels] + [("gst sales new", "Other"), ("Sales", "Other"), (None, "Other")]
    df = spark.createDataFrame(labels, "v string, want string")
    assert df.filter(categorise_exact(F.col("v")) != F.col("want")).count() == 0


def test_pattern_rules_in_order(spark):
    labels = [(f"x {w.upper()} y", w) for w in CATEGORY_PATTERNS]
    labels += [
        ("GST SALES NEW 25-26", "Sales"),
        ("Purchase Order", "Purchase"),
        ("Sales Credit Note", "Sales"),
        ("Delivery Challan", "Other"),
        (None, "Other"),
    ]
    df = spark.createDataFrame(labels, "v string, want string")
    assert df.filter(categorise_pattern(F.col("v")) != F.col("want")).count() == 0


def test_party_contains(spark):
    df = spark.createDataFrame([("Owner CAPITAL a/c", True), ("Cap", False), (None, False)], "particulars string, want boolean")
    assert df.filter(party_contains("Capital") != F.col("want")).count() == 0


def test_dropped_rows_have_the_reason_of_the_first_step(spark):
    got = [(r["txn_date"], r["reason"]) for r in rows_of(cleaning.rejected_rows(spark.createDataFrame(RAW, RAW_DAYBOOK)))]
    assert got == [
        ("Company", "bad date"), ("Date", "repeated header"), ("Inwards Qty", "repeated header"),
        ("not a date", "bad date"), ("31-02-2024", "bad date"),
        *[("2024-05-03", "summary row")] * 4, *[("2024-05-03", "no party")] * 2, ("2024-05-03", "summary row"), ("2024-05-04", "summary row"),
    ]


def test_counts_come_from_the_pass_that_cleans(spark, tmp_path):
    raw = spark.createDataFrame(RAW, RAW_DAYBOOK)
    counts = Observation()
    kept = cleaning.clean_daybook(cleaning.observe_cleaning(raw, counts), "x")
    kept.write.parquet(str(tmp_path / "clean"))
    steps = {r["name"]: r for r in rows_of(cleaning.cleaning_steps(spark, counts))}
    rejected = cleaning.rejected_rows(raw).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in rejected} == {
        n: r["dropped"] for n, r in steps.items() if r["dropped"]
    }
    assert steps["raw"]["rows"] == len(RAW)
    assert steps["summary row"]["rows"] == kept.count() == clean(spark).count()
    assert (steps["no debit"]["rows"], steps["no credit"]["rows"]) == (1, 1)  # abc and x


def test_counts_without_rows_and_with_other_columns(spark, tmp_path):
    raw = spark.createDataFrame([], RAW_DAYBOOK)
    counts = Observation()
    cleaning.observe_cleaning(raw, counts).write.parquet(str(tmp_path / "none"))
    assert {r["rows"] for r in rows_of(cleaning.cleaning_steps(spark, counts))} == {0}
    wide = spark.createDataFrame(RAW[2:3], RAW_DAYBOOK).withColumns({"_reason": F.lit("mine"), "_row": F.lit(1)})
    counts = Observation()
    assert rows_of(cleaning.observe_cleaning(wide, counts)) == rows_of(wide)
