"""Explicit schemas; nothing in this library infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

AMOUNT = DecimalType(18, 2)

RAW_COLUMNS = (
    "txn_date",
    "particulars",
    "vch_type",
    "vch_no",
    "debit_amount",
    "credit_amount",
)

# positional landing columns of a raw day-book sheet
RAW_DAYBOOK = StructType([StructField(f"_c{i}", StringType()) for i in range(6)])

LEDGER = StructType(
    [
        StructField("txn_date", DateType(), False),
        StructField("particulars", StringType(), False),
        StructField("vch_type", StringType()),
        StructField("vch_no", StringType()),
        StructField("debit_amount", AMOUNT),
        StructField("credit_amount", AMOUNT),
        StructField("txn_category", StringType()),
        StructField("fiscal_year", StringType()),
        StructField("source_year", StringType()),
        StructField("month_num", IntegerType()),
        StructField("fiscal_month_num", IntegerType()),
        StructField("month_name", StringType()),
        StructField("day_of_week", StringType()),
        StructField("quarter", StringType()),
    ]
)

PURCHASE_REGISTER = StructType(
    [
        StructField("txn_date", DateType(), False),
        StructField("supplier_name", StringType(), False),
        StructField("vch_type", StringType()),
        StructField("vch_no", StringType()),
        StructField("purchase_amount", AMOUNT),
        StructField("fiscal_year", StringType()),
        StructField("month_name", StringType()),
    ]
)

SALES_REGISTER = StructType(
    [
        StructField("txn_date", DateType(), False),
        StructField("buyer_name", StringType(), False),
        StructField("buyer_gstin", StringType()),
        StructField("voucher_no", StringType()),
        StructField("quantity", AMOUNT),
        StructField("rate", AMOUNT),
        StructField("net_value", AMOUNT),
        StructField("gross_total", AMOUNT),
        StructField("gst_rate", StringType()),
        StructField("fiscal_year", StringType()),
    ]
)

PARTY_ALIAS = StructType(
    [
        StructField("variant", StringType(), False),
        StructField("canonical", StringType(), False),
    ]
)

# columns of an exported ledger file and the canonical names they become
LEDGER_EXPORT_NAMES = {
    "Date": "txn_date",
    "Particulars": "particulars",
    "Vch_Type": "vch_type",
    "Vch_No": "vch_no",
    "Debit_Amount": "debit_amount",
    "Credit_Amount": "credit_amount",
    "FY": "source_year",
    "Month_Name": "month_name",
    "Day_of_Week": "day_of_week",
    "Month_Num": "fiscal_month_num",
    "Quarter": "quarter",
    "Txn_Category": "txn_category",
}


def ledger_schemas() -> dict[str, StructType]:
    return {
        "ledger": LEDGER,
        "purchase_register": PURCHASE_REGISTER,
        "sales_register": SALES_REGISTER,
    }


def apply_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to ``schema``, default missing amounts to 0, drop rows that lack a
    required value."""
    required = [f.name for f in schema if not f.nullable]
    columns = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in ("debit_amount", "credit_amount", "purchase_amount"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        columns.append(c.alias(f.name))
    return df.select(*columns).dropna(subset=required)
