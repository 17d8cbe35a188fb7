"""Readers. Every schema is explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vouchermill.functions.calendar import with_calendar
from vouchermill.functions.parsing import parse_amount_or_zero, parse_mixed_date, trim_text
from vouchermill.schemas import LEDGER, LEDGER_EXPORT_NAMES, RAW_DAYBOOK, apply_schema

# name of the helper column that carries a row's file
SOURCE_FILE = "_source_file"


def read_daybook(spark: SparkSession, path: str, keep_source_file: bool = False) -> DataFrame:
    """Raw day-book sheet as six text columns.

    Banner rows are not counted off: a distributed read has no global row
    number. They fall out later because their date does not parse.
    """
    df = spark.read.schema(RAW_DAYBOOK).option("header", False).csv(path)
    if keep_source_file:
        df = df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    return df


def read_clean_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Clean ledger, from Parquet with canonical names or from an exported CSV."""
    if fmt == "parquet":
        return spark.read.schema(LEDGER).parquet(path)
    text = StructType([StructField(n, StringType()) for n in LEDGER_EXPORT_NAMES])
    raw = spark.read.schema(text).option("header", True).csv(path)
    named = raw.select(*[F.col(a).alias(b) for a, b in LEDGER_EXPORT_NAMES.items()])
    typed = named.withColumns(
        {
            "txn_date": parse_mixed_date(F.col("txn_date")),
            "debit_amount": parse_amount_or_zero(F.col("debit_amount")),
            "credit_amount": parse_amount_or_zero(F.col("credit_amount")),
        }
    )
    return apply_schema(with_calendar(typed.dropna(subset=["txn_date"])), LEDGER)


def read_register(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV whose quoted names may hold tabs and line breaks.

    A quoted line break makes a file unsplittable, so one file is one task: land
    large registers as many files or as Parquet.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    texts = [f.name for f in schema if isinstance(f.dataType, StringType)]
    return df.withColumns({n: trim_text(F.col(n)) for n in texts})


_known_schemas: dict[str, StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table by name. Its schema is taken from the first footer once per path, so
    that a query reading a table several times starts no further lookup."""
    path = f"{folder}/{name}.parquet"
    if path not in _known_schemas:
        _known_schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_known_schemas[path]).parquet(path)
