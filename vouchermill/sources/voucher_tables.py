"""Ledger tables bucketed by voucher number, for joins and counts without a shuffle."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_by_voucher(df: DataFrame, path: str, table: str, buckets: int) -> None:
    """Store a ledger as ``table``: numbered rows in buckets of the voucher number, the others beside them.

    Rows are shuffled once, here; one task writes one bucket as one sorted file. Rows
    without a number would all have the same bucket, and match nothing, so they lie in
    a plain folder. The buckets of tables that are joined must agree in number: choose
    it so that a bucket of the largest fits a task. The lines of one voucher share a
    bucket; readers stream them, so a hot number costs time and no memory.

    The folder outlives the session. Where the catalog does not, ``open_by_voucher``
    registers it again.
    """
    numbered = F.col("vch_no").isNotNull()
    (
        df.filter(numbered)
        .repartition(buckets, "vch_no")
        .write.mode("overwrite")
        .bucketBy(buckets, "vch_no")
        .sortBy("vch_no")
        .option("path", os.path.join(path, "numbered"))
        .saveAsTable(table)
    )
    df.filter(~numbered).write.mode("overwrite").parquet(os.path.join(path, "unnumbered"))


def open_by_voucher(spark: SparkSession, path: str, table: str, schema: StructType, buckets: int) -> None:
    """Register a stored folder as ``table``, if the catalog does not know it."""
    if spark.catalog.tableExists(table):
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    folder = os.path.join(path, "numbered").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (vch_no) SORTED BY (vch_no) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )


def numbered_rows(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def unnumbered_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(os.path.join(path, "unnumbered"))
