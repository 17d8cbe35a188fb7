"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchermill.schemas import LEDGER_EXPORT_NAMES


def write_result(df: DataFrame, path: str, fmt: str = "parquet", order_by: list | None = None) -> None:
    """Overwrite a result table; sort only where the reader wants an order."""
    if order_by:
        df = df.orderBy(*order_by)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_ledger(
    df: DataFrame,
    path: str,
    partition_by: tuple = ("fiscal_year", "txn_category"),
    mode: str = "overwrite",
    derived: dict[str, Column] | None = None,
) -> None:
    """Ledger as Parquet, partitioned by fiscal year and category.

    Almost every query names a category and many name a year, so both prune
    whole folders. The rebalance hint brings the rows of a folder together, which
    keeps the number of files down, and splits a folder that holds most of the
    rows over several tasks. Sorting by date within a task gives tight row-group
    statistics.

    ``derived`` holds columns that follow from others. They are added where the rows
    are written: on the way there and in the sort they would only cost bytes.
    """
    dealt = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, "txn_date")
    dealt.withColumns(derived or {}).write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_ledger(df: DataFrame, path: str) -> None:
    """Clean ledger as CSV files under the names of an exported file, for ``read_clean_ledger(fmt="csv")``."""
    named = df.select(*[F.col(b).alias(a) for a, b in LEDGER_EXPORT_NAMES.items()])
    named.write.mode("overwrite").option("header", True).csv(path)
