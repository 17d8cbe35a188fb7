"""A stored ledger whose fiscal years are replaced one by one.

Data lie below ``data`` in a folder per version, each partitioned like a ledger of
``write_ledger``. The table ``published`` says which version holds which year: every
publication adds one file with all years, and readers take the one with the highest
number. A version is complete before a publication names it and no file is changed
after that, so a reader sees the years as they were before or as they are after,
never in between, and the files of other years stay as they are.

Versions that no publication names any more may be deleted once no reader is left.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vouchermill.functions.calendar import of_fiscal_years
from vouchermill.schemas import LEDGER
from vouchermill.sources.readers import read_clean_ledger
from vouchermill.sources.writers import write_ledger

_PUBLISHED = "number int, fiscal_year string, version string"
_VERSIONED = StructType([*LEDGER.fields, StructField("version", StringType())])


def _published(spark: SparkSession, store: str) -> tuple[int, dict[str, str]]:
    """Number and years of the newest publication; a store without one has number 0 and no years."""
    try:
        table = spark.read.schema(_PUBLISHED).parquet(os.path.join(store, "published"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    number = table.agg(F.max("number")).first()[0] or 0
    # one row per fiscal year of the ledger
    rows = table.filter(F.col("number") == number).collect()
    return number, {r.fiscal_year: r.version for r in rows if r.fiscal_year is not None}


def _publish(spark: SparkSession, store: str, number: int, years: dict[str, str]) -> None:
    """Add a publication. Its one file appears when it is complete. A writer that finds the number taken fails;
    that is a check and no lock, so writers of one store take turns."""
    rows = sorted(years.items()) or [(None, None)]
    table = spark.createDataFrame(rows, "fiscal_year string, version string").coalesce(1)
    table.write.mode("error").parquet(os.path.join(store, "published", f"number={number}"))


def replace_years(ledger: DataFrame, store: str, years: tuple, read_number: int | None = None) -> int:
    """Replace whole fiscal years of a store, or add them, and return the number of the publication.

    The ledger holds the new rows of all named years; a year without rows is empty
    afterwards, all its categories included. A row of another year fails the job
    before anything is published. ``read_number`` is the publication that the new rows
    were made from: if another one came in between, the call fails instead of undoing it.
    A repeated call leaves an unnamed version behind and changes nothing else.
    """
    spark = ledger.sparkSession
    number, current = _published(spark, store)
    if read_number is not None and read_number != number:
        raise ValueError(f"publication {number} came after {read_number}, which the rows were made from")
    version = f"v{uuid.uuid4().hex}"
    path = os.path.join(store, "data", f"version={version}")
    named = F.coalesce(F.col("fiscal_year").isin(*years), F.lit(False))
    other = F.raise_error(F.concat(F.lit("row of another fiscal year: "), F.coalesce("fiscal_year", F.lit("none"))))
    checked = ledger.select(*LEDGER.fieldNames()).filter(F.when(named, F.lit(True)).otherwise(other.cast("boolean")))
    write_ledger(checked, path)
    # the years come from folder names; rows are not read
    found = read_clean_ledger(spark, path).select("fiscal_year").distinct().collect()
    kept = {y: v for y, v in current.items() if y not in years}
    _publish(spark, store, number + 1, kept | {r.fiscal_year: version for r in found})
    return number + 1


def read_store(spark: SparkSession, store: str, *years: str) -> DataFrame:
    """The ledger as last published (all years, or some), with the columns of a clean ledger. The years are
    fixed when it is called: publications that come later do not change the result."""
    _, current = _published(spark, store)
    wanted = {y: v for y, v in current.items() if not years or y in years}
    if not wanted:
        return spark.createDataFrame([], LEDGER)
    data = os.path.join(store, "data")
    paths = [os.path.join(data, f"version={v}", f"fiscal_year={y}") for y, v in sorted(wanted.items())]
    rows = spark.read.schema(_VERSIONED).option("basePath", data).parquet(*paths)
    rows = rows.select(*LEDGER.fieldNames())
    return of_fiscal_years(rows, *years) if years else rows


def published_number(spark: SparkSession, store: str) -> int:
    """Number of the newest publication, 0 before the first."""
    return _published(spark, store)[0]
