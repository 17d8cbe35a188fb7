"""Incremental ingestion of raw day-book files.

A voucher number belongs to the book that brings it first: all its lines in
that book stay, in whatever batch they come, and lines of the same number in
other books go. Books are files, or the folders that hold them. Which book has a
number stands in an index beside the ledger, a row of a few bytes per voucher in
folders by a hash of the number, so a batch never reads the ledger itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchermill.operators.cleaning import as_ledger, clean_rows
from vouchermill.schemas import LEDGER, RAW_DAYBOOK

LAYOUT = ("fiscal_year", "txn_category")
INDEX = "vch_no string, book string, batch int, bucket int"
#: folders of the index; a small batch reads only those of its own numbers
BUCKETS = 64

_BOOK, _ARRIVED = "_book", "_arrived"


def _folder_of(file: Column) -> Column:
    return F.left(file, F.length(file) - F.length(F.substring_index(file, "/", -1)) - 1)


def read_daybook_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, book: str = "file") -> DataFrame:
    """Raw lines with their book (`file`: its path, `folder`: that of its folder) and when its file arrived."""
    file = F.col("_metadata.file_path")
    return (
        spark.readStream.schema(RAW_DAYBOOK)
        .option("header", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
        .select(
            *RAW_DAYBOOK.fieldNames(),
            (file if book == "file" else _folder_of(file)).alias(_BOOK),
            F.struct(F.col("_metadata.file_modification_time"), file).alias(_ARRIVED),
        )
    )


def bucket_of(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(BUCKETS)).cast("int")


def first_books(batch: DataFrame, index: DataFrame) -> DataFrame:
    """vch_no, book, bucket of the numbers that the index lacks: the book whose file arrived first."""
    numbered = batch.filter(F.col("vch_no").isNotNull())
    found = numbered.groupBy("vch_no").agg(F.min_by(_BOOK, F.struct(_ARRIVED, _BOOK)).alias("book"))
    found = found.withColumn("bucket", bucket_of(F.col("vch_no")))
    return found.join(index.select("bucket", "vch_no"), ["bucket", "vch_no"], "left_anti")


def own_lines(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Lines of the book that has their number; lines without a number all stay."""
    numbered = batch.filter(F.col("vch_no").isNotNull()).withColumn("bucket", bucket_of(F.col("vch_no")))
    owners = index.select("bucket", "vch_no", F.col("book").alias(_BOOK))
    kept = numbered.join(owners, ["bucket", "vch_no", _BOOK], "left_semi")
    return kept.select(*batch.columns).unionByName(batch.filter(F.col("vch_no").isNull()))


def ingest_daybook(
    spark: SparkSession, source: str, target: str, checkpoint: str, source_year: str, files_per_batch: int = 1000, book: str = "file"
) -> StreamingQuery:
    """Clean what is new in ``source`` and append the lines that no other book had to ``target``.

    Processes what is there and stops. A batch writes a folder of its own to the
    index (``target``-vouchers) and to the ledger, with the layout of a stored
    ledger below it, and compares itself with the other batches' index only, so a
    batch that is run again replaces its own rows. Its text is parsed and cleaned once,
    into ``target``-arrived, which holds the last batch only; index and ledger are made from that, and columns
    that follow from others are added to the lines that stay.
    """
    index_folder = f"{target}-vouchers"
    # empty tables, so that there is always something to read
    spark.createDataFrame([], LEDGER).write.partitionBy(*LAYOUT).mode("ignore").parquet(f"{target}/batch=-1")
    spark.createDataFrame([], "vch_no string, book string, bucket int").write.partitionBy("bucket").mode("ignore").parquet(f"{index_folder}/batch=-1")

    def append(arrived: DataFrame, number: int) -> None:
        arrived.write.mode("overwrite").parquet(f"{target}-arrived")
        batch = arrived.sparkSession.read.schema(arrived.schema).parquet(f"{target}-arrived")
        index = batch.sparkSession.read.schema(INDEX).parquet(index_folder)
        fresh = first_books(batch, index.filter(F.col("batch") != number))
        fresh.write.partitionBy("bucket").mode("overwrite").parquet(f"{index_folder}/batch={number}")
        index = batch.sparkSession.read.schema(INDEX).parquet(index_folder)
        rows = as_ledger(own_lines(batch, index), source_year)
        rows.write.partitionBy(*LAYOUT).mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        clean_rows(read_daybook_stream(spark, source, files_per_batch, book))
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
