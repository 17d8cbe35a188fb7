"""Totals over a stream, kept as a log of additive parts.

Every batch stores the sums of its own rows under its number; readers add the
parts up. No day ever closes and no state is kept, so a row counts however late
it comes, and the result does not depend on how rows fall into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchermill.streaming.batch_log import is_folded, mark_folded, part_folder, read_parts

LOG = "day date, category string, rows long, amount decimal(28,2), kind string, number long"


def daily_totals(rows: DataFrame, ts: str, category: str, amount: str) -> DataFrame:
    """Rows and amount per day (of the session's time zone) and category."""
    totals = rows.groupBy(F.to_date(ts).alias("day"), F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(amount).cast("decimal(28,2)").alias("amount")
    )
    return totals.select("day", "category", "rows", "amount")


def write_daily_totals(stream: DataFrame, target: str, checkpoint: str, ts: str, category: str, amount: str) -> StreamingQuery:
    """Store the totals of each batch under its number. A batch that is repeated
    after a failure overwrites its own folder, so the log holds every batch once."""

    def save(batch: DataFrame, number: int) -> None:
        daily_totals(batch, ts, category, amount).write.mode("overwrite").parquet(part_folder(target, "batch", number))

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def read_daily_totals(spark: SparkSession, target: str) -> DataFrame:
    """Total of each day and category over all batches."""
    return _added(read_parts(spark, target, LOG))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "category").agg(
        F.sum("rows").alias("rows"), F.sum("amount").cast("decimal(28,2)").alias("amount")
    )


def compact_daily_totals(spark: SparkSession, target: str, upto: int) -> None:
    """Fold the batches up to a number into one folder.

    Readers use it only once it is marked as whole, and pass over the folded
    batches from then on. Running it again writes the same rows again; one that
    was interrupted left no mark and is simply repeated.
    """
    if is_folded(spark, target, LOG, upto):
        return
    _added(read_parts(spark, target, LOG, upto)).write.mode("overwrite").parquet(part_folder(target, "base", upto))
    mark_folded(spark, target, upto, "day", "date")


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """Calendar months from days: a month is not a window of fixed length."""
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "category").agg(
        F.sum("rows").alias("rows"), F.sum("amount").alias("amount")
    )
