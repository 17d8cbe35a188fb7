"""Party names, semi joins and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouchermill.operators.joins import join_per_key



def canonical_party(df: DataFrame, alias: DataFrame, party: str = "particulars") -> DataFrame:
    """Replace name variants by their canonical name; other names are kept.

    A variant that the alias table names more than once has the least of its
    names, so rows are never multiplied.

    No broadcast hint: the alias table grows with the parties. Spark broadcasts
    it below its size threshold and otherwise shuffles, splitting a hot name.
    """
    a = alias.groupBy(F.col("variant").alias("_variant")).agg(F.min("canonical").alias("_canonical"))
    # the hash asks for a shuffle of the aliases, which lets Spark split a hot name (see join_per_key)
    a = a.withColumn("_h", F.xxhash64("_variant"))
    joined = df.join(a, (F.col(party) == F.col("_variant")) & (F.xxhash64(party) == F.col("_h")), "left")
    return joined.withColumn(party, F.coalesce("_canonical", party)).drop("_variant", "_canonical", "_h")


def customer_receipts(receipts: DataFrame, sales: DataFrame, party: str = "particulars") -> DataFrame:
    """Receipts of parties that also buy."""
    return join_per_key(receipts, sales.select(party).distinct(), party, "left_semi")


def star_join(
    facts: DataFrame, calendar: DataFrame, dimension: DataFrame, party: str = "particulars", name: str = "name"
) -> DataFrame:
    """Facts with the attributes of their day and of their party."""
    days = calendar.select(
        F.col("date").alias("txn_date"), F.col("fy").alias("cal_fy"), F.col("quarter").alias("cal_quarter")
    )
    dim = dimension.withColumnRenamed(name, party)
    # a calendar has one row per day of history, some ten thousand at most
    return facts.join(F.broadcast(days), "txn_date", "left").join(dim, party, "left")


