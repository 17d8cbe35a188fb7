"""Exact per-group quartiles that survive a hot group."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window, functions as F

from vouchermill.functions.numeric import value_bucket

_QUARTILE = "decimal(22,4)"


def exact_quartiles(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Row count, sum and linearly interpolated quartiles of each entity.

    Entities of all sizes take the same way and none is ever gathered in a task.
    Rows without an entity are left out.
    """
    rows = df.select(F.col(entity).alias("_e"), F.col(amount).cast("decimal(18,2)").alias("_a"))
    return split_quartiles(rows.filter(F.col("_e").isNotNull())).withColumnRenamed("_e", entity)


def split_quartiles(rows: DataFrame) -> DataFrame:
    """Quartiles of ``_a`` per ``_e`` from bucket counts.

    A first pass counts order-preserving buckets per entity, which locates the
    buckets holding the wanted order statistics; a second pass counts the distinct
    amounts of just those buckets. Every count has map-side combine, and no window
    sees more than the buckets of an entity or the amounts of a bucket.
    """
    rows = rows.withColumn("_b", value_bucket(F.col("_a")))
    buckets = rows.groupBy("_e", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_s"))
    return counted_quartiles(buckets, rows.withColumn("_n", F.lit(1)))


def counted_quartiles(buckets: DataFrame, amounts: DataFrame) -> DataFrame:
    """Quartiles from counts: rows and sum (``_n``, ``_s``) per ``_e`` and bucket ``_b``,
    and rows (``_n``) of each amount ``_a`` there, which may come in several parts."""
    per_entity = Window.partitionBy("_e")
    upto = per_entity.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = buckets.select(
        "_e",
        "_b",
        "_n",
        F.sum("_n").over(per_entity).alias("_total"),
        F.sum("_n").over(upto).alias("_end"),
    )
    # zero-based positions of the order statistics around both quartiles
    wanted = []
    for numerator in (1, 3):
        scaled = (F.col("_total") - 1) * numerator
        low = F.floor(scaled / 4).cast("bigint")
        wanted += [low, F.when(scaled % 4 == 0, low).otherwise(low + 1)]
    start = F.col("_end") - F.col("_n")
    inside = F.lit(False)
    for position in wanted:
        inside = inside | ((position >= start) & (position < F.col("_end")))
    targets = placed.filter(inside).select("_e", "_b", "_total", start.alias("_start"))
    totals = buckets.groupBy("_e").agg(F.sum("_n").alias("row_count"), F.sum("_s").alias("total_amount"))

    # rows of other buckets go before anything is counted or shuffled, where the targets can be broadcast
    counted = amounts.join(targets, ["_e", "_b"]).groupBy("_e", "_b", "_a", "_total", "_start").agg(F.sum("_n").alias("_n"))
    within = Window.partitionBy("_e", "_b").orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(within))
    first = F.col("_end") - F.col("_n")

    def at(position):
        return F.max(F.when((position >= first) & (position < F.col("_end")), F.col("_a")))

    picked = ranked.groupBy("_e").agg(
        *[at(p).alias(f"_p{i}") for i, p in enumerate(wanted)], F.max("_total").alias("_total")
    )

    def interpolate(numerator: int, low: str, high: str):
        # the fraction is a multiple of a quarter, so DECIMAL stays exact
        part = (((F.col("_total") - 1) * numerator) % 4).cast("decimal(2,0)") * F.lit(Decimal("0.25"))
        return (F.col(low) + (F.col(high) - F.col(low)) * part).cast(_QUARTILE)

    quartiles = picked.select(
        "_e", interpolate(1, "_p0", "_p1").alias("q1"), interpolate(3, "_p2", "_p3").alias("q3")
    )
    return totals.join(quartiles, "_e").select(
        "_e", "row_count", F.col("total_amount").cast("decimal(28,2)").alias("total_amount"), "q1", "q3"
    )
