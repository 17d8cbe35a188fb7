"""Running totals and shares over many parties without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vouchermill.functions.numeric import value_bucket
from vouchermill.operators.joins import attach_row

_TOTAL = "decimal(38,2)"


def running_total_by_value(df: DataFrame, value: str, total: str = "running_total", above: str = "rank") -> DataFrame:
    """Sum of ``value`` over all rows with a value at least as large (ties share
    it), and the rank: one more than the number of rows with a larger value.

    Equals ``SUM(value) OVER (ORDER BY value DESC)`` and ``RANK()`` with the same
    order, as a two-level prefix sum: rows collapse to distinct values, values to
    order-preserving buckets (a bounded number), and only the bucket totals pass
    through one task. Within a bucket the window orders distinct values.
    """
    levels = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    levels = levels.select(
        "_v", "_n", (F.col("_v") * F.col("_n").cast("decimal(18,0)")).cast(_TOTAL).alias("_s"),
        value_bucket(F.col("_v")).alias("_b"),
    )
    before = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        levels.groupBy("_b")
        .agg(F.sum("_n").alias("_bn"), F.sum("_s").cast(_TOTAL).alias("_bs"))
        .select(
            "_b",
            F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_bs").over(before), F.lit(0)).cast(_TOTAL).alias("_s0"),
        )
    )
    inside = Window.partitionBy("_b").orderBy(F.col("_v").desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = levels.select(
        "_v", "_b", "_n", F.sum("_n").over(upto).alias("_ln"), F.sum("_s").over(upto).cast(_TOTAL).alias("_ls")
    )
    # the offsets hold one row per bucket: bounded by the bucket function
    placed = local.join(F.broadcast(offsets), "_b").select(
        F.col("_v").alias(value),
        (F.col("_n0") + F.col("_ln") - F.col("_n") + 1).alias(above),
        (F.col("_s0") + F.col("_ls")).cast(_TOTAL).alias(total),
    )
    return df.join(placed, value)


def with_grand_total(df: DataFrame, totals: DataFrame, value: str, total: str = "grand_total") -> DataFrame:
    """Attach the sum of a column of ``totals`` to the rows of ``df``."""
    return attach_row(df, totals.agg(F.sum(value).cast(_TOTAL).alias(total)))


def top_with_running_total(
    df: DataFrame, value: str, n: int, tie_break: list[str], total: str = "running_total"
) -> DataFrame:
    """First ``n`` rows by descending value with their running total (ties share
    it, also ties beyond row ``n``) and row number.

    The ``n`` top rows have at most ``n`` distinct values, which are the ``n``
    largest, so the window sees ``n`` rows however many there are.
    """
    top = df.orderBy(F.col(value).desc(), *tie_break).limit(n)
    levels = (
        df.groupBy(value).agg(F.sum(value).cast(_TOTAL).alias("_s")).orderBy(F.col(value).desc()).limit(n)
    )
    upto = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select(value, F.sum("_s").over(upto).cast(_TOTAL).alias(total))
    order = Window.orderBy(F.col(value).desc(), *tie_break)
    return top.join(F.broadcast(levels), value).withColumn("rank", F.row_number().over(order))


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int, number: str = "position") -> DataFrame:
    """First ``k`` rows of each group. Spark keeps ``k`` rows per group and task
    before the shuffle, so a hot group does not travel whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= k)
