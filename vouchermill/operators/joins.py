"""Joins of many rows with one row per key, or with one row in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with an aggregate that has one row per ``key``.

    The aggregate is already partitioned by the key, so Spark would shuffle only
    the rows and send all rows of a hot key to one task, and its skew handling
    needs a shuffle on both sides. A hash of the key as second join column asks
    for that shuffle; it moves one row per key and lets a hot key be split.
    """
    h = F.xxhash64(key)
    left = rows.withColumn("_h", h)
    right = per_key.withColumn("_h", h)
    return left.join(right, ["_h", key], how).drop("_h")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row.

    The row is a scalar subquery: it is computed once and used as a constant, so
    there is no join.
    """
    packed = row.select(F.struct(*row.columns).alias("_r")).scalar()
    named = df.withColumn("_row", packed)
    return named.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])
