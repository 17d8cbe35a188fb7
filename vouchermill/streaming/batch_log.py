"""Additive parts of a stream, kept under the numbers of their batches.

    target/kind=batch/number=N   what batch N adds
    target/kind=base/number=K    what all batches up to K add, in one folder
    target/kind=done/number=K    says that base K is whole

A batch that is repeated after a failure overwrites its own folder, so every
batch counts once. Readers use a base only once it is marked as whole, and pass
over the batches folded into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def part_folder(target: str, kind: str, number: int) -> str:
    return f"{target}/kind={kind}/number={number}"


def read_parts(spark: SparkSession, target: str, schema: str, upto: int | None = None) -> DataFrame:
    """The last whole base and the batches after it, all up to a batch number.
    ``schema`` ends with the columns ``kind string, number long``."""
    log = spark.read.schema(schema).parquet(target)
    if upto is not None:
        log = log.filter(F.col("number") <= upto)
    base = F.coalesce(log.filter(F.col("kind") == "done").agg(F.max("number").alias("n")).scalar(), F.lit(-1))
    own = ((F.col("kind") == "base") & (F.col("number") == base)) | ((F.col("kind") == "batch") & (F.col("number") > base))
    return log.filter(own)


def is_folded(spark: SparkSession, target: str, schema: str, upto: int) -> bool:
    log = spark.read.schema(schema).parquet(target)
    return not log.filter((F.col("kind") == "done") & (F.col("number") >= upto)).isEmpty()


def mark_folded(spark: SparkSession, target: str, upto: int, column: str, kind: str, below: str = "") -> None:
    """Say that the base is whole: one row whose only column, one of the log's, is NULL.
    ``below`` names folders for the log's further partition columns."""
    mark = spark.range(1).select(F.lit(None).cast(kind).alias(column))
    mark.write.mode("overwrite").parquet(part_folder(target, "done", upto) + below)
