"""Labelled rows for the classifiers, and the fold that they are never taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: the most labelled rows that a model is fitted on (documented bound)
MOST_LABELLED = 2500


def held_out(identity: Column) -> Column:
    """True for the fifth of the rows that is kept for testing; a null id is not in it."""
    return F.coalesce(F.crc32(identity.cast("string")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled rows outside the test fold: those
    whose ids have the smallest hashes, so the same ones at each call."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = rows.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` ids
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    return [(r.text, int(r.label)) for r in texts.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").toLocalIterator()]
