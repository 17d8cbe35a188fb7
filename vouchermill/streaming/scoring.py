"""Scoring of new rows against stored baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vouchermill.operators.anomalies import flag_rows


def score_stream(stream: DataFrame, baselines: DataFrame, entity: str, amount: str) -> DataFrame:
    """Flag new rows outside the stored range of their entity (a stateless
    stream-static join; the baselines are re-read with every batch)."""
    return flag_rows(stream, baselines.select(entity, "mean", "low", "high"), entity, amount)


def write_flags(flags: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        flags.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
