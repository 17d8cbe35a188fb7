"""Plans on rows of which a third share one key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vouchermill.operators import anomalies, overlap, parties

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def small_limits(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def rows(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, 200_000, 1, 16).select(
        F.when(hot, "HOT").otherwise(F.concat(F.lit("P"), (F.col("id") % 5000).cast("string"))).alias("particulars"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 100).cast("decimal(18,2)").alias("debit_amount"),
        F.lit(dt.date(2024, 5, 1)).alias("txn_date"),
        F.when(hot, "V0").otherwise(F.concat(F.lit("V"), F.col("id").cast("string"))).alias("vch_no"),
    )


def splits_the_hot_key(df):
    execution = df._jdf.queryExecution()
    count = execution.toRdd().count()
    return count, "skew=true" in execution.executedPlan().toString()


def test_flagging(small_limits, rows):
    assert splits_the_hot_key(anomalies.iqr_anomalies(rows, "particulars", "debit_amount"))[1]


def test_entity_baseline(small_limits, rows):
    assert splits_the_hot_key(anomalies.with_entity_baseline(rows, "particulars", "debit_amount")) == (200_000, True)


def test_alias(spark, small_limits, rows):
    alias = spark.range(5000).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("variant"), F.lit("X").alias("canonical")
    )
    assert splits_the_hot_key(parties.canonical_party(rows, alias)) == (200_000, True)


def test_receipts_of_customers(small_limits, rows):
    assert splits_the_hot_key(parties.customer_receipts(rows, rows)) == (200_000, True)


def test_overlap(small_limits, rows):
    b = rows.filter("particulars <> 'HOT'")
    count, split = splits_the_hot_key(overlap.resolve_overlap(rows, b, dt.date(2024, 1, 1)))
    # a third is only in the first book, the rest comes from the second
    assert (count, split) == (200_000, True)


def test_quartiles_of_a_hot_entity(rows):
    """As Spark's own percentile, which gathers an entity's distinct amounts in one task."""
    from vouchermill.operators.quantiles import exact_quartiles

    usual = rows.groupBy("particulars").agg(F.percentile(F.col("debit_amount").cast("double"), [0.25, 0.75]).alias("q"))
    want = {r.particulars: [round(q, 4) for q in r.q] for r in usual.collect()}
    got = {r.particulars: [float(r.q1), float(r.q3)] for r in exact_quartiles(rows, "particulars", "debit_amount").collect()}
    assert got.keys() == want.keys() and "HOT" in got and len(got) > 3000
    assert all(abs(x - y) < 1e-3 for k in got for x, y in zip(got[k], want[k]))
