"""Unusual amounts: per-entity quartile ranges and a global z-score."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from vouchermill.config import FLAG_HIGH, FLAG_LOW, IqrConfig
from vouchermill.functions.calendar import iso
from vouchermill.functions.categories import is_category
from vouchermill.functions.numeric import half_up
from vouchermill.operators.joins import attach_row, join_per_key
from vouchermill.operators.quantiles import exact_quartiles
from vouchermill.operators.ranking import top_k_per_group
from vouchermill.session import shared_folder

STORED_ROWS = "particulars string, value decimal(18,2), txn_date date, vch_no string, fiscal_year string, txn_type string"


def iqr_limits(df: DataFrame, entity: str, amount: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    """Row count, mean, quartiles and fences of every entity (DECIMAL fences)."""
    return fences(exact_quartiles(df, entity, amount), entity, config)


def fences(q: DataFrame, entity: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    """Mean and fences from row count, sum and quartiles."""
    factor = F.lit(Decimal(config.factor))
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        entity,
        "row_count",
        F.try_divide(F.col("total_amount").cast("double"), F.col("row_count").cast("double")).alias("mean"),
        "q1",
        "q3",
        iqr.alias("iqr"),
        F.greatest(F.lit(0).cast("decimal(38,6)"), (F.col("q1") - iqr * factor).cast("decimal(38,6)")).alias("low"),
        (F.col("q3") + iqr * factor).cast("decimal(38,6)").alias("high"),
    )


def iqr_baseline(df: DataFrame, entity: str, amount: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    """Rounded baselines of entities with enough rows."""
    return rounded_baseline(iqr_limits(df, entity, amount, config), entity, config)


def rounded_baseline(limits: DataFrame, entity: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    return limits.filter(F.col("row_count") >= config.min_rows).select(
        F.col(entity).alias("entity"),
        F.col("row_count").alias("txn_count"),
        *[half_up(F.col(c), 0).alias(n) for c, n in (
            ("mean", "entity_mean"), ("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"),
            ("low", "low_bound"), ("high", "high_bound"),
        )],
    )


def iqr_skipped(df: DataFrame, entity: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    """Entities with too few rows for a baseline."""
    counts = df.groupBy(F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("txn_count"))
    return counts.filter(F.col("txn_count") < config.min_rows)


def flag_rows(df: DataFrame, limits: DataFrame, entity: str, amount: str) -> DataFrame:
    """Rows strictly outside the range of their entity."""
    outside = (F.col(amount) < F.col("low")) | (F.col(amount) > F.col("high"))
    flagged = join_per_key(df, limits, entity).filter(outside)
    value, mean = F.col(amount).cast("double"), F.col("mean")
    return flagged.select(
        *[c for c in df.columns if c not in (entity, amount)],
        F.col(entity).alias("entity"),
        half_up(F.col(amount), 2).alias("amount"),
        half_up(mean, 0).alias("entity_mean"),
        half_up(F.col("low"), 0).alias("expected_low"),
        half_up(F.col("high"), 0).alias("expected_high"),
        half_up(F.try_divide(value - mean, mean) * 100.0, 1).alias("deviation_pct"),
        F.when(F.col(amount) > F.col("high"), FLAG_HIGH).otherwise(FLAG_LOW).alias("flag_type"),
    )


def iqr_anomalies(df: DataFrame, entity: str, amount: str, config: IqrConfig = IqrConfig()) -> DataFrame:
    limits = iqr_limits(df, entity, amount, config).filter(F.col("row_count") >= config.min_rows)
    return flag_rows(df, limits.select(entity, "mean", "low", "high"), entity, amount)


def _positive(ledger: DataFrame, category: str, amount: str) -> DataFrame:
    rows = ledger.filter(is_category(category) & (F.col(amount) > 0) & F.col("particulars").isNotNull())
    return rows.select("particulars", F.col(amount).alias("value"), "txn_date", "vch_no", "fiscal_year")


def all_anomalies(ledger: DataFrame, config: IqrConfig = IqrConfig()) -> DataFrame:
    """Flagged sales per customer and purchases per supplier, tagged.

    Both sides go through one computation, keyed by type and party. Rows without
    a party belong to no one and are left out. The rows are read three times (bucket
    counts, amounts of the quartiles' buckets, flags), so they are stored once in
    the shared folder with the columns needed; the ledger and its joins run once.
    """
    sale = _positive(ledger, "Sales", "debit_amount").withColumn("txn_type", F.lit("Sale"))
    bought = _positive(ledger, "Purchase", "credit_amount").withColumn("txn_type", F.lit("Purchase"))
    folder = shared_folder(ledger.sparkSession, "anomaly-rows")
    sale.unionByName(bought).write.parquet(folder)
    rows = ledger.sparkSession.read.schema(STORED_ROWS).parquet(folder).withColumn("who", F.struct("txn_type", "particulars"))
    flagged = iqr_anomalies(rows.drop("txn_type", "particulars"), "who", "value", config)
    return flagged.select(
        iso(F.col("txn_date")).alias("txn_date"),
        F.col("entity.particulars").alias("customer"),
        "vch_no",
        "amount",
        "entity_mean",
        "expected_low",
        "expected_high",
        "deviation_pct",
        "flag_type",
        "fiscal_year",
        F.col("entity.txn_type").alias("txn_type"),
    )


def by_deviation(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy("txn_type", F.col("deviation_pct").desc(), "customer", "vch_no")


def top_anomalies(anomalies: DataFrame, k: int = 10) -> DataFrame:
    """Flagged rows of each type that deviate most upwards."""
    order = [F.col("deviation_pct").desc(), F.col("customer"), F.col("vch_no"), F.col("amount")]
    top = top_k_per_group(anomalies, ["txn_type"], order, k)
    return top.select(
        "txn_type", "position", "txn_date", "customer", "amount", "entity_mean", "deviation_pct", "flag_type"
    ).orderBy("txn_type", "position")


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    counts = anomalies.groupBy("txn_type", "flag_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("decimal(28,2)")).alias("s")
    )
    return counts.select("txn_type", "flag_type", "rows", half_up(F.col("s"), 2).alias("amount")).orderBy(
        "txn_type", "flag_type"
    )


def anomaly_top_parties(anomalies: DataFrame, by_amount: int = 3, by_count: int = 8) -> DataFrame:
    """Parties with the largest flagged amount and with the most flagged rows."""
    per_party = anomalies.groupBy("txn_type", "customer").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("decimal(28,2)")).alias("s")
    )
    amount = top_k_per_group(per_party, ["txn_type"], [F.col("s").desc(), F.col("customer")], by_amount)
    count = top_k_per_group(per_party, ["txn_type"], [F.col("rows").desc(), F.col("customer")], by_count)
    both = amount.withColumn("ranked_by", F.lit("amount")).unionByName(count.withColumn("ranked_by", F.lit("count")))
    return both.select(
        "ranked_by", "txn_type", "position", "customer", "rows", half_up(F.col("s"), 2).alias("amount")
    ).orderBy("ranked_by", "txn_type", "position")


def with_entity_baseline(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Every row with the count and mean of its entity.

    Aggregate and join back: the aggregate combines map-side and the join can
    split a hot entity, a window over the entity could not.
    """
    stats = df.groupBy(entity).agg(F.count(F.lit(1)).alias("entity_rows"), F.sum(amount).alias("_s"))
    stats = stats.withColumn("entity_avg", F.try_divide(F.col("_s").cast("double"), F.col("entity_rows").cast("double")))
    return join_per_key(df, stats.drop("_s"), entity)


def zscore_rows(df: DataFrame, amount: str, cut: float = 2.0, high: float = 3.0) -> DataFrame:
    """Rows whose z-score over the positive amounts exceeds ``cut``.

    Mean and population variance are a one-row aggregate.
    """
    value = F.col(amount).cast("double")
    stats = df.filter(F.col(amount) > 0).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    z = F.try_divide(value - F.col("_mean"), F.sqrt("_var"))
    scored = attach_row(df, stats).withColumn("_z", z).filter(F.col("_z") > cut)
    return scored.withColumn("z_score", half_up(F.col("_z"), 2)).withColumn(
        "flag", F.when(F.col("_z") > high, "Outlier").otherwise("High")
    ).drop("_mean", "_var", "_z")


def zscore_outliers(
    df: DataFrame, amount: str, columns: list[str], n: int = 15, cut: float = 2.0, high: float = 3.0
) -> DataFrame:
    rows = zscore_rows(df, amount, cut, high)
    out = rows.select(*columns, half_up(F.col(amount), 0).alias("amount"), "z_score", "flag", F.col(amount).alias("_a"))
    top = out.orderBy(F.col("z_score").desc(), F.col("_a").desc(), *columns).limit(n)
    return top.drop("_a")

