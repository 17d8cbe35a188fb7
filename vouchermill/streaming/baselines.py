"""Baselines that grow with a stream.

Every batch adds the counts of its own rows to a log (see ``batch_log``): rows
and sum per entity and value bucket (``level=bucket``), rows per entity and
amount (``level=amount``). Counts of batches add up, so quartiles of everything
seen come from the counts: first from those of the buckets, then from the amounts
of the few buckets that hold a quartile. The history itself is never read again,
and however rows fall into batches, the baselines are those of all rows at once.

Both levels lie in folders by a hash of the entity, so that a batch that knows few
entities opens few folders. A hot entity's counts are spread over many files.
Rows without entity or without amount have no baseline and add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchermill.config import IqrConfig
from vouchermill.functions.numeric import value_bucket
from vouchermill.operators.anomalies import fences, flag_rows
from vouchermill.operators.quantiles import counted_quartiles
from vouchermill.streaming.batch_log import is_folded, mark_folded, part_folder, read_parts

#: folders of an entity hash below each level
PARTS = 16

_COUNTS = ("_e", "_b", "_a", "_n", "_s", "level", "part")


def log_schema(entity_type: str = "string") -> str:
    return f"_e {entity_type}, _b int, _a decimal(18,2), _n long, _s decimal(28,2), level string, part int, kind string, number long"


def part_of(entity: Column) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(PARTS)).cast("int")


def _added(counts: DataFrame) -> DataFrame:
    """Counts of both levels from parts of them. Buckets have no amount, so one
    aggregate adds up both."""
    added = counts.groupBy("level", "part", "_e", "_b", "_a").agg(
        F.sum("_n").alias("_n"), F.sum("_s").cast("decimal(28,2)").alias("_s")
    )
    return added.select(*_COUNTS)


def counts_of(rows: DataFrame, entity: str, amount: str) -> DataFrame:
    """What some rows add to the log."""
    known = rows.select(F.col(entity).alias("_e"), F.col(amount).cast("decimal(18,2)").alias("_a")).dropna()
    once = known.withColumn("_b", value_bucket(F.col("_a"))).withColumn("part", part_of(F.col("_e")))
    # an amount counts at its own level and, without the amount, at the level of its bucket
    both = once.select(
        "_e", "_b", "part", F.lit(1).alias("_n"), F.col("_a").alias("_s"),
        F.inline(
            F.array(
                F.struct(F.lit("amount").alias("level"), F.col("_a").alias("_a")),
                F.struct(F.lit("bucket").alias("level"), F.lit(None).cast("decimal(18,2)").alias("_a")),
            )
        ),
    )
    return _added(both)


def _write(counts: DataFrame, folder: str) -> None:
    # a file or so per folder, more where an entity is hot
    counts.hint("rebalance", "level", "part").write.partitionBy("level", "part").mode("overwrite").parquet(folder)


def add_batch(batch: DataFrame, number: int, target: str, entity: str, amount: str) -> None:
    _write(counts_of(batch, entity, amount), part_folder(target, "batch", number))


def read_baselines(
    spark: SparkSession,
    target: str,
    entity: str,
    entity_type: str = "string",
    upto: int | None = None,
    only: DataFrame | None = None,
    config: IqrConfig = IqrConfig(),
) -> DataFrame:
    """Row count, mean, quartiles and fences per entity over the batches up to a
    number, as ``iqr_limits`` gives them for the same rows.

    ``only`` holds rows of the entities wanted, in the column ``entity``.
    """
    log = read_parts(spark, target, log_schema(entity_type), upto)
    counts = log.filter(F.col("level") == "bucket")
    if only is not None:
        wanted = only.select(F.col(entity).alias("_e"), part_of(F.col(entity)).alias("part")).distinct()
        # at most PARTS rows: they prune folders at run time
        parts = F.broadcast(wanted.select("part").distinct())
        log = log.join(parts, "part", "left_semi")
        # the amounts meet the wanted entities' buckets anyway, so only the buckets are reduced to them here
        counts = counts.join(parts, "part", "left_semi").join(wanted, ["part", "_e"], "left_semi")
    buckets = counts.groupBy("_e", "_b").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    amounts = log.filter(F.col("level") == "amount").select("_e", "_b", "_a", "_n")
    quartiles = counted_quartiles(buckets, amounts).withColumnRenamed("_e", entity)
    return fences(quartiles, entity, config)


def compact_baselines(spark: SparkSession, target: str, upto: int, entity_type: str = "string") -> None:
    """Fold the batches up to a number into one folder; may be repeated."""
    schema = log_schema(entity_type)
    if is_folded(spark, target, schema, upto):
        return
    _write(_added(read_parts(spark, target, schema, upto)), part_folder(target, "base", upto))
    mark_folded(spark, target, upto, "_n", "long", "/level=none/part=0")


def score_and_learn(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    entity: str,
    amount: str,
    entity_type: str = "string",
    config: IqrConfig = IqrConfig(),
) -> StreamingQuery:
    """Flag the rows of each batch against the baselines of the batches before it
    (``target/flags/batch=N``), then add the batch to them (``target/log``).

    A batch reads only what earlier numbers left and overwrites its own folders, so
    one that is repeated after a failure gives the same flags and counts once.
    """
    log = f"{target}/log"
    spark = stream.sparkSession
    # an empty base, so that there is always something to read
    empty = spark.createDataFrame([], log_schema(entity_type)).select(*_COUNTS)
    empty.write.partitionBy("level", "part").mode("ignore").parquet(part_folder(log, "base", -1))

    def save(batch: DataFrame, number: int) -> None:
        before = read_baselines(batch.sparkSession, log, entity, entity_type, number - 1, batch, config)
        limits = before.filter(F.col("row_count") >= config.min_rows).select(entity, "mean", "low", "high")
        flag_rows(batch, limits, entity, amount).write.mode("overwrite").parquet(f"{target}/flags/batch={number}")
        add_batch(batch, number, log, entity, amount)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )
