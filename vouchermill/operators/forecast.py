"""Monthly revenue model: trend, yearly cycle and a step, per key.

A series is one row per key and month, so its length is bounded by the calendar.
All sums run in Spark; Python only solves the small normal equations, in Arrow
batches of one row per key or per replica.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vouchermill.config import ForecastConfig
from vouchermill.functions.calendar import month_bucket
from vouchermill.functions.categories import is_category
from vouchermill.functions.numeric import half_up, percent
from vouchermill.operators.joins import attach_row

FEATURES = ("period", "sin_month", "cos_month", "step")
_COLUMNS = FEATURES + ("revenue",)
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
COEFFICIENTS = ("intercept",) + tuple(f"b_{f}" for f in FEATURES)

# relative size below which a direction of the normal equations counts as empty
_RANK_TOLERANCE = 1e-11


def monthly_series(ledger: DataFrame, keys: tuple = ()) -> DataFrame:
    sales = ledger.filter(is_category("Sales"))
    return sales.groupBy(*keys, F.trunc("txn_date", "MM").alias("month_start")).agg(
        F.sum("debit_amount").alias("amount")
    )


def _cycle(month_of_year):
    angle = F.lit(2.0 * float(np.pi)) * month_of_year.cast("double") / 12.0
    return F.sin(angle), F.cos(angle)


def monthly_features(series: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Month number, month of year, its sine and cosine and the step flag."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("month_start"))
    moy = F.month("month_start")
    sin, cos = _cycle(moy)
    out = series.withColumns({"period": number, "month_of_year": moy, "sin_month": sin, "cos_month": cos})
    step = F.when(F.col("period") > config.step_after, 1).otherwise(0)
    return out.withColumns({"step": step, "revenue": F.col("amount").cast("double")})


def future_frame(features: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Features of the months after the last one."""
    last = features.groupBy(*keys).agg(
        F.max("month_start").alias("last_month"), F.max("period").alias("last_period")
    )
    ahead = last.filter(F.col("last_month").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(config.horizon))).alias("ahead")
    )
    month = F.add_months("last_month", F.col("ahead"))
    sin, cos = _cycle(F.month(month))
    return ahead.select(
        *keys,
        "ahead",
        month.alias("month_start"),
        (F.col("last_period") + F.col("ahead")).alias("period"),
        F.month(month).alias("month_of_year"),
        sin.alias("sin_month"),
        cos.alias("cos_month"),
        F.lit(1).alias("step"),
    )


def _centred(features: DataFrame, keys: tuple) -> DataFrame:
    """Features as doubles around the mean of their key, and those means."""
    w = Window.partitionBy(*keys)
    means = {f"m{i}": F.avg(F.col(c).cast("double")).over(w) for i, c in enumerate(_COLUMNS)}
    out = features.withColumns(means)
    return out.withColumns({f"c{i}": F.col(c).cast("double") - F.col(f"m{i}") for i, c in enumerate(_COLUMNS)})


def _gram(rows: DataFrame, keys: list) -> DataFrame:
    """Sums and products of the centred columns per key."""
    aggregates = [F.count(F.lit(1)).cast("double").alias("n")]
    aggregates += [F.max(f"m{i}").alias(f"m{i}") for i in range(5)]
    aggregates += [F.sum(f"c{i}").alias(f"s{i}") for i in range(5)]
    aggregates += [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(*aggregates)


def _solve(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Minimum-norm least squares from sums, one fit per row."""
    for batch in batches:
        n = batch["n"].to_numpy()
        means = batch[[f"m{i}" for i in range(5)]].to_numpy()
        sums = batch[[f"s{i}" for i in range(5)]].to_numpy()
        products = np.zeros((len(batch), 5, 5))
        for i, j in _PAIRS:
            products[:, i, j] = products[:, j, i] = batch[f"p{i}{j}"].to_numpy()
        gram = products - sums[:, :, None] * sums[:, None, :] / n[:, None, None]
        inverse = np.linalg.pinv(gram[:, :4, :4], rcond=_RANK_TOLERANCE, hermitian=True)
        slopes = np.einsum("kij,kj->ki", inverse, gram[:, :4, 4])
        centre = means + sums / n[:, None]
        out = batch[keys].copy()
        out["intercept"] = centre[:, 4] - (slopes * centre[:, :4]).sum(axis=1)
        for i, name in enumerate(FEATURES):
            out[f"b_{name}"] = slopes[:, i]
        yield out


def _fit(gram: DataFrame, keys: list[str]) -> DataFrame:
    schema = StructType(
        [gram.schema[k] for k in keys] + [StructField(c, DoubleType()) for c in COEFFICIENTS]
    )
    return gram.mapInPandas(lambda batches: _solve(batches, keys), schema)


def _predict():
    value = F.col("intercept")
    for f in FEATURES:
        value = value + F.col(f"b_{f}") * F.col(f).cast("double")
    return value


def _attach(rows: DataFrame, fits: DataFrame, keys: tuple) -> DataFrame:
    return rows.join(fits, list(keys)) if keys else attach_row(rows, fits)


def trend_coefficients(features: DataFrame, keys: tuple = ()) -> DataFrame:
    return _fit(_gram(_centred(features, keys), list(keys)), list(keys))


def trend_fit(features: DataFrame, keys: tuple = ()) -> DataFrame:
    """Quality of the ordinary least-squares fit per key."""
    fitted = _attach(features, trend_coefficients(features, keys), keys)
    residual = F.col("revenue") - _predict()
    scored = fitted.withColumn("residual", residual)
    n = F.count(F.lit(1)).cast("double")
    q = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        (F.var_pop("revenue") * n).alias("sst"),
        F.avg(F.abs("residual")).alias("mae"),
        F.stddev_pop("residual").alias("std"),
    )
    return q.select(
        *keys,
        "months",
        half_up(1.0 - F.try_divide(F.col("sse"), F.col("sst")), 6).alias("r2"),
        half_up(F.col("mae"), 1).alias("mae"),
        half_up(F.col("std"), 1).alias("residual_std"),
    )


def point_forecast(features: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Forecast of the plain fit, without resampling."""
    ahead = _attach(future_frame(features, keys, config), trend_coefficients(features, keys), keys)
    return ahead.select(
        *keys, month_bucket(F.col("month_start")).alias("month"), half_up(_predict(), 0).alias("forecast")
    )


def _draw(replica, draw, n):
    """Row that a draw picks: a hash of the replica and draw numbers, so that any
    engine and any retry picks the same."""
    digest = F.md5(F.concat(replica.cast("string"), F.lit("-"), draw.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n)


def bootstrap_fits(features: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """One fit per key and replica of the resampled months.

    The months of a key travel as one small array; replicas and draws are
    generated next to it and summed at once, so only one row of sums per replica
    is shuffled.
    """
    names = [f"m{i}" for i in range(5)] + [f"c{i}" for i in range(5)]
    months = _centred(features, keys).select(*keys, F.struct("period", *names).alias("row"))
    packed = months.groupBy(*keys).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    packed = packed.withColumn("size", F.size("rows").cast("bigint")).filter(F.col("size") > 0)
    replicas = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(config.replicas - 1))).alias("replica"))
    draws = replicas.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("draw"))
    picked = draws.select(
        *keys,
        "replica",
        F.element_at("rows", (_draw(F.col("replica"), F.col("draw"), F.col("size")) + 1).cast("int")).alias("row"),
    )
    flat = picked.select(*keys, "replica", *[F.col(f"row.{n}").alias(n) for n in names])
    grouping = [*keys, "replica"]
    return _fit(_gram(flat, grouping), grouping)


def bootstrap_forecast(
    features: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig()
) -> DataFrame:
    """Mean and percentile interval of the replicas' forecasts per month."""
    fits = bootstrap_fits(features, keys, config)
    future = future_frame(features, keys, config)
    # the few months ahead of a key travel as one array
    names = ("month_start",) + FEATURES
    packed = future.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("months"))
    ahead = _attach(fits, packed, keys).select("*", F.explode("months").alias("m"))
    ahead = ahead.select(*keys, *COEFFICIENTS, *[F.col(f"m.{n}").alias(n) for n in names])
    tail = (100 - config.confidence) / 200.0
    grouped = ahead.groupBy(*keys, "month_start").agg(
        F.avg(_predict()).alias("mean"),
        # as many values as replicas, a fixed number
        F.percentile(_predict(), [tail, 1.0 - tail]).alias("range"),
    )
    return grouped.select(
        *keys,
        month_bucket(F.col("month_start")).alias("month"),
        F.col("mean"),
        F.col("range")[0].alias("low"),
        F.col("range")[1].alias("high"),
    )


def rounded_forecast(forecast: DataFrame, keys: tuple = (), digits: int = 2) -> DataFrame:
    return forecast.select(
        *keys,
        "month",
        half_up(F.col("mean"), digits).alias("forecast_revenue"),
        half_up(F.col("low"), digits).alias("lower_bound"),
        half_up(F.col("high"), digits).alias("upper_bound"),
    )


def forecast_timeline(
    features: DataFrame, keys: tuple = (), config: ForecastConfig = ForecastConfig(), digits: int = 2
) -> DataFrame:
    """Actual months without bounds, then forecast months with them."""
    nothing = F.lit(None).cast("double")
    actual = features.select(
        *keys,
        month_bucket(F.col("month_start")).alias("month"),
        half_up(F.col("amount"), digits).alias("forecast_revenue"),
        nothing.alias("lower_bound"),
        nothing.alias("upper_bound"),
        F.lit("Actual").alias("type"),
    )
    ahead = rounded_forecast(bootstrap_forecast(features, keys, config), keys, digits)
    return actual.unionByName(ahead.withColumn("type", F.lit("Forecast")))


def forecast_profile(timeline: DataFrame) -> DataFrame:
    """Mean of actual and forecast months, growth, best and weakest month."""
    value = F.col("forecast_revenue")
    is_actual = F.col("type") == "Actual"
    ahead = F.when(~is_actual, F.struct(value.alias("v"), F.col("month").alias("m")))
    q = timeline.agg(
        F.avg(F.when(is_actual, value)).alias("a"),
        F.avg(F.when(~is_actual, value)).alias("f"),
        F.max(ahead).alias("best"),
        F.min(ahead).alias("worst"),
    )
    return q.select(
        half_up(F.col("a"), 0).alias("avg_actual"),
        half_up(F.col("f"), 0).alias("avg_forecast"),
        half_up(percent(F.col("f") - F.col("a"), F.col("a")), 1).alias("growth_pct"),
        F.col("best.m").alias("best_month"),
        F.col("worst.m").alias("weakest_month"),
    )
