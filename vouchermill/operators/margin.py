"""Monthly margins and the two-feature ridge model of the margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchermill.config import LAKH, MarginConfig
from vouchermill.functions.calendar import fiscal_year
from vouchermill.functions.numeric import exact, half_up, percent
from vouchermill.functions.parsing import label_rank
from vouchermill.operators.joins import attach_row
from vouchermill.operators.reports import MONTH, monthly_sales_purchase


def monthly_margin(ledger: DataFrame) -> DataFrame:
    """Margin and cost ratio (two decimals) of months with sales and purchases,
    with a running month number and a flag for the months after the first year."""
    m = monthly_sales_purchase(ledger)
    s, p = F.col("sales"), F.col("purchase")
    # one row per calendar month
    number = F.row_number().over(Window.orderBy("month_start"))
    out = m.select(
        "month_start",
        MONTH,
        fiscal_year(F.col("month_start")).alias("fiscal_year"),
        s,
        p,
        (s - p).alias("gross_margin"),
        exact(percent(s - p, s), 2).alias("margin_pct"),
        exact(percent(p, s), 2).alias("cost_ratio_pct"),
        number.alias("month_number"),
    )
    return out.withColumn("after_first_year", F.when(F.col("month_number") > 12, 1).otherwise(0))


def margin_table(ledger: DataFrame) -> DataFrame:
    m = monthly_margin(ledger)
    return m.select(
        MONTH,
        "fiscal_year",
        "month_number",
        "after_first_year",
        half_up(F.col("sales"), 2).alias("sales"),
        half_up(F.col("purchase"), 2).alias("purchase"),
        half_up(F.col("gross_margin"), 2).alias("gross_margin"),
        F.col("margin_pct").cast("double").alias("margin_pct"),
        F.col("cost_ratio_pct").cast("double").alias("cost_ratio_pct"),
    ).orderBy(MONTH)


def margin_health(pct: Column, config: MarginConfig = MarginConfig()) -> Column:
    healthy, warning, critical, loss = config.labels
    return (
        F.when(pct >= config.healthy, healthy)
        .when(pct >= config.warning, warning)
        .when(pct >= config.critical, critical)
        .otherwise(loss)
    )


def _fit_points(margin: DataFrame, scale: float) -> DataFrame:
    return margin.withColumns(
        {
            "x": F.col("sales").cast("double") / scale,
            "z": F.col("purchase").cast("double") / scale,
            "y": F.col("margin_pct").cast("double"),
        }
    )


def ridge_coefficients(
    margin: DataFrame, keys: tuple = (), alpha: float = 1.0, scale: float = float(LAKH)
) -> DataFrame:
    """Ridge of margin on sales and purchase with a free intercept, per key.

    One aggregate of means and (co)variances and the closed solution of the
    two-by-two system. ``alpha`` weighs the coefficients of the unscaled amounts;
    ``scale`` only sets the unit of the result.
    """
    points = _fit_points(margin, scale)
    n = F.count(F.lit(1)).cast("double")
    stats = points.groupBy(*keys).agg(
        n.alias("n"),
        *[F.avg(c).alias(f"m{c}") for c in "xzy"],
        (F.var_pop("x") * n + alpha / scale**2).alias("sxx"),
        (F.var_pop("z") * n + alpha / scale**2).alias("szz"),
        (F.covar_pop("x", "z") * n).alias("sxz"),
        (F.covar_pop("x", "y") * n).alias("sxy"),
        (F.covar_pop("z", "y") * n).alias("szy"),
    )
    c = F.col
    det = c("sxx") * c("szz") - c("sxz") * c("sxz")
    b1 = F.try_divide(c("sxy") * c("szz") - c("szy") * c("sxz"), det)
    b2 = F.try_divide(c("szy") * c("sxx") - c("sxy") * c("sxz"), det)
    return stats.select(
        *keys,
        F.col("n").cast("bigint").alias("n"),
        b1.alias("b_sales"),
        b2.alias("b_purchase"),
        (c("my") - b1 * c("mx") - b2 * c("mz")).alias("intercept"),
        c("mx").alias("avg_sales"),
        c("mz").alias("avg_purchase"),
    )


def _with_prediction(margin: DataFrame, alpha: float, scale: float) -> DataFrame:
    model = ridge_coefficients(margin, alpha=alpha, scale=scale)
    points = attach_row(_fit_points(margin, scale), model)
    predicted = F.col("b_sales") * F.col("x") + F.col("b_purchase") * F.col("z") + F.col("intercept")
    return points.withColumn("predicted", predicted).withColumn("residual", F.col("y") - F.col("predicted"))


def ridge_margin(ledger: DataFrame, config: MarginConfig = MarginConfig(), scale: float = float(LAKH)) -> DataFrame:
    """In-sample prediction per month with health labels."""
    p = _with_prediction(monthly_margin(ledger), config.alpha, scale)
    predicted = exact(F.col("predicted"), 2)
    return p.select(
        MONTH,
        "fiscal_year",
        half_up(F.col("sales"), 2).alias("sales"),
        half_up(F.col("purchase"), 2).alias("purchase"),
        half_up(F.col("gross_margin"), 2).alias("gross_margin"),
        F.col("y").alias("actual_margin_pct"),
        predicted.cast("double").alias("predicted_margin_pct"),
        F.col("cost_ratio_pct").cast("double").alias("cost_ratio_pct"),
        half_up(F.col("residual"), 2).alias("prediction_error_pct"),
        half_up(F.abs("residual"), 2).alias("abs_error_pct"),
        margin_health(F.col("margin_pct"), config).alias("health_status"),
        margin_health(predicted, config).alias("predicted_health_status"),
    ).orderBy(MONTH)


def ridge_quality(ledger: DataFrame, config: MarginConfig = MarginConfig(), scale: float = float(LAKH)) -> DataFrame:
    """Coefficients per 100,000 of amount, R², mean and largest absolute error."""
    p = _with_prediction(monthly_margin(ledger), config.alpha, scale)
    sse = F.sum(F.col("residual") * F.col("residual"))
    sst = F.var_pop("y") * F.count(F.lit(1)).cast("double")
    q = p.groupBy("n", "b_sales", "b_purchase", "intercept").agg(
        (1.0 - F.try_divide(sse, sst)).alias("r2"),
        F.avg(F.abs("residual")).alias("mae"),
        F.max(F.abs("residual")).alias("max_error"),
    )
    return q.select(
        "n",
        half_up(F.col("b_sales"), 4).alias("sales_coef_per_lakh"),
        half_up(F.col("b_purchase"), 4).alias("purchase_coef_per_lakh"),
        half_up(F.col("intercept"), 3).alias("intercept"),
        half_up(F.col("r2"), 4).alias("r2"),
        half_up(F.col("mae"), 3).alias("mae"),
        half_up(F.col("max_error"), 3).alias("max_error"),
    )


def what_if(ledger: DataFrame, config: MarginConfig = MarginConfig(), scale: float = float(LAKH)) -> DataFrame:
    """Largest purchase that still reaches each target margin at average sales."""
    model = ridge_coefficients(monthly_margin(ledger), alpha=config.alpha, scale=scale)
    targets = F.array(*[F.lit(t) for t in config.targets])
    rows = model.select("*", F.explode(targets).alias("target_margin_pct"))
    limit = F.try_divide(
        F.col("target_margin_pct") - F.col("b_sales") * F.col("avg_sales") - F.col("intercept"), F.col("b_purchase")
    )
    return rows.select(
        "target_margin_pct",
        half_up(limit, 2).alias("max_purchase_lakhs"),
        half_up(percent(limit, F.col("avg_sales")), 1).alias("cost_ratio_pct"),
        half_up(F.col("avg_purchase"), 2).alias("avg_purchase_lakhs"),
        half_up(F.abs("b_purchase"), 4).alias("points_per_lakh_saved"),
    ).orderBy(F.col("target_margin_pct").desc())


def simple_line(ledger: DataFrame) -> DataFrame:
    """Least-squares line of margin over purchase and their correlation."""
    p = _fit_points(monthly_margin(ledger), float(LAKH))
    q = p.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "z").alias("slope"),
        F.regr_intercept("y", "z").alias("intercept"),
        F.corr("z", "y").alias("r"),
    )
    return q.select(
        "n",
        half_up(F.col("slope"), 5).alias("slope_per_lakh"),
        half_up(F.col("intercept"), 4).alias("intercept"),
        half_up(F.col("r"), 4).alias("correlation"),
    )


def margin_profile(ledger: DataFrame, config: MarginConfig = MarginConfig()) -> DataFrame:
    """Mean margin, best and worst month and months per label, by fiscal year and
    over all years, with the drop against the year before."""
    m = monthly_margin(ledger).withColumn("health", margin_health(F.col("margin_pct"), config))
    healthy, warning, critical, loss = config.labels
    labels = {"healthy": healthy, "warning": warning, "critical": critical, "loss": loss}
    best = F.struct("margin_pct", MONTH)
    columns = [
        F.count(F.lit(1)).alias("months"),
        F.sum("margin_pct").alias("s"),
        F.max(best).alias("best"),
        F.min(best).alias("worst"),
        *[F.count(F.when(F.col("health") == v, 1)).alias(f"{k}_months") for k, v in labels.items()],
    ]
    overall = m.agg(*columns).withColumn("fiscal_year", F.lit("all"))
    years = m.groupBy("fiscal_year").agg(*columns).unionByName(overall)
    mean = F.try_divide(F.col("s").cast("double"), F.col("months").cast("double"))
    rows = years.withColumn("mean", mean)
    # few rows: one per fiscal year
    w = Window.orderBy("fiscal_year")
    drop = F.when(F.col("fiscal_year") != "all", F.lag("mean").over(w) - F.col("mean"))
    return rows.withColumn("drop", drop).select(
        "fiscal_year",
        "months",
        half_up(F.col("mean"), 1).alias("mean_margin_pct"),
        half_up(F.col("drop"), 1).alias("drop_points"),
        F.col(f"best.{MONTH}").alias("best_month"),
        F.col("best.margin_pct").cast("double").alias("best_margin_pct"),
        F.col(f"worst.{MONTH}").alias("worst_month"),
        F.col("worst.margin_pct").cast("double").alias("worst_margin_pct"),
        *[f"{k}_months" for k in labels],
    ).orderBy("fiscal_year")


def worst_margin_months(ledger: DataFrame, n: int = 3) -> DataFrame:
    m = monthly_margin(ledger)
    return (
        m.orderBy("margin_pct", MONTH)
        .limit(n)
        .select(MONTH, F.col("margin_pct").cast("double").alias("margin_pct"))
    )


def health_counts(ledger: DataFrame, config: MarginConfig = MarginConfig()) -> DataFrame:
    m = monthly_margin(ledger).withColumn("health_status", margin_health(F.col("margin_pct"), config))
    counts = m.groupBy("health_status").agg(F.count(F.lit(1)).alias("months"))
    return counts.select(
        (label_rank(F.col("health_status"), config.labels) + 1).alias("label_order"), "health_status", "months"
    ).orderBy("label_order")
