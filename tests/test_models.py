import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.config import ForecastConfig
from vouchermill.operators import forecast, margin


def margin_ledger(make_ledger, months):
    rows = []
    for m, (sales, purchase) in months.items():
        if sales is not None:
            rows.append((f"{m}-10", "c", "Sales", sales))
        if purchase is not None:
            rows.append((f"{m}-11", "s", "Purchase", purchase))
    return make_ledger(rows)


def test_margin_months_and_health(make_ledger):
    months = {
        "2024-01": (100, 65), "2024-02": (10000, 6501), "2024-03": (100, 80), "2024-04": (100, 100),
        "2024-05": (10000, 10001), "2024-06": (100, None), "2024-07": (None, 100),
    }
    ledger = margin_ledger(make_ledger, months)
    got = rows_of(margin.ridge_margin(ledger), "month")
    # a month without either side is no margin month
    assert [r["month"] for r in got] == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    assert [r["actual_margin_pct"] for r in got] == [35.0, 34.99, 20.0, 0.0, -0.01]
    assert [r["health_status"] for r in got] == ["Healthy", "Warning", "Warning", "Critical", "Loss"]
    assert [r["months"] for r in rows_of(margin.health_counts(ledger), "label_order")] == [1, 2, 1, 1]
    assert [r["month"] for r in rows_of(margin.worst_margin_months(ledger, 2))] == ["2024-05", "2024-04"]
    profile = {r["fiscal_year"]: r for r in rows_of(margin.margin_profile(ledger))}
    assert profile["all"]["best_month"] == "2024-01" and profile["all"]["worst_month"] == "2024-05"
    assert profile["2024-25"]["drop_points"] == pytest.approx(30.0, abs=0.05)


def test_ridge_with_a_penalty_that_matters(make_ledger):
    # amounts of a few units, so that alpha = 1 moves the coefficients
    rnd = np.random.default_rng(3)
    x, z = rnd.uniform(2, 6, 12).round(2), rnd.uniform(1, 4, 12).round(2)
    ledger = margin_ledger(make_ledger, {f"2024-{i + 1:02d}": (x[i], z[i]) for i in range(12)})
    y = np.round((x - z) / x * 100, 2)
    a = np.column_stack([x - x.mean(), z - z.mean()])
    beta = np.linalg.solve(a.T @ a + np.eye(2), a.T @ (y - y.mean()))
    intercept = y.mean() - beta @ [x.mean(), z.mean()]
    model = margin.ridge_coefficients(margin.monthly_margin(ledger), alpha=1.0, scale=1.0).collect()[0]
    assert (model.b_sales, model.b_purchase, model.intercept) == pytest.approx((*beta, intercept), rel=1e-6)
    # the unit of the result does not change the fit
    scaled = margin.ridge_coefficients(margin.monthly_margin(ledger), alpha=1.0, scale=10.0).collect()[0]
    assert (scaled.b_sales, scaled.b_purchase) == pytest.approx(tuple(beta * 10), rel=1e-6)
    # without a penalty the coefficients are clearly different
    plain = np.linalg.lstsq(a, y - y.mean(), rcond=None)[0]
    assert abs(plain[1] - beta[1]) > 0.5
    pred = x * beta[0] + z * beta[1] + intercept
    got = rows_of(margin.ridge_margin(ledger, scale=1.0), "month")
    assert [r["predicted_margin_pct"] for r in got] == pytest.approx(list(pred.round(2)), abs=0.011)
    quality = rows_of(margin.ridge_quality(ledger, scale=1.0))[0]
    r2 = 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert quality["r2"] == pytest.approx(r2, abs=1e-4)
    target = {r["target_margin_pct"]: r for r in rows_of(margin.what_if(ledger, scale=1.0))}
    want = (30 - beta[0] * x.mean() - intercept) / beta[1]
    assert target[30]["max_purchase_lakhs"] == pytest.approx(want, abs=0.01)


def sales_ledger(make_ledger, values, start=(2024, 4)):
    rows = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i
        rows.append((f"{start[0] + m // 12}-{m % 12 + 1:02d}-15", "c", "Sales", v))
    return make_ledger(rows)


def design(n, start_month=4, first=1):
    period = np.arange(first, first + n, dtype=float)
    moy = (start_month - 1 + period - 1) % 12 + 1
    return np.column_stack(
        [period, np.sin(2 * np.pi * moy / 12), np.cos(2 * np.pi * moy / 12), (period > 12).astype(float)]
    )


def least_squares(x, y):
    """Minimum-norm fit around the means."""
    beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-9)[0]
    return beta, y.mean() - x.mean(0) @ beta


@pytest.fixture()
def series():
    rnd = np.random.default_rng(11)
    return (2e6 + 3e4 * np.arange(24) + rnd.normal(0, 3e5, 24)).round(2)


def test_trend_fit(make_ledger, series):
    features = forecast.monthly_features(forecast.monthly_series(sales_ledger(make_ledger, series)))
    x = design(24)
    beta, b0 = least_squares(x, series)
    fit = forecast.trend_coefficients(features).collect()[0]
    assert [fit.intercept, fit.b_period, fit.b_sin_month, fit.b_cos_month, fit.b_step] == pytest.approx([b0, *beta], rel=1e-6)
    residual = series - x @ beta - b0
    got = rows_of(forecast.trend_fit(features))[0]
    assert got["months"] == 24
    assert got["mae"] == pytest.approx(abs(residual).mean(), abs=0.1)
    assert got["residual_std"] == pytest.approx(residual.std(), abs=0.1)
    assert got["r2"] == pytest.approx(1 - (residual**2).sum() / ((series - series.mean()) ** 2).sum(), abs=1e-5)
    ahead = rows_of(forecast.point_forecast(features), "month")
    future = design(6, first=25)
    assert [r["month"] for r in ahead] == ["2026-04", "2026-05", "2026-06", "2026-07", "2026-08", "2026-09"]
    assert [r["forecast"] for r in ahead] == pytest.approx(list(future @ beta + b0), abs=1)


def test_bootstrap_equals_brute_force(make_ledger, series):
    config = ForecastConfig(replicas=40, horizon=3)
    features = forecast.monthly_features(forecast.monthly_series(sales_ledger(make_ledger, series)))
    x, future = design(24), design(3, first=25)
    future[:, 3] = 1
    runs = []
    for rep in range(40):
        pick = [int(hashlib.md5(f"{rep}-{d}".encode()).hexdigest()[:8], 16) % 24 for d in range(24)]
        beta, b0 = least_squares(x[pick], series[pick])
        runs.append(future @ beta + b0)
    runs = np.array(runs)
    got = rows_of(forecast.bootstrap_forecast(features, config=config), "month")
    assert [r["mean"] for r in got] == pytest.approx(list(runs.mean(0)), rel=1e-6)
    assert [r["low"] for r in got] == pytest.approx(list(np.percentile(runs, 5, axis=0)), rel=1e-6)
    assert [r["high"] for r in got] == pytest.approx(list(np.percentile(runs, 95, axis=0)), rel=1e-6)
    timeline = rows_of(forecast.forecast_timeline(features, config=config), "month")
    assert [r["type"] for r in timeline] == ["Actual"] * 24 + ["Forecast"] * 3
    assert timeline[0]["lower_bound"] is None and timeline[-1]["lower_bound"] is not None
    profile = rows_of(forecast.forecast_profile(forecast.forecast_timeline(features, config=config)))[0]
    assert profile["avg_actual"] == pytest.approx(series.mean(), abs=1)
    assert profile["best_month"] == f"2026-{4 + int(runs.mean(0).argmax()):02d}"


def test_rank_deficient_fit_has_minimum_norm(make_ledger):
    # three months: fewer rows than features
    y = np.array([100.0, 120.0, 90.0])
    features = forecast.monthly_features(forecast.monthly_series(sales_ledger(make_ledger, y)))
    beta, b0 = least_squares(design(3), y)
    fit = forecast.trend_coefficients(features).collect()[0]
    got = [fit.intercept, fit.b_period, fit.b_sin_month, fit.b_cos_month, fit.b_step]
    assert got == pytest.approx([b0, *beta], rel=1e-5, abs=1e-5)


def test_one_fit_per_key(spark, make_ledger, series):
    ledger = sales_ledger(make_ledger, series).withColumn("region", F.lit("north"))
    other = sales_ledger(make_ledger, series[::-1][:15]).withColumn("region", F.lit("south"))
    both = ledger.unionByName(other)
    features = forecast.monthly_features(forecast.monthly_series(both, ("region",)), ("region",))
    got = {r["region"]: r for r in rows_of(forecast.trend_fit(features, ("region",)))}
    alone = rows_of(forecast.trend_fit(forecast.monthly_features(forecast.monthly_series(ledger))))[0]
    assert got["north"]["r2"] == alone["r2"]
    assert (got["north"]["months"], got["south"]["months"]) == (24, 15)
