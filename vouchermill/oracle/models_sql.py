"""SQL of the forecast and margin queries.

The trend regression is solved here by orthogonalising the features one after the
other (each step is a simple regression), not by the normal equations.
"""

from vouchermill.oracle.ledger_sql import fy, mean, pct, r, with_ledger
from vouchermill.oracle.reports_sql import MARGIN_MONTHS

S = {}

# ---------------------------------------------------------------- margin

_MARGIN = f"""{MARGIN_MONTHS},
mg as (select month, cast(month || '-01' as date) as ms, sales, purchase, sales - purchase as gross_margin,
  round(cast({pct('sales - purchase', 'sales')} as decimal(38,6)), 2) as margin_pct,
  round(cast({pct('purchase', 'sales')} as decimal(38,6)), 2) as cost_ratio_pct,
  cast(row_number() over (order by month) as integer) as month_number from mm),
pts as (select *, {fy('ms')} as fiscal_year, cast(sales as double) / 100000 as x, cast(purchase as double) / 100000 as z,
  cast(margin_pct as double) as y from mg)"""


def _health(p):
    return f"case when {p} >= 35 then 'Healthy' when {p} >= 20 then 'Warning' when {p} >= 0 then 'Critical' else 'Loss' end"


def _model(scale):
    alpha = 1.0 / scale**2
    return f"""{_MARGIN.replace('/ 100000', f'/ {scale}')},
st as (select count(*) as n, avg(x) as mx, avg(z) as mz, avg(y) as my, var_pop(x) * count(*) + {alpha!r} as sxx,
  var_pop(z) * count(*) + {alpha!r} as szz, covar_pop(x, z) * count(*) as sxz, covar_pop(x, y) * count(*) as sxy,
  covar_pop(z, y) * count(*) as szy from pts),
b as (select *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) as b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) as b2 from st),
model as (select *, my - b1 * mx - b2 * mz as b0 from b),
pred as (select pts.*, n, b1, b2, b0, mx, mz, b1 * x + b2 * z + b0 as p, y - (b1 * x + b2 * z + b0) as e from pts, model)"""


S["monthly_margin"] = with_ledger(
    f"""select month, fiscal_year, month_number, case when month_number > 12 then 1 else 0 end as after_first_year,
 {r('sales', 2)} as sales, {r('purchase', 2)} as purchase, {r('gross_margin', 2)} as gross_margin,
 cast(margin_pct as double) as margin_pct, cast(cost_ratio_pct as double) as cost_ratio_pct from pts""",
    _MARGIN,
)
_P2 = "round(cast(p as decimal(38,6)), 2)"
S["ridge_margin"] = with_ledger(
    f"""select month, fiscal_year, {r('sales', 2)} as sales, {r('purchase', 2)} as purchase, {r('gross_margin', 2)} as gross_margin,
 y as actual_margin_pct, cast({_P2} as double) as predicted_margin_pct, cast(cost_ratio_pct as double) as cost_ratio_pct,
 {r('e', 2)} as prediction_error_pct, {r('abs(e)', 2)} as abs_error_pct, {_health('margin_pct')} as health_status,
 {_health(_P2)} as predicted_health_status from pred""",
    _model(100000.0),
)


def _quality(scale):
    return with_ledger(
        f"""select n, {r('b1', 4)} as sales_coef_per_lakh, {r('b2', 4)} as purchase_coef_per_lakh, {r('b0', 3)} as intercept,
 {r('1 - sum(e * e) / (var_pop(y) * count(*))', 4)} as r2, {r('avg(abs(e))', 3)} as mae, {r('max(abs(e))', 3)} as max_error
from pred group by n, b1, b2, b0""",
        _model(scale),
    )


S["ridge_quality"] = _quality(100000.0)
S["ridge_quality_scaled"] = _quality(1.0)
S["what_if"] = with_ledger(
    f"""select t as target_margin_pct, {r('cap', 2)} as max_purchase_lakhs, {r(pct('cap', 'mx'), 1)} as cost_ratio_pct,
 {r('mz', 2)} as avg_purchase_lakhs, {r('abs(b2)', 4)} as points_per_lakh_saved
from (select *, (t - b1 * mx - b0) / b2 as cap from model, (select unnest([40, 35, 30, 25, 20, 15]) as t))""",
    _model(100000.0),
)
S["simple_line"] = with_ledger(
    f"""select count(*) as n, {r('regr_slope(y, z)', 5)} as slope_per_lakh, {r('regr_intercept(y, z)', 4)} as intercept,
 {r('corr(y, z)', 4)} as correlation from pts""",
    _MARGIN,
)
S["margin_health"] = with_ledger(
    f"""select case h when 'Healthy' then 1 when 'Warning' then 2 when 'Critical' then 3 else 4 end as label_order,
 h as health_status, count(*) as months from (select {_health('margin_pct')} as h from pts) group by h""",
    _MARGIN,
)
S["feed_margin_colours"] = with_ledger(
    """select month, cast(margin_pct as double) as margin_pct,
 case when margin_pct > 30 then 'green' when margin_pct >= 15 then 'yellow' else 'red' end as colour from pts""",
    _MARGIN,
)
S["worst_margin_months"] = with_ledger(
    "select month, cast(margin_pct as double) as margin_pct from pts order by pts.margin_pct, month limit 3", _MARGIN
)
_PROFILE = f"""count(*) as months, {mean('sum(margin_pct)', 'count(*)')} as m,
  max(struct_pack(v := margin_pct, k := month)) as best, min(struct_pack(v := margin_pct, k := month)) as worst,
  count(*) filter (where {_health('margin_pct')} = 'Healthy') as healthy_months,
  count(*) filter (where {_health('margin_pct')} = 'Warning') as warning_months,
  count(*) filter (where {_health('margin_pct')} = 'Critical') as critical_months,
  count(*) filter (where {_health('margin_pct')} = 'Loss') as loss_months from pts"""
S["margin_profile"] = with_ledger(
    f"""select fiscal_year, months, {r('m', 1)} as mean_margin_pct, {r('d', 1)} as drop_points, best.k as best_month,
 cast(best.v as double) as best_margin_pct, worst.k as worst_month, cast(worst.v as double) as worst_margin_pct,
 healthy_months, warning_months, critical_months, loss_months
from (select *, lag(m) over (order by fiscal_year) - m as d from py union all select *, null from pa)""",
    f"""{_MARGIN},
py as (select fiscal_year, {_PROFILE} group by fiscal_year),
pa as (select 'all' as fiscal_year, {_PROFILE})""",
)

# ---------------------------------------------------------------- forecast

_PI = "6.283185307179586"


def _series(market):
    key = "c_mktsegment" if market else "0"
    source = "canon" if market else "ledger"
    join = "left join customer on particulars = c_name" if market else ""
    return f"""ser as (select {key} as k, date_trunc('month', txn_date) as ms, sum(debit_amount) as amount
  from {source} {join} where txn_category = 'Sales' group by 1, 2),
feat as (select k, cast(ms as date) as ms, amount, cast(amount as double) as y,
  row_number() over (partition by k order by ms) as period, cast(month(ms) as integer) as moy,
  sin({_PI}::double * month(ms) / 12.0) as x2, cos({_PI}::double * month(ms) / 12.0) as x3,
  case when row_number() over (partition by k order by ms) > 12 then 1 else 0 end as step from ser),
size_t as (select k, count(*) as n, max(ms) as last_ms from feat group by k),
fut as (select k, cast(last_ms + to_months(h) as date) as ms, n + h as period,
  cast(month(last_ms + to_months(h)) as integer) as moy,
  sin({_PI}::double * month(last_ms + to_months(h)) / 12.0) as x2,
  cos({_PI}::double * month(last_ms + to_months(h)) / 12.0) as x3, 1 as step
  from size_t, (select cast(unnest(generate_series(1, 6)) as integer) as h))"""


def _fit(source, keys):
    """Means and slopes of successive orthogonal features, per key."""
    k = ", ".join(keys)

    def residual(step, done):
        # value of feature ``step`` after removing the earlier features
        return f"(x{step} - m{step}" + "".join(f" - a{step}{j} * q{j}" for j in range(1, done + 1)) + ")"

    ctes = [
        f"""f0 as (select {k}, y, cast(period as double) as x1, x2, x3, cast(step as double) as x4 from {source}),
fm as (select {k}, avg(y) as my, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(x4) as m4 from f0 group by {k}),
g1 as (select f0.*, my, m1, m2, m3, m4, x1 - m1 as q1 from f0 join fm using ({k})),
s1 as (select {k}, regr_slope(y, q1) as b1, regr_slope(x2, q1) as a21, regr_slope(x3, q1) as a31, regr_slope(x4, q1) as a41 from g1 group by {k}),
g2 as (select g1.*, a21, a31, a41, {residual(2, 1)} as q2 from g1 join s1 using ({k})),
s2 as (select {k}, regr_slope(y, q2) as b2, regr_slope(x3, q2) as a32, regr_slope(x4, q2) as a42 from g2 group by {k}),
g3 as (select g2.*, a32, a42, {residual(3, 2)} as q3 from g2 join s2 using ({k})),
s3 as (select {k}, regr_slope(y, q3) as b3, regr_slope(x4, q3) as a43 from g3 group by {k}),
g4 as (select g3.*, a43, {residual(4, 3)} as q4 from g3 join s3 using ({k})),
s4 as (select {k}, regr_slope(y, q4) as b4 from g4 group by {k}),
fit as (select * from fm join s1 using ({k}) join s2 using ({k}) join s3 using ({k}) join s4 using ({k}))"""
    ]
    return ",\n".join(ctes)


_Q1 = "(x1 - m1)"
_Q2 = f"(x2 - m2 - a21 * {_Q1})"
_Q3 = f"(x3 - m3 - a31 * {_Q1} - a32 * {_Q2})"
_Q4 = f"(x4 - m4 - a41 * {_Q1} - a42 * {_Q2} - a43 * {_Q3})"
_PRED = f"(my + b1 * {_Q1} + b2 * {_Q2} + b3 * {_Q3} + b4 * {_Q4})"
_AHEAD = "(select k, ms, cast(period as double) as x1, x2, x3, cast(step as double) as x4 from fut)"
_NOW = "(select k, ms, y, cast(period as double) as x1, x2, x3, cast(step as double) as x4 from feat)"

S["monthly_features"] = with_ledger(
    f"""select strftime(ms, '%Y-%m') as month, {r('amount', 2)} as revenue, cast(period as integer) as period, moy as month_of_year,
 {r('x2', 6)} as sin_month, {r('x3', 6)} as cos_month, step from feat""",
    _series(False),
)
S["future_frame"] = with_ledger(
    f"""select strftime(ms, '%Y-%m') as month, cast(period as integer) as period, moy as month_of_year,
 {r('x2', 6)} as sin_month, {r('x3', 6)} as cos_month, step from fut""",
    _series(False),
)


def _trend(market):
    key = "k as market, " if market else ""
    return with_ledger(
        f"""select {key}count(*) as months, {r('1 - sum(e * e) / (var_pop(y) * count(*))', 6)} as r2,
 {r('avg(abs(e))', 1)} as mae, {r('stddev_pop(e)', 1)} as residual_std
from (select k, y, y - {_PRED} as e from {_NOW} join fit using (k)) group by k""",
        f"{_series(market)},\n{_fit('feat', ['k'])}",
    )


S["trend_fit"] = _trend(False)
S["trend_fit_by_market"] = _trend(True)
S["point_forecast"] = with_ledger(
    f"select strftime(ms, '%Y-%m') as month, {r(_PRED, 0)} as forecast from {_AHEAD} join fit using (k)",
    f"{_series(False)},\n{_fit('feat', ['k'])}",
)


def _bootstrap(market):
    return f"""{_series(market)},
draws as (select size_t.k, rep, cast(('0x' || substr(md5(cast(rep as varchar) || '-' || cast(d as varchar)), 1, 8)) as bigint) % n + 1 as period
  from size_t, (select unnest(generate_series(0, 499)) as rep) reps, (select unnest(generate_series(0, 2000)) as d) ds where d < n),
boot as (select draws.rep, feat.* from draws join feat using (k, period)),
{_fit('boot', ['k', 'rep'])},
runs as (select k, ms, rep, {_PRED} as p from {_AHEAD} join fit using (k)),
fc as (select k, strftime(ms, '%Y-%m') as month, avg(p) as mean, quantile_cont(p, 0.05) as low, quantile_cont(p, 0.95) as high
  from runs group by k, ms)"""


_FC = f"month, {r('mean', 0)} as forecast_revenue, {r('low', 0)} as lower_bound, {r('high', 0)} as upper_bound"
S["bootstrap_forecast"] = with_ledger(f"select {_FC} from fc", _bootstrap(False))
S["bootstrap_forecast_by_market"] = with_ledger(f"select k as market, {_FC} from fc", _bootstrap(True))
_LINE = f"""line as (select strftime(ms, '%Y-%m') as month, {r('amount', 0)} as forecast_revenue, cast(null as double) as lower_bound,
  cast(null as double) as upper_bound, 'Actual' as type from feat
 union all select {_FC}, 'Forecast' from fc)"""
S["forecast_timeline"] = with_ledger("select * from line", f"{_bootstrap(False)},\n{_LINE}")
S["feed_revenue_forecast"] = with_ledger(
    f"select *, {r('(select avg(forecast_revenue) from line where type = ' + chr(39) + 'Actual' + chr(39) + ')', 0)} as average_line from line",
    f"{_bootstrap(False)},\n{_LINE}",
)
_A = "avg(case when type = 'Actual' then forecast_revenue end)"
_F = "avg(case when type = 'Forecast' then forecast_revenue end)"
S["forecast_profile"] = with_ledger(
    f"""select {r(_A, 0)} as avg_actual, {r(_F, 0)} as avg_forecast, {r(pct(f'{_F} - {_A}', _A), 1)} as growth_pct,
 max_by(month, case when type = 'Forecast' then forecast_revenue end) as best_month,
 min_by(month, case when type = 'Forecast' then forecast_revenue end) as weakest_month from line""",
    f"{_bootstrap(False)},\n{_LINE}",
)
