"""SQL of the customer, payment, churn and anomaly queries."""

from vouchermill.oracle.ledger_sql import iso, lakhs, mean, pct, r, with_ledger
from vouchermill.oracle.reports_sql import CASH_MONTHS, CURRENT_RANGE, PRIOR_RANGE, _TOTALS

S = {}


def _band(x, edges, scores):
    tests = " ".join(
        f"when {x} > {a} and {x} <= {b} then {s}" for a, b, s in zip(edges, edges[1:], scores)
    )
    return f"case {tests} end"


def rfm(source="canon"):
    return f"""rfm_t as (select particulars as customer, max(txn_date) as hi, min(txn_date) as lo, count(*) as frequency,
  sum(debit_amount) as monetary from {source} where txn_category = 'Sales' and debit_amount > 0 group by 1),
rfm_d as (select *, date_diff('day', hi, (select max(hi) from rfm_t) + 1) as recency from rfm_t),
rfm_s as (select *,
  {_band('recency', (-1, 15, 45, 90, 180, 10**9), (5, 4, 3, 2, 1))} as r_score,
  {_band('frequency', (0, 3, 10, 30, 100, 10**18), (1, 2, 3, 4, 5))} as f_score,
  {_band('monetary', (0, 100000, 500000, 1000000, 5000000, 10**15), (1, 2, 3, 4, 5))} as m_score from rfm_d),
rfm_w as (select *, round(r_score * 0.30 + f_score * 0.30 + m_score * 0.40, 2) as score from rfm_s),
rfm as (select *, case when score >= 4.0 then 'Champion' when score >= 3.0 and r_score >= 3 then 'Loyal'
  when score >= 3.0 and r_score < 3 then 'At Risk' when score >= 2.0 and r_score >= 3 then 'Promising'
  when r_score <= 2 and m_score >= 3 then 'At Risk' else 'Lost' end as segment from rfm_w)"""


# Action text of each label.
RFM_ACTIONS = {
    "Champion": "Nurture — offer loyalty pricing or early access to new products",
    "Loyal": "Retain — regular check-ins, ensure satisfaction",
    "At Risk": "Re-engage — personal call from the owner within 30 days",
    "Promising": "Grow — increase order frequency with small incentives",
    "Lost": "Investigate — find out why they stopped ordering",
}
CHURN_ACTIONS = {
    "Churned": "Urgent — personal call from the owner, understand why they left",
    "High Risk": "Re-engage immediately — offer incentive or check satisfaction",
    "Medium Risk": "Follow up this week — confirm next order timeline",
    "Low Risk": "Check in — ensure no issues with last delivery",
    "Active": "Maintain — keep service quality high",
    "New Customer": "Nurture — ensure smooth onboarding, follow up on experience",
}
PAYMENT_ACTIONS = {
    "Advance Payer": "Prioritise — they pay ahead, reward with best service",
    "Excellent": "Maintain — keep relationship strong",
    "Good": "Monitor — follow up on outstanding balance",
    "Moderate Risk": "Follow up — send formal payment reminder",
    "High Risk": "Urgent — escalate to the owner for direct call",
}


def _action(col, texts):
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in texts.items()) + " end"


S["rfm_banded"] = with_ledger(
    f"""select customer, segment, cast(score as double) as rfm_score, r_score, f_score, m_score, recency, frequency,
 {r('monetary', 2)} as monetary, {lakhs('monetary')} as revenue_lakhs, {iso('lo')} as first_purchase, {iso('hi')} as last_purchase,
 {_action('segment', RFM_ACTIONS)} as recommended_action from rfm""",
    rfm(),
)
S["feed_rfm_scatter"] = with_ledger(
    f"select customer, frequency, {r('monetary', 2)} as monetary, recency, segment from rfm", rfm()
)
S["feed_at_risk_count"] = with_ledger(
    """select count(case when segment = 'At Risk' then 1 end) as at_risk_customers, count(*) as customers,
 count(case when segment = 'At Risk' then 1 end) > 0 as action_needed from rfm""",
    rfm(),
)
S["segment_summary"] = with_ledger(
    f"""select segment, count(*) as customers, {lakhs('sum(monetary)', 1)} as revenue_lakhs,
 {r(mean('sum(recency)', 'count(*)'), 0)} as avg_recency, {r(mean('sum(frequency)', 'count(*)'), 1)} as avg_frequency
from rfm group by segment""",
    rfm(),
)
S["top_customers_per_segment"] = with_ledger(
    f"""select segment, cast(position as integer) as position, customer, cast(score as double) as rfm_score,
 {lakhs('monetary')} as revenue_lakhs, {iso('hi')} as last_purchase
from (select *, row_number() over (partition by segment order by score desc, monetary desc, customer) as position from rfm)
where position <= 5""",
    rfm(),
)
S["feed_revenue_by_customer"] = with_ledger(
    f"""select customer, {r('revenue', 2)} as revenue, transactions as invoices, segment
from totals left join rfm using (customer)""",
    f"{_TOTALS.replace('from ledger', 'from canon')},\n{rfm()}",
)
S["feed_revenue_sliced_by_segment"] = with_ledger(
    f"""select month, {r('sum(debit_amount)', 0)} as total_sales from canon where txn_category = 'Sales'
 and particulars in (select customer from rfm where segment = 'At Risk') group by month""",
    rfm(),
)


def _scale(x):
    return f"coalesce((cast({x} as double) - min({x}) over ()) / nullif(cast(max({x}) over () as double) - cast(min({x}) over () as double), 0), 0)"


S["rfm_minmax"] = with_ledger(
    f"""select customer, recency, frequency, {r('monetary', 2)} as monetary, {r('rn', 6)} as recency_n, {r('fn', 6)} as frequency_n,
 {r('mn', 6)} as monetary_n, cast(s as double) as rfm_score,
 case when s > 0 and s <= 0.33 then 'At Risk' when s > 0.33 and s <= 0.66 then 'Growing'
  when s > 0.66 and s <= 1 then 'Champion' end as segment
from (select *, round(cast(rn * 0.35::double + fn * 0.25::double + mn * 0.40::double as decimal(38,6)), 6) as s from
 (select *, 1 - {_scale('recency')} as rn, {_scale('frequency')} as fn, {_scale('monetary')} as mn from rfm_d))""",
    rfm("ledger"),
)

# ---------------------------------------------------------------- payment

PAYMENT = f"""inv as (select particulars as customer, sum(debit_amount) as invoiced, count(*) as num_invoices,
  min(txn_date) as first_invoice, max(txn_date) as last_invoice from canon where txn_category = 'Sales' group by 1),
rec as (select particulars as customer, sum(credit_amount) as received, count(*) as num_receipts, max(txn_date) as last_payment
  from canon where txn_category = 'Receipt' and particulars in (select customer from inv) group by 1),
pay_t as (select inv.*, coalesce(received, 0) as received, coalesce(num_receipts, 0) as num_receipts, last_payment,
  invoiced - coalesce(received, 0) as outstanding,
  round(cast({pct('coalesce(received, 0)', 'invoiced')} as decimal(38,6)), 1) as rate from inv left join rec using (customer)),
pay as (select *, case when invoiced = 0 and received > 0 then 'Advance Payer' when invoiced = 0 then 'High Risk'
  when rate > 100 then 'Advance Payer' when received = 0 then 'High Risk' when rate >= 95 then 'Excellent'
  when rate >= 85 then 'Good' when rate >= 70 then 'Moderate Risk' else 'High Risk' end as risk_tier from pay_t)"""

S["payment_profile"] = with_ledger(
    f"""select customer, risk_tier, cast(rate as double) as collection_rate_pct, {lakhs('invoiced')} as invoiced_lakhs,
 {lakhs('received')} as received_lakhs, {lakhs('outstanding')} as outstanding_lakhs, {r('outstanding', 2)} as outstanding,
 num_invoices, num_receipts, {iso('first_invoice')} as first_invoice, {iso('last_invoice')} as last_invoice,
 coalesce({iso('last_payment')}, 'No payment') as last_payment,
 coalesce(date_diff('day', last_payment, (select max(txn_date) from ledger)), 999) as days_since_pay,
 {_action('risk_tier', PAYMENT_ACTIONS)} as recommended_action from pay""",
    PAYMENT,
)
S["feed_collection_rates"] = with_ledger(
    "select customer, risk_tier, least(cast(rate as double), 150) as shown_rate_pct from pay", PAYMENT
)
S["receipt_summary_per_customer"] = with_ledger(
    f"select customer, {r('received', 2)} as received, num_receipts, {iso('last_payment')} as last_payment from rec", PAYMENT
)
_L2 = lambda x: f"round(cast({x} as decimal(28,2)) * 0.00001, 2)"
_TIER = f"""count(*) as customers, {r(f'sum({_L2("invoiced")})', 2)} as invoiced_lakhs, {r(f'sum({_L2("outstanding")})', 2)} as outstanding_lakhs,
 {r(pct('sum(received)', 'sum(invoiced)'), 1)} as collection_rate_pct, {r('sum(outstanding)', 2)} as outstanding,
 {r('sum(case when outstanding > 0 then outstanding else 0 end)', 2)} as positive_outstanding from pay"""
S["tier_summary"] = with_ledger(
    f"select risk_tier, {_TIER} group by risk_tier union all select 'all', {_TIER}", PAYMENT
)
S["feed_cash_kpis"] = with_ledger(
    f"""select (select month from cm order by i - o desc, month limit 1) as best_month,
 {r('(select max(i - o) from cm)', 0)} as best_net_cash,
 (select month from cm order by i - o, month limit 1) as worst_month, {r('(select min(i - o) from cm)', 0)} as worst_net_cash,
 {r('(select sum(outstanding) from pay)', 0)} as total_outstanding""",
    f"{CASH_MONTHS},\n{PAYMENT}",
)

# ---------------------------------------------------------------- churn


def churn(as_of="date '2001-03-31'"):
    limit = f"and txn_date <= {as_of}" if as_of else ""
    day = as_of or "(select max(hi) from ch_t)"
    return f"""ch_t as (select particulars as customer, min(txn_date) as lo, max(txn_date) as hi, count(*) as total_orders,
  sum(debit_amount) as revenue, count(*) filter (where {PRIOR_RANGE}) as orders_prior,
  count(*) filter (where {CURRENT_RANGE}) as orders_current,
  coalesce(sum(debit_amount) filter (where {PRIOR_RANGE}), 0) as revenue_prior,
  coalesce(sum(debit_amount) filter (where {CURRENT_RANGE}), 0) as revenue_current
  from canon where txn_category = 'Sales' {limit} group by 1),
ch_d as (select *, date_diff('day', hi, {day}) as days from ch_t),
ch as (select *, case when orders_prior > 0 and orders_current = 0 then 'Churned'
  when orders_prior = 0 and orders_current > 0 then 'New Customer' when days <= 30 then 'Active' when days <= 90 then 'Low Risk'
  when days <= 180 then 'Medium Risk' else 'High Risk' end as churn_status from ch_d),
churn as (select customer, churn_status, days as days_since_last, {lakhs('revenue')} as revenue_lakhs,
  {lakhs('revenue_prior')} as revenue_prior_lakhs, {lakhs('revenue_current')} as revenue_current_lakhs,
  cast({_L2('revenue_current')} - {_L2('revenue_prior')} as double) as revenue_change_lakhs,
  case when revenue_prior > 0 then {r(pct('revenue_current - revenue_prior', 'revenue_prior'), 1)} end as revenue_change_pct,
  total_orders, orders_prior, orders_current, {iso('lo')} as first_purchase, {iso('hi')} as last_purchase,
  case when churn_status in ('Churned', 'High Risk', 'Medium Risk') then {lakhs('revenue')} else 0 end as revenue_at_risk_lakhs,
  {_action('churn_status', CHURN_ACTIONS)} as recommended_action from ch)"""


S["churn_profile"] = with_ledger("select * from churn", churn())
S["churn_status_default_date"] = with_ledger("select customer, churn_status, days_since_last from churn", churn(None))
S["revenue_at_risk"] = with_ledger(
    "select customer, churn_status, revenue_lakhs, revenue_at_risk_lakhs, recommended_action from churn", churn()
)
S["fy_split_per_customer"] = with_ledger(
    f"""select customer, orders_prior, {r('revenue_prior', 2)} as revenue_prior, orders_current,
 {r('revenue_current', 2)} as revenue_current from ch_t""",
    churn(None),
)
_ORDER = "case churn_status when 'Churned' then 1 when 'High Risk' then 2 when 'Medium Risk' then 3 when 'Low Risk' then 4 when 'Active' then 5 else 6 end"
_D = lambda c: f"cast({c} as decimal(28,2))"
S["churn_summary"] = with_ledger(
    f"""select {_ORDER} as status_order, churn_status, count(*) as customers, {r(f'sum({_D("revenue_lakhs")})', 2)} as revenue_lakhs,
 {r(f'sum({_D("revenue_at_risk_lakhs")})', 2)} as revenue_at_risk_lakhs from churn group by churn_status""",
    churn(),
)


def _status_sum(status, c):
    return f"(select coalesce(sum({_D(c)}), 0) from churn where churn_status = '{status}')"


_LOST, _NEW = _status_sum("Churned", "revenue_prior_lakhs"), _status_sum("New Customer", "revenue_current_lakhs")
S["churn_impact"] = with_ledger(
    f"""select {r(_LOST, 1)} as churned_lakhs, {r(_status_sum('High Risk', 'revenue_lakhs'), 1)} as high_risk_lakhs,
 {r(_NEW, 1)} as new_lakhs, {r(f'{_NEW} - {_LOST}', 1)} as net_impact_lakhs""",
    churn(),
)
_LIST_COLS = """customer, churn_status, revenue_lakhs, revenue_prior_lakhs, revenue_current_lakhs, revenue_change_pct,
 last_purchase, days_since_last from churn"""
S["churn_lists"] = with_ledger(
    f"""select 'churned' as list_name, -revenue_prior_lakhs as order_value, {_LIST_COLS} where churn_status = 'Churned'
 union all select 'high_risk', -revenue_lakhs, {_LIST_COLS} where churn_status = 'High Risk'
 union all select 'new', -revenue_current_lakhs, {_LIST_COLS} where churn_status = 'New Customer'
 union all select 'both_years', revenue_change_pct, {_LIST_COLS} where orders_prior > 0 and orders_current > 0""",
    churn(),
)
S["feed_year_comparison"] = with_ledger(
    """select customer, churn_status, revenue_prior_lakhs, revenue_current_lakhs from churn
where orders_prior > 0 and orders_current > 0 order by revenue_current_lakhs desc, customer limit 15""",
    churn(),
)
S["feed_recency_bands"] = with_ledger(
    """select customer, days_since_last, churn_status, case when days_since_last <= 30 then 1 when days_since_last <= 90 then 2
 when days_since_last <= 180 then 3 else 4 end as threshold_band from churn""",
    churn(),
)
S["declining_customers"] = with_ledger(
    f"""select customer, orders_prior, orders_current, {r(pct('orders_prior - orders_current', 'orders_prior'), 1)} as drop_pct,
 {iso('hi')} as last_purchase from ch_t where orders_current > 0 and orders_current < orders_prior""",
    churn(None),
)

# ---------------------------------------------------------------- anomalies


def iqr(source, entity, amount):
    q = lambda p: f"cast(quantile_cont(cast({amount} as double), {p}) as decimal(38,6))"
    return f"""q as (select {entity}, count(*) as n, {mean(f'sum({amount})', 'count(*)')} as mean, {q(0.25)} as q1, {q(0.75)} as q3
  from {source} group by {entity}),
lim as (select *, q3 - q1 as iqr, greatest(0, q1 - 1.5 * (q3 - q1)) as low, q3 + 1.5 * (q3 - q1) as high from q where n >= 5),
flagged as (select {source}.*, mean, low, high, case when {amount} > high then 'HIGH — unusually large'
  else 'LOW — unusually small' end as flag_type
  from {source} join lim using ({entity}) where {amount} < low or {amount} > high)"""


def _flag_cols(amount):
    return f"""{r(amount, 2)} as amount, {r('mean', 0)} as entity_mean, {r('low', 0)} as expected_low,
 {r('high', 0)} as expected_high, {r(f'(cast({amount} as double) - mean) / mean * 100', 1)} as deviation_pct, flag_type"""


_SALES = "sales as (select * from canon where txn_category = 'Sales' and debit_amount > 0)"
_SIQR = f"{_SALES},\n{iqr('sales', 'particulars', 'debit_amount')}"
S["iqr_baseline"] = with_ledger(
    f"""select particulars as entity, n as txn_count, {r('mean', 0)} as entity_mean, {r('q1', 0)} as q1, {r('q3', 0)} as q3,
 {r('iqr', 0)} as iqr, {r('low', 0)} as low_bound, {r('high', 0)} as high_bound from lim""",
    _SIQR,
)
S["iqr_skipped"] = with_ledger("select particulars as entity, n as txn_count from q where n < 5", _SIQR)
_BIQR = f"""bought as (select * from ledger where txn_category = 'Purchase' and credit_amount > 0),
{iqr('bought', 'particulars', 'credit_amount')}"""
S["iqr_supplier_baseline"] = with_ledger(
    f"""select particulars as entity, n as txn_count, {r('mean', 0)} as entity_mean, {r('q1', 0)} as q1, {r('q3', 0)} as q3,
 {r('iqr', 0)} as iqr, {r('low', 0)} as low_bound, {r('high', 0)} as high_bound from lim""",
    _BIQR,
)
S["iqr_skipped_suppliers"] = with_ledger("select particulars as entity, n as txn_count from q where n < 5", _BIQR)
S["iqr_anomalies"] = with_ledger(
    f"select {iso('txn_date')} as txn_date, vch_no, fiscal_year, particulars as customer, {_flag_cols('debit_amount')} from flagged",
    _SIQR,
)
_EVENTS = "ev as (select event_id, user_id, cast(value as decimal(18,2)) as val from events)"
S["iqr_event_anomalies"] = f"""with {_EVENTS}, {iqr('ev', 'user_id', 'val')}
select event_id, user_id, {_flag_cols('val')} from flagged"""
S["stream_scoring"] = S["iqr_event_anomalies"]
S["stream_growing_baselines"] = S["iqr_baseline"]
# a sale of one run beside all sales of its customer in earlier runs
S["stream_growing_flags"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, vch_no, particulars as customer, {_flag_cols('debit_amount')} from (
 select sold.*, mean, low, high,
  case when debit_amount > high then 'HIGH — unusually large' else 'LOW — unusually small' end as flag_type
 from sold join lim using (particulars, run) where debit_amount < low or debit_amount > high)""",
    f"""{_SALES},
sold as (select *, case when txn_date >= date '2000-01-01' then 2 when txn_date >= date '1998-01-01' then 1 else 0 end as run
 from sales),
seen as (select s.particulars, k.run, s.debit_amount from sold s join (select distinct run from sold) k on s.run < k.run),
q as (select particulars, run, count(*) as n, {mean('sum(debit_amount)', 'count(*)')} as mean,
  cast(quantile_cont(cast(debit_amount as double), 0.25) as decimal(38,6)) as q1,
  cast(quantile_cont(cast(debit_amount as double), 0.75) as decimal(38,6)) as q3 from seen group by 1, 2),
lim as (select *, greatest(0, q1 - 1.5 * (q3 - q1)) as low, q3 + 1.5 * (q3 - q1) as high from q where n >= 5)""",
)

_BOTH = f"""both_t as (select case txn_category when 'Sales' then 'Sale' else 'Purchase' end as txn_type, particulars as customer,
  case txn_category when 'Sales' then debit_amount else credit_amount end as val, txn_date, vch_no, fiscal_year
  from canon where (txn_category = 'Sales' and debit_amount > 0) or (txn_category = 'Purchase' and credit_amount > 0)),
{iqr('both_t', 'txn_type, customer', 'val')}"""
S["all_anomalies"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, customer, vch_no, {_flag_cols('val')}, fiscal_year, txn_type from flagged""", _BOTH
)
S["anomaly_counts"] = with_ledger(
    f"select txn_type, flag_type, count(*) as rows, {r('sum(val)', 2)} as amount from flagged group by 1, 2", _BOTH
)
S["top_anomalies"] = with_ledger(
    f"""select txn_type, cast(position as integer) as position, txn_date, customer, amount, entity_mean, deviation_pct, flag_type
from (select *, row_number() over (partition by txn_type order by deviation_pct desc, customer, vch_no, amount) as position
 from (select {iso('txn_date')} as txn_date, customer, vch_no, {_flag_cols('val')}, txn_type from flagged)) where position <= 10""",
    _BOTH,
)
_TOP = "select txn_type, customer, count(*) as rows, sum(val) as s from flagged group by 1, 2"
S["anomaly_top_parties"] = with_ledger(
    " union all ".join(
        f"""select '{name}' as ranked_by, txn_type, cast(position as integer) as position, customer, rows, {r('s', 2)} as amount
 from (select *, row_number() over (partition by txn_type order by {key} desc, customer) as position from ({_TOP}))
 where position <= {k}"""
        for name, key, k in (("amount", "s", 3), ("count", "rows", 8))
    ),
    _BOTH,
)
S["feed_anomaly_series"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, vch_no, {r('debit_amount', 2)} as amount,
 coalesce((select min(flag_type) from flagged where flagged.vch_no = sales.vch_no), 'Normal') as flag_type,
 {r(mean('sum(debit_amount) over ()', 'count(*) over ()'), 2)} as overall_mean from sales""",
    f"{_SALES},\n{iqr('sales', 'particulars', 'debit_amount')}",
)

# ---------------------------------------------------------------- settlement

FIFO = """day_t as (select particulars as customer, txn_date, sum(debit_amount) as i, sum(credit_amount) as c from canon
  where txn_category in ('Sales', 'Receipt') group by 1, 2),
cum as (select *, sum(i) over w as ci, sum(c) over w as cc from day_t window w as (partition by customer order by txn_date)),
fifo as (select a.customer, a.txn_date as invoice_date, b.txn_date as receipt_date,
  least(a.ci, b.cc) - greatest(a.ci - a.i, b.cc - b.c) as matched, date_diff('day', a.txn_date, b.txn_date) as days
  from cum a join cum b on a.customer = b.customer and a.i > 0 and b.c > 0
   and a.ci > b.cc - b.c and b.cc > a.ci - a.i)"""
S["fifo_settlement"] = with_ledger(
    f"""select customer, {iso('invoice_date')} as invoice_date, {iso('receipt_date')} as receipt_date,
 {r('matched', 2)} as matched_amount, days from fifo""",
    FIFO,
)
S["days_to_payment"] = with_ledger(
    f"""select customer, {r('sum(matched)', 2)} as settled_amount,
 {r(pct('sum(cast(matched as decimal(20,2)) * cast(days as decimal(8,0)))', 'sum(matched)') + ' / 100.0', 1)} as avg_days_to_payment,
 min(days) as min_days, max(days) as max_days from fifo group by customer""",
    FIFO,
)


# what the matched pieces up to a date leave of each day; the Spark form cuts running totals instead
def _open(as_of):
    return f"""{FIFO},
ref as (select {as_of} as as_of),
upto as (select day_t.*, as_of, date_diff('day', txn_date, as_of) as age_days from day_t, ref where txn_date <= as_of),
paid as (select customer, invoice_date as txn_date, sum(matched) as m from fifo, ref
  where invoice_date <= as_of and receipt_date <= as_of group by 1, 2),
used as (select customer, receipt_date as txn_date, sum(matched) as m from fifo, ref
  where invoice_date <= as_of and receipt_date <= as_of group by 1, 2),
items as (
 select customer, 'invoice' as kind, txn_date, i as amount, i - coalesce(m, 0) as left_over, age_days
  from upto left join paid using (customer, txn_date) where i > 0
 union all
 select customer, 'advance', txn_date, c, c - coalesce(m, 0), age_days
  from upto left join used using (customer, txn_date) where c > 0)"""


_BANDS = (("0-30", 0, 30), ("31-60", 31, 60), ("61-90", 61, 90), ("91+", 91, 999999))
S["open_items"] = with_ledger(
    f"""select customer, kind, {iso('txn_date')} as txn_date, {r('amount', 2)} as amount,
 {r('left_over', 2)} as open_amount, age_days,
 case {' '.join(f"when age_days between {a} and {b} then '{n}'" for n, a, b in _BANDS)} end as age_band
from items where left_over > 0""",
    _open("date '2001-03-31'"),
)


def _band_sum(a, b):
    return r(f"sum(case when kind = 'invoice' and age_days between {a} and {b} then left_over else 0 end)", 2)


S["ageing_report"] = with_ledger(
    f"""select customer, {r("sum(case when kind = 'invoice' then amount else 0 end)", 2)} as invoiced,
 {r("sum(case when kind = 'advance' then amount else 0 end)", 2)} as received,
 {r("sum(case when kind = 'invoice' then amount - left_over else 0 end)", 2)} as settled,
 {_band_sum(0, 999999)} as open_amount, {_band_sum(0, 30)} as open_0_to_30, {_band_sum(31, 60)} as open_31_to_60,
 {_band_sum(61, 90)} as open_61_to_90, {_band_sum(91, 999999)} as open_91_on,
 {r("sum(case when kind = 'advance' then left_over else 0 end)", 2)} as advances,
 max(case when kind = 'invoice' and left_over > 0 then age_days end) as oldest_open_days
from items group by customer""",
    _open("(select max(txn_date) from day_t)"),
)
