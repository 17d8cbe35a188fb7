"""SQL of the cleaning, join and report queries."""

from vouchermill.oracle.ledger_sql import (
    DERIVED, cat, fiscal_month, fy, iso, mean, pct, quarter, r, with_ledger,
)

FY_RANGE = "txn_date >= date '1999-04-01' and txn_date < date '2000-04-01'"
PRIOR_RANGE = FY_RANGE
CURRENT_RANGE = "txn_date >= date '2000-04-01' and txn_date < date '2001-04-01'"

# ---------------------------------------------------------------- raw sheet

# Labels that put every category, and none, into the raw sheet.
_LABELS = (
    "'GST Sales New', 'GST SALES NEW 25-26', 'Purchase', 'Purchase New', 'Purchase Order', 'Receipt 25-26', "
    "'Payment', 'Journal New', 'Contra', 'Credit Note New', 'Debit Note New', 'Delivery Challan', "
    "'Stock Journal', ' GST Sales New '"
)
_K = "o_orderkey"
RAW = f"""base as (select *, cast(o_orderdate as date) as d, cast(cast(o_totalprice as decimal(18,2)) as varchar) as price
  from orders left join customer on o_custkey = c_custkey),
raw as (
 select case when {_K} % 53 = 7 then 'n/a' when {_K} % 59 = 8 then '31-02-1999'
   when {_K} % 2 = 0 then strftime(d, '%Y-%m-%d') else strftime(d, '%d-%m-%Y') end as c0,
  case when {_K} % 41 = 3 then 'Grand Total' when {_K} % 43 = 4 then 'total sales'
   when {_K} % 47 = 5 then 'Closing Balance' when {_K} % 61 = 6 then '' when {_K} % 67 = 9 then null
   when {_K} % 5 = 0 then '  ' || c_name || chr(9) || ' ' else c_name end as c1,
  list_extract([{_LABELS}], cast({_K} % 14 + 1 as integer)) as c2,
  case when {_K} % 71 = 10 then null else ' V/' || cast({_K} as varchar) end as c3,
  case when {_K} % 37 = 11 then 'abc' when {_K} % 29 = 12 then null when {_K} % 2 = 0 then price end as c4,
  case when {_K} % 2 = 1 then price end as c5
 from base
 union all select 'Date', 'Particulars', 'Vch Type', 'Vch No.', 'Debit', 'Credit' from base where {_K} % 50 = 0
 union all select 'Inwards Qty', null, null, null, null, null from base where {_K} % 80 = 1)"""

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def exact_category(v):
    # Voucher type labels of each category.
    return f"""case when {v} in ('GST Sales New', 'GST SALES NEW 25-26') then 'Sales'
  when {v} in ('Purchase', 'Purchase New') then 'Purchase' when {v} = 'Purchase Order' then 'Purchase Order'
  when {v} in ('Receipt', 'Receipt New', 'Receipt 25-26') then 'Receipt'
  when {v} in ('Payment', 'Payment New') then 'Payment' when {v} = 'Journal New' then 'Journal'
  when {v} = 'Contra' then 'Contra' when {v} = 'Credit Note New' then 'Credit Note'
  when {v} = 'Debit Note New' then 'Debit Note'
  when {v} in ('Delivery Challan', 'Delivery Challan New') then 'Delivery Challan' else 'Other' end"""


CLEAN = f"""{RAW},
typed as (select
  coalesce(cast(try_strptime(trim(c0), '%Y-%m-%d') as date), cast(try_strptime(trim(c0), '%d-%m-%Y') as date)) as txn_date,
  trim(c1, {_BLANK}) as particulars, trim(c2, {_BLANK}) as vch_type, trim(c3, {_BLANK}) as vch_no,
  coalesce(try_cast(c4 as decimal(18,2)), 0) as debit_amount,
  coalesce(try_cast(c5 as decimal(18,2)), 0) as credit_amount
  from raw where c0 not in ('Date', 'Inwards Qty')),
clean as (select *, {DERIVED}, {exact_category('vch_type')} as txn_category from typed
  where txn_date is not null and particulars is not null
  and lower(particulars) not in ('nan', 'total', 'closing balance', 'opening balance', '')
  and not starts_with(lower(particulars), 'total') and not starts_with(lower(particulars), 'grand'))"""

_AMOUNTS = f"{r('debit_amount', 2)} as debit_amount, {r('credit_amount', 2)} as credit_amount"

S = {}

S["clean_daybook"] = f"""with {CLEAN}
select {iso('txn_date')} as txn_date, particulars, vch_type, vch_no, {_AMOUNTS}, txn_category, fiscal_year,
 'book-a' as source_year, month_num, fiscal_month_num, month_name, day_of_week, quarter from clean"""

_FLAGGED = f"""{RAW},
dated as (select *, lower(trim(c1, {_BLANK})) as p,
  coalesce(try_strptime(trim(c0), '%Y-%m-%d'), try_strptime(trim(c0), '%d-%m-%Y')) as parsed from raw),
flagged as (select *, case when c0 in ('Date', 'Inwards Qty') then 'repeated header'
  when parsed is null then 'bad date' when coalesce(p, '') = '' then 'no party'
  when p in ('nan', 'total', 'closing balance', 'opening balance') or p like 'total%' or p like 'grand%'
  then 'summary row' end as reason from dated)"""
S["rejected_rows"] = f"""with {_FLAGGED}
select reason, c0 as txn_date, c1 as particulars, c2 as vch_type, c3 as vch_no, c4 as debit_amount,
 c5 as credit_amount from flagged where reason is not null"""
# rows left are counted by undoing the steps one at a time
S["cleaning_steps"] = f"""with {_FLAGGED},
gone(step, name) as (values (0, 'raw'), (1, 'repeated header'), (2, 'bad date'), (3, 'no party'), (4, 'summary row'))
select cast(step as integer) as step, name, (select count(*) from flagged where reason = name) as dropped,
 (select count(*) from flagged where reason is null
  or reason in (select later.name from gone as later where later.step > gone.step)) as rows from gone
union all select 5, 'no debit', 0, count(*) from flagged
 where reason is null and trim(c4) <> '' and try_cast(c4 as decimal(18,2)) is null
union all select 6, 'no credit', 0, count(*) from flagged
 where reason is null and trim(c5) <> '' and try_cast(c5 as decimal(18,2)) is null"""

S["stream_ingest"] = f"""with {CLEAN}
select {iso('txn_date')} as txn_date, particulars, vch_type, vch_no, {_AMOUNTS}, txn_category, fiscal_year from clean"""

S["stream_ingest_lines"] = f"""with {CLEAN}
select {iso('txn_date')} as txn_date, particulars, vch_type, 'V/' || (cast(substr(vch_no, 3) as bigint) // 3) as vch_no, {_AMOUNTS}, txn_category,
 fiscal_year from clean"""

S["categorise_exact"] = f"""with {RAW}
select c2 as vch_type, {exact_category('trim(c2)')} as txn_category, count(*) as rows from raw group by c2"""

S["categorise_pattern"] = f"""with {RAW}
select c2 as vch_type, case when c2 ilike '%Sales%' then 'Sales' when c2 ilike '%Purchase%' then 'Purchase'
 when c2 ilike '%Payment%' then 'Payment' when c2 ilike '%Receipt%' then 'Receipt'
 when c2 ilike '%Journal%' then 'Journal' when c2 ilike '%Contra%' then 'Contra'
 when c2 ilike '%Debit Note%' then 'Debit Note' when c2 ilike '%Credit Note%' then 'Credit Note'
 else 'Other' end as txn_category, count(*) as rows from raw group by c2"""

S["drop_zero_rows"] = with_ledger(
    "select txn_category, count(*) as rows from ledger where not (debit_amount = 0 and credit_amount = 0) group by 1"
)
S["keep_positive_rows"] = with_ledger(
    "select txn_category, count(*) as rows from ledger where debit_amount > 0 or credit_amount > 0 group by 1"
)


def invoice_summary(source):
    return with_ledger(
        f"""select particulars as customer, {iso('min(txn_date)')} as first_invoice, {iso('max(txn_date)')} as last_invoice,
 count(*) as invoices, {r('sum(debit_amount)', 2)} as invoiced, {r(mean('sum(debit_amount)', 'count(*)'), 2)} as avg_invoice
from {source} where txn_category = 'Sales' group by particulars"""
    )


S["canonical_party"] = invoice_summary("canon")
S["invoice_summary_per_customer"] = invoice_summary("canon")

_SOURCES = """numbered as (select ledger.* replace (case when n % 11 <> 0 then vch_no end as vch_no), n from
  (select *, cast(regexp_extract(vch_no, '(\\d+)$', 1) as bigint) as n from ledger
   where txn_category in ('Sales', 'Receipt')) ledger),
a as (select *, 'book-a' as source_year from numbered where txn_date < date '2000-07-01'),
b as (select *, 'book-b' as source_year from numbered where txn_date >= date '1999-10-01' and n % 3 <> 0)"""
_SEEN = "select 1 from b where b.txn_date >= date '2000-01-01' and b.vch_no = a.vch_no"

S["resolve_overlap"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, particulars, vch_no, {_AMOUNTS}, source_year from (
 select * from a where txn_date < date '2000-01-01' or not exists ({_SEEN})
 union all select * from b where txn_date >= date '2000-01-01')""",
    _SOURCES,
)
S["overlap_report"] = with_ledger(
    f"""select a_overlap_rows, b_overlap_rows, removed_rows, a_overlap_rows - removed_rows as kept_rows from (select
 (select count(*) from a where txn_date >= date '2000-01-01') as a_overlap_rows,
 (select count(*) from b where txn_date >= date '2000-01-01') as b_overlap_rows,
 (select count(*) from a where txn_date >= date '2000-01-01' and exists ({_SEEN})) as removed_rows)""",
    _SOURCES,
)
S["duplicate_vouchers"] = with_ledger(
    "select vch_no, count(*) as count from ledger group by vch_no having count(*) > 1"
)
S["party_keyword_payments"] = with_ledger(
    f"""select case when particulars ilike '%capital%' then 'capital' when particulars ilike '%loan%' then 'loan' else 'none' end
 as keyword, txn_category, count(*) as rows, {r('sum(debit_amount)', 2)} as amount
from ledger where txn_category in ('Payment', 'Purchase Order') group by 1, 2"""
)
S["distinct_categories"] = with_ledger("select distinct txn_category from ledger")
_CALENDAR = f"""bounds as (select make_date(cast(substr({fy('min(txn_date)')}, 1, 4) as integer), 4, 1) as lo,
  make_date(cast(substr({fy('max(txn_date)')}, 1, 4) as integer) + 1, 3, 31) as hi from ledger),
days as (select cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as date) as d from bounds)"""
S["calendar"] = with_ledger(
    f"""select {iso('d')} as date, cast(year(d) as integer) as year, cast(month(d) as integer) as month_num,
 strftime(d, '%b') as month_name, {quarter('d')} as quarter, {fy('d')} as fy, {fiscal_month('d')} as month_sort,
 cast(weekofyear(d) as integer) as week_no from days""",
    _CALENDAR,
)
S["fiscal_columns"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, count(*) as rows, fiscal_year, month_num, fiscal_month_num, month_name,
 day_of_week, quarter, month from ledger group by all"""
)
S["star_join"] = with_ledger(
    f"""select {fy('d')} as cal_fy, {quarter('d')} as cal_quarter, c_mktsegment as market, n_name as nation,
 count(*) as invoices, {r('sum(debit_amount)', 2)} as sales
from canon left join days on txn_date = d left join customer on particulars = c_name
 left join nation on c_nationkey = n_nationkey
where txn_category = 'Sales' group by 1, 2, 3, 4""",
    _CALENDAR,
)
S["star_join_suppliers"] = with_ledger(
    f"""select {fy('d')} as cal_fy, {quarter('d')} as cal_quarter, n_name as nation, count(*) as bills,
 {r('sum(credit_amount)', 2)} as purchase
from ledger left join days on txn_date = d left join supplier on particulars = s_name
 left join nation on s_nationkey = n_nationkey
where txn_category = 'Purchase' group by 1, 2, 3""",
    _CALENDAR,
)
S["customer_receipts"] = with_ledger(
    f"""select particulars as customer, count(*) as receipts, {r('sum(credit_amount)', 2)} as received
from canon where txn_category = 'Receipt'
 and particulars in (select particulars from canon where txn_category = 'Sales') group by 1"""
)
S["entity_baseline_rows"] = with_ledger(
    f"""select vch_no, particulars, {r('debit_amount', 2)} as amount, count(*) over (partition by particulars) as entity_rows,
 {r(mean('sum(debit_amount) over (partition by particulars)', 'count(*) over (partition by particulars)'), 2)} as entity_mean
from canon where txn_category = 'Sales'"""
)
S["sales_growth_yoy"] = with_ledger(
    f"""select c.month, {r('c.s', 2)} as sales, {r('l.s', 2)} as sales_last_year,
 {r('coalesce(' + pct('c.s - l.s', 'l.s') + ', 0)', 1)} as growth_pct
from m c left join m l on cast(l.ms + interval 12 month as date) = c.ms""",
    """m as (select date_trunc('month', txn_date) as ms, month, sum(debit_amount) as s from ledger
 where txn_category = 'Sales' group by 1, 2)""",
)

# ---------------------------------------------------------------- reports

S["monthly_sales_trend"] = with_ledger(
    f"select month, {r('sum(debit_amount)', 0)} as total_sales from ledger where txn_category = 'Sales' group by month"
)
S["monthly_revenue_fy"] = with_ledger(
    f"""select month, month_name, {r('sum(debit_amount)', 2)} as total_sales, count(*) as num_invoices,
 {r(mean('sum(debit_amount)', 'count(*)'), 2)} as avg_invoice_value
from ledger where txn_category = 'Sales' and fiscal_year = '1999-00' group by month, month_name"""
)
_TOTALS = """totals as (select particulars as customer, sum(debit_amount) as revenue, count(*) as transactions from ledger
 where txn_category = 'Sales' group by particulars)"""
S["pareto_top"] = with_ledger(
    f"""select customer, cast(revenue as double) as revenue, {r(pct('revenue', 'sum(revenue) over ()'), 1)} as pct,
 {r(pct('sum(revenue) over (order by revenue desc)', 'sum(revenue) over ()'), 1)} as cumulative_pct
from (select customer, round(revenue, 0) as revenue from totals) order by revenue desc, customer limit 10""",
    _TOTALS,
)
S["pareto_ranked"] = with_ledger(
    f"""select cast(row_number() over (order by revenue desc, customer) as integer) as rank, customer,
 {r('revenue', 0)} as revenue_inr, {r(pct('revenue', '(select sum(revenue) from totals)'), 2)} as revenue_pct,
 {r(pct('sum(revenue) over (order by revenue desc)', '(select sum(revenue) from totals)'), 1)} as cumulative_pct
from totals order by rank limit 15""",
    _TOTALS,
)
S["cumulative_sales"] = with_ledger(
    f"""select customer, rank() over (order by revenue desc) as rank, {r('revenue', 2)} as revenue,
 {r('sum(revenue) over (order by revenue desc)', 2)} as cumulative_sales from totals""",
    _TOTALS,
)
S["feed_pareto_line"] = with_ledger(
    f"""select *, cumulative_pct <= 80 as within_line from (
 select customer, rank() over (order by revenue desc) as rank, {r('revenue', 2)} as revenue,
 {r(pct('sum(revenue) over (order by revenue desc)', 'sum(revenue) over ()'), 4)} as cumulative_pct from totals)""",
    _TOTALS,
)
_SUPPLIER = f"""select particulars as supplier_name, {r('sum(credit_amount)', 0)} as total_spend, count(*) as num_bills,
 {r(mean('sum(credit_amount)', 'count(*)'), 0)} as avg_bill_value, {iso('min(txn_date)')} as first_purchase,
 {iso('max(txn_date)')} as last_purchase from ledger where txn_category = 'Purchase' group by particulars"""
S["supplier_spend"] = with_ledger(f"select * from ({_SUPPLIER}) order by total_spend desc, supplier_name limit 15")
S["feed_supplier_buckets"] = with_ledger(
    f"""select *, case when total_spend >= 20000000 then 3 when total_spend >= 10000000 then 2
 when total_spend >= 1000000 then 1 else 0 end as spend_bucket from ({_SUPPLIER})"""
)
MARGIN_MONTHS = """ms as (select month, sum(debit_amount) as sales from ledger where txn_category = 'Sales' group by month),
mp as (select month, sum(credit_amount) as purchase from ledger where txn_category = 'Purchase' group by month),
mm as (select month, sales, purchase from ms join mp using (month))"""
S["monthly_gross_margin"] = with_ledger(
    f"""select month, {r('sales', 0)} as sales_inr, {r('purchase', 0)} as purchase_inr, {r('sales - purchase', 0)} as gross_margin,
 {r(pct('sales - purchase', 'sales'), 1)} as margin_pct from mm""",
    MARGIN_MONTHS,
)
S["feed_sales_vs_purchase"] = with_ledger(
    f"""select month, {r('sales', 0)} as sales, {r('purchase', 0)} as purchase, {r(mean('purchase', 'sales'), 4)} as purchase_to_sales,
 cast(purchase as double) / cast(sales as double) < 0.65 as within_target from mm""",
    MARGIN_MONTHS,
)


def _cash(amount, where=""):
    i, o = cat("Receipt", amount), cat("Payment", "debit_amount")
    return with_ledger(
        f"select month, {r(i, 0)} as cash_in, {r(o, 0)} as cash_out, {r(i + ' - ' + o, 0)} as net_cash_flow from ledger {where} group by month"
    )


_CASH_ROWS = "where txn_category in ('Payment', 'Receipt')"
S["cash_flow_receipt_debit"] = _cash("debit_amount")
S["cash_flow_receipt_credit"] = _cash("credit_amount")
S["cash_flow_filtered"] = _cash("credit_amount", _CASH_ROWS)
CASH_MONTHS = f"""cm as (select month, {cat('Receipt', 'credit_amount')} as i, {cat('Payment', 'debit_amount')} as o
 from ledger {_CASH_ROWS} group by month)"""
S["cumulative_cash"] = with_ledger(
    f"""select month, {r('i - o', 0)} as net_cash, case when i - o >= 0 then 'inflow' else 'outflow' end as sign,
 {r('sum(i) over (order by month)', 0)} as cumulative_in, {r('sum(o) over (order by month)', 0)} as cumulative_out from cm""",
    CASH_MONTHS,
)
S["volume_by_weekday"] = with_ledger(
    f"""select case dayofweek(txn_date) when 0 then 'Sunday' when 1 then 'Monday' when 2 then 'Tuesday' when 3 then 'Wednesday'
 when 4 then 'Thursday' when 5 then 'Friday' else 'Saturday' end as day_of_week, count(*) as total_txns,
 {r('sum(debit_amount)', 0)} as total_debit, {r(mean('sum(debit_amount)', 'count(*)'), 0)} as avg_debit
from ledger where txn_category = 'Sales' group by 1"""
)
_SALE, _BUY = cat("Sales", "debit_amount"), cat("Purchase", "credit_amount")
S["tax_liability"] = with_ledger(
    f"""select fiscal_year, {r(_SALE, 0)} as output_taxable, {r(_BUY, 0)} as input_taxable,
 {r(f'cast({_SALE} - {_BUY} as decimal(28,2)) * 0.05', 0)} as net_liability from ledger group by fiscal_year"""
)
S["quarterly_performance"] = with_ledger(
    f"""select fiscal_year, quarter, {r(_SALE, 0)} as sales, {r(_BUY, 0)} as purchases,
 count(case when txn_category = 'Sales' then 1 end) as sales_invoices from ledger group by 1, 2"""
)
S["feed_margin_gauge"] = with_ledger(
    f"""select fiscal_year, {r('p', 2)} as margin_pct, cast(30 as double) as target_pct, {r('p', 2)} >= 30 as target_met,
 {r('greatest(least(p / 60, 1), 0)', 4)} as needle
from (select fiscal_year, coalesce({pct(_SALE + ' - ' + _BUY, _SALE)}, 0) as p from ledger
 where txn_category in ('Sales', 'Purchase') group by 1)"""
)
_REG = f"""reg as (select c_name as buyer_name, cast(l_quantity as decimal(18,2)) as quantity,
  round(cast(coalesce(l_extendedprice / nullif(l_quantity, 0), 0) as decimal(38,6)), 2) as rate,
  round(round(cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))), 2)
   * (cast(1 as decimal(4,2)) + cast(l_tax as decimal(4,2))), 2) as gross_total
 from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey)"""
S["top_buyers"] = f"""with {_REG}
select buyer_name, {r(mean('sum(rate)', 'count(*)'), 2)} as avg_rate, {r('sum(quantity)', 0)} as total_qty,
 {r('sum(gross_total)', 0)} as total_revenue, count(*) as num_orders
from reg where rate > 0 group by buyer_name order by total_revenue desc, buyer_name limit 10"""


def _zscore(source, amount, columns, cut, high):
    return f"""select {columns}, {r(amount, 0)} as amount, {r('z', 2)} as z_score,
 case when z > {high} then 'Outlier' else 'High' end as flag
from (select *, (cast({amount} as double) - m) / sqrt(v) as z from {source},
 (select avg(cast({amount} as double)) as m, var_pop(cast({amount} as double)) as v from {source} where {amount} > 0))
where z > {cut} order by z_score desc, {source}.{amount} desc, {columns} limit 15"""


S["zscore_outliers"] = f"""with ev as (select event_id, user_id, cast(value as decimal(18,2)) as val from events)
{_zscore('ev', 'val', 'event_id, user_id', 2, 3)}""".replace("ev.val desc", "val desc")
S["zscore_sales"] = with_ledger(
    _zscore("sales", "debit_amount", "vch_no, particulars", 1.5, 1.7).replace("sales.debit_amount desc", "debit_amount desc"),
    "sales as (select * from ledger where txn_category = 'Sales')",
)


def _keyword(word, any_category):
    extra = "" if any_category else " and txn_category = 'Payment'"
    return f"sum(case when particulars ilike '%{word}%'{extra} then debit_amount else 0 end)"


def _measures(any_category, keys="fiscal_year", where=""):
    return f"""base as (select {keys}, {cat('Sales', 'debit_amount')} as gross_sales, {cat('Debit Note', 'debit_amount')} as debit_notes,
  {cat('Credit Note', 'credit_amount')} as credit_notes, {cat('Purchase', 'credit_amount')} as purchase,
  {cat('Journal', 'debit_amount')} as operating_expenses, {cat('Receipt', 'credit_amount')} as receipts,
  {cat('Payment', 'debit_amount')} as payments, {_keyword('capital', any_category)} as owner_drawings,
  {_keyword('loan', any_category)} as loan_payments,
  count(case when txn_category = 'Sales' then vch_no end) as sales_vouchers,
  count(distinct case when txn_category = 'Sales' then particulars end) as active_customers,
  count(distinct particulars) as parties from ledger {where} group by {keys}),
net as (select *, gross_sales + debit_notes - credit_notes as net_sales, payments + operating_expenses as cash_out from base),
full_m as (select *, net_sales - purchase as gross_margin, net_sales - purchase - operating_expenses as net_profit,
  receipts - cash_out as net_cash from net)"""


def crores(x):
    return r(f"cast({x} as double) / 10000000.0", 2)


_SUMMARY = (
    "gross_sales", "debit_notes", "credit_notes", "net_sales", "purchase", "gross_margin", "operating_expenses",
    "net_profit", "receipts", "cash_out", "net_cash", "owner_drawings", "loan_payments",
)
S["financial_summary"] = with_ledger(
    f"""select fiscal_year, {', '.join(f'{crores(c)} as {c}' for c in _SUMMARY)},
 {r('coalesce(' + pct('gross_margin', 'net_sales') + ', 0)', 1)} as gross_margin_pct,
 {r('coalesce(' + pct('net_profit', 'net_sales') + ', 0)', 1)} as net_profit_pct from full_m""",
    _measures(False),
)
_YOY = {
    "Net Sales": "net_sales", "Purchase": "purchase", "Gross Margin": "gross_margin", "Net Profit": "net_profit",
    "Cash In": "receipts", "Net Cash Flow": "net_cash",
}
S["yoy_comparison"] = with_ledger(
    " union all ".join(
        f"""select '{label}' as metric, {crores('a.' + c)} as first_year, {crores('b.' + c)} as second_year,
 {r('coalesce(' + pct(f'b.{c} - a.{c}', f'abs(a.{c})') + ', 0)', 1)} as growth_pct
 from full_m a, full_m b where a.fiscal_year = '1999-00' and b.fiscal_year = '2000-01'"""
        for label, c in _YOY.items()
    ),
    _measures(False),
)
S["category_counts"] = with_ledger("select fiscal_year, txn_category, count(*) as rows from ledger group by 1, 2")
S["ledger_profile"] = with_ledger(
    " union all ".join(
        f"""select {k} as fiscal_year, count(*) as rows, {iso('min(txn_date)')} as first_date, {iso('max(txn_date)')} as last_date,
 count(distinct particulars) as parties from ledger {g}"""
        for k, g in (("fiscal_year", "group by fiscal_year"), ("'all'", ""))
    )
)
_MEASURES = (
    "gross_sales", "debit_notes", "credit_notes", "net_sales", "purchase", "gross_margin", "blueprint_margin",
    "operating_expenses", "net_profit", "receipts", "payments", "cash_out", "net_cash", "net_cash_payments_only",
    "owner_drawings", "loan_payments",
)
S["measures_by_fy"] = with_ledger(
    f"""select fiscal_year, {', '.join(f'{r(c, 2)} as {c}' for c in _MEASURES)},
 {r('coalesce(' + pct('gross_margin', 'net_sales') + ', 0)', 1)} as gross_margin_pct,
 {r('coalesce(' + mean('blueprint_margin', 'gross_sales') + ', 0)', 4)} as blueprint_margin_ratio,
 {r('coalesce(' + pct('net_profit', 'net_sales') + ', 0)', 1)} as net_profit_pct,
 {r('coalesce(' + mean('gross_sales', 'sales_vouchers') + ', 0)', 2)} as avg_invoice_value,
 sales_vouchers, active_customers, parties, {r('coalesce(' + mean('top', 'gross_sales') + ', 0)', 6)} as top1_concentration
from (select *, gross_sales - purchase as blueprint_margin, receipts - payments as net_cash_payments_only from full_m)
 join (select fiscal_year, max(s) as top from (select fiscal_year, particulars, {_SALE} as s from ledger group by 1, 2)
  group by 1) using (fiscal_year)""",
    _measures(True),
)
_SLICES = (("fiscal_year", "quarter"), ("fiscal_year", "'all'"), ("'all'", "quarter"), ("'all'", "'all'"))
_SLICED = "gross_sales purchase receipts payments net_sales gross_margin net_profit net_cash".split()
# one grouping per slice, with a distinct count of its own
S["measures_by_slicers"] = with_ledger(
    f"""select fiscal_year, quarter, {', '.join(f'{r(c, 2)} as {c}' for c in _SLICED)},
 {r('coalesce(' + pct('gross_margin', 'net_sales') + ', 0)', 1)} as gross_margin_pct,
 {r('coalesce(' + mean('gross_sales', 'sales_vouchers') + ', 0)', 2)} as avg_invoice_value,
 sales_vouchers, active_customers, parties from full_m""",
    "sliced as ("
    + " union all ".join(f"select ledger.* replace ({y} as fiscal_year, {q} as quarter) from ledger" for y, q in _SLICES)
    + "),\n"
    + _measures(False, keys="fiscal_year, quarter").replace("from ledger", "from sliced"),
)
S["customers_by_slicers"] = with_ledger(
    " union all ".join(
        f"""select customer, fiscal_year, quarter, {r('sold', 2)} as gross_sales, {r('got', 2)} as receipts, sales_vouchers,
 {r('coalesce(' + mean('sold', 'sales_vouchers') + ', 0)', 2)} as avg_invoice_value
from (select particulars as customer, {y} as fiscal_year, {q} as quarter, {cat('Sales', 'debit_amount')} as sold,
 {cat('Receipt', 'credit_amount')} as got, count(case when txn_category = 'Sales' then vch_no end) as sales_vouchers
 from canon where txn_category in ('Sales', 'Receipt') and particulars is not null group by 1, 2, 3)"""
        for y, q in _SLICES
    )
)


def _cards(where):
    return with_ledger(
        f"""select {r('gross_sales', 2)} as total_revenue, {r('coalesce(' + mean('gross_sales - purchase', 'gross_sales') + ', 0)', 4)}
 as gross_margin_ratio, {r('receipts - payments', 2)} as net_cash_flow, active_customers from base""",
        _measures(False, keys="all_rows", where=where).replace("from ledger", "from (select *, 1 as all_rows from ledger)"),
    )


S["feed_kpi_cards"] = _cards("")
S["feed_kpi_cards_sliced"] = _cards(f"where {FY_RANGE} and quarter = 'Q2'")
_MONTHS = "Apr May Jun Jul Aug Sep Oct Nov Dec Jan Feb Mar".split()
S["feed_customer_month_matrix"] = with_ledger(
    "select particulars as customer, "
    + ", ".join(
        f"coalesce({r(f'sum(case when month_name = {chr(39)}{m}{chr(39)} then debit_amount end)', 0)}, 0) as {chr(34)}{m.lower()}{chr(34)}"
        for m in _MONTHS
    )
    + f" from ledger where txn_category = 'Sales' and {FY_RANGE} group by particulars"
)
S["feed_sales_by_quarter"] = with_ledger(
    "select fiscal_year, "
    + ", ".join(
        f"coalesce({r(f'sum(case when quarter = {chr(39)}{q}{chr(39)} then debit_amount end)', 0)}, 0) as {q.lower()}"
        for q in ("Q1", "Q2", "Q3", "Q4")
    )
    + " from ledger where txn_category = 'Sales' group by fiscal_year"
)
S["feed_top_payers"] = with_ledger(
    f"""select month, cast(position as integer) as position, customer, {r('s', 2)} as received from (
 select *, row_number() over (partition by month order by s desc, customer) as position from (
  select month, particulars as customer, sum(credit_amount) as s from ledger where txn_category = 'Receipt' group by 1, 2))
where position <= 5"""
)
S["order_frequency"] = with_ledger(
    f"""select particulars as customer, count(*) as orders, count(distinct month) as active_months,
 {r(mean('count(*)', 'count(distinct month)'), 2)} as orders_per_active_month,
 {r(mean('sum(debit_amount)', 'count(*)'), 2)} as avg_order_value
from canon where txn_category = 'Sales' group by particulars"""
)
S["revenue_by_product_type"] = f"""select p_type as product_type, {r('sum(round(cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(4,2)) - cast(l_discount as decimal(4,2))), 2))', 2)} as revenue,
 count(*) as line_count from lineitem join part on l_partkey = p_partkey group by p_type"""
S["stream_monthly_totals"] = f"""select strftime(ts, '%Y-%m') as month, event_type as category, count(*) as rows,
 {r('sum(cast(value as decimal(18,2)))', 2)} as amount from events group by 1, 2"""
S["stream_daily_totals"] = f"""select strftime(ts, '%Y-%m-%d') as day, event_type as category, count(*) as rows,
 {r('sum(cast(value as decimal(18,2)))', 2)} as amount from events group by 1, 2"""

_STORED_AMOUNTS = f"{r('sum(debit_amount)', 2)} as debit, {r('sum(credit_amount)', 2)} as credit"
S["stored_week_53"] = with_ledger(
    f"""select {iso('txn_date')} as txn_date, fiscal_year, txn_category, count(*) as rows, {_STORED_AMOUNTS}
from ledger where weekofyear(txn_date) = 53 group by txn_date, fiscal_year, txn_category"""
)
S["stored_year_replaced"] = with_ledger(
    f"""select fiscal_year, txn_category, count(*) as rows, {_STORED_AMOUNTS} from (
 select * replace (case when fiscal_year = '1999-00' and txn_category = 'Sales' then debit_amount + 1
  else debit_amount end as debit_amount) from ledger where not (fiscal_year = '1999-00' and txn_category = 'Contra'))
group by fiscal_year, txn_category"""
)
S["stored_duplicate_vouchers"] = with_ledger(
    "select vch_no, count(*) as count from (select vch_no from a union all select vch_no from b)"
    " where vch_no is not null group by vch_no having count(*) > 1",
    _SOURCES,
)
