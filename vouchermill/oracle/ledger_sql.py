"""SQL text of the ledger that the trade tables stand for, one SELECT per voucher
kind. Written independently of the DataFrame form, which scans each table once."""

AMT = "decimal(18,2)"
_PRICE = f"cast(o_totalprice as {AMT})"
_LINE = f"cast(l_extendedprice as {AMT})"
_DISC = "cast(l_discount as decimal(4,2))"
_TAX = "cast(l_tax as decimal(4,2))"
_COST = f"round({_LINE} * (cast(1 as decimal(4,2)) - {_DISC}), 2)"
_O = "from orders left join customer on o_custkey = c_custkey"
_L = "from lineitem left join supplier on l_suppkey = s_suppkey"


def _row(category, date, party, vtype, vno, debit, credit, source, where=""):
    return f"""select {date} as txn_date, {party} as particulars, {vtype} as vch_type, {vno} as vch_no,
  cast({debit} as {AMT}) as debit_amount, cast({credit} as {AMT}) as credit_amount, '{category}' as txn_category
  {source} {where}"""


def _ono(p):
    return f"'{p}/' || cast(o_orderkey as varchar(20))"


def _lno(p):
    return f"'{p}/' || cast(l_orderkey as varchar(20)) || '/' || cast(l_linenumber as varchar(20))"


_OD = "cast(o_orderdate as date)"
_LD = "cast(l_shipdate as date)"

VOUCHERS = "\n union all\n".join(
    [
        _row("Sales", _OD,
             "case when c_custkey % 5 = 0 and o_orderkey % 3 = 0 then 'M/S ' || upper(c_name) else c_name end",
             "case when o_orderkey % 2 = 0 then 'GST Sales New' else 'GST SALES NEW 25-26' end",
             _ono("S"), _PRICE, "0", _O),
        _row("Receipt", f"{_OD} + 45", "c_name", "'Receipt New'", _ono("R"), "0",
             f"round({_PRICE} * cast(case o_orderstatus when 'F' then 1.10 when 'P' then 0.95 else 0.70 end as decimal(4,2)), 2)",
             _O, "where c_custkey % 25 <> 0"),
        _row("Purchase Order", _OD, "c_name", "'Purchase Order'", _ono("PO"), _PRICE, "0", _O,
             "where o_orderpriority = '1-URGENT'"),
        _row("Delivery Challan", _OD, "c_name", "'Delivery Challan New'", _ono("DC"), "0", "0", _O,
             "where o_orderpriority = '5-LOW'"),
        _row("Contra", _OD, "'Bank Transfer'", "'Contra'", _ono("C"),
             f"case when o_orderkey % 14 = 0 then -{_PRICE} else {_PRICE} end", "0", _O,
             "where o_orderpriority = '2-HIGH' and o_orderkey % 7 = 0"),
        _row("Purchase", _LD, "s_name", "case when l_linenumber % 2 = 0 then 'Purchase' else 'Purchase New' end",
             _lno("P"), "0", _COST, _L),
        _row("Payment", f"{_LD} + 30",
             "case when l_suppkey % 10 = 0 then 'Capital Account' when l_suppkey % 10 = 1 then 'Term Loan' else s_name end",
             "'Payment New'", _lno("Y"), f"round(cast({_COST} as {AMT}) * cast(0.80 as decimal(4,2)), 2)", "0", _L,
             "where l_linestatus = 'F'"),
        _row("Journal", _LD, "'Factory Overheads'", "'Journal New'", _lno("J"), f"round({_LINE} * {_TAX}, 2)", "0", _L,
             "where l_linenumber = 1"),
        _row("Credit Note", _LD, "s_name", "'Credit Note New'", _lno("CN"), "0", f"round({_LINE} * {_DISC}, 2)", _L,
             "where l_returnflag = 'R' and l_linenumber = 2"),
        _row("Debit Note", _LD, "s_name", "'Debit Note New'", _lno("DN"), f"round({_LINE} * {_TAX}, 2)", "0", _L,
             "where l_returnflag = 'A' and l_linenumber = 3"),
    ]
)


def fy(d):
    y = f"(year({d}) - case when month({d}) < 4 then 1 else 0 end)"
    return f"cast({y} as varchar) || '-' || lpad(cast(({y} + 1) % 100 as varchar), 2, '0')"


def fiscal_month(d):
    return f"cast((month({d}) + 8) % 12 + 1 as integer)"


def quarter(d):
    return f"'Q' || cast(((month({d}) + 8) % 12) // 3 + 1 as varchar)"


DERIVED = f"""{fy('txn_date')} as fiscal_year, cast(month(txn_date) as integer) as month_num,
  {fiscal_month('txn_date')} as fiscal_month_num, strftime(txn_date, '%b') as month_name,
  strftime(txn_date, '%A') as day_of_week, {quarter('txn_date')} as quarter,
  strftime(txn_date, '%Y-%m') as month"""

ALIAS = "select 'M/S ' || upper(c_name) as variant, c_name as canonical from customer where c_custkey % 5 = 0"

LEDGER = f"""vouchers as ({VOUCHERS}),
ledger as (select *, {DERIVED} from vouchers),
alias as ({ALIAS}),
canon as (select ledger.* replace (coalesce(canonical, particulars) as particulars)
  from ledger left join alias on particulars = variant)"""


def r(x, n):
    """Rounded half away from zero, as DOUBLE."""
    return f"cast(round(cast({x} as decimal(38,6)), {n}) as double)"


def lakhs(x, n=2):
    return f"cast(round(cast({x} as decimal(28,2)) * 0.00001, {n}) as double)"


def pct(a, b):
    return f"(cast({a} as double) * 100.0 / nullif(cast({b} as double), 0))"


def mean(a, b):
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def iso(d):
    return f"strftime({d}, '%Y-%m-%d')"


def with_ledger(body, ctes=""):
    head = f"with {LEDGER}" + (f",\n{ctes}" if ctes else "")
    return f"{head}\n{body}"


def cat(category, amount):
    return f"sum(case when txn_category = '{category}' then {amount} else 0 end)"
