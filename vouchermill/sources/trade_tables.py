"""A day book, registers and dimensions derived from trade tables.

Orders become sales, receipts and noise vouchers; line items become purchases,
payments, expenses and notes. Each table is scanned once however many voucher
kinds are asked for, and only the asked kinds are built. Party names come from a
left join on a unique key, so a caller that reads no name can leave the join out
(``party=False``) without changing its rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouchermill.functions.calendar import fiscal_year, fiscal_year_bounds, month_name, with_calendar
from vouchermill.functions.measures import Names
from vouchermill.functions.numeric import exact, from_cents, percent_of, whole_cents
from vouchermill.schemas import AMOUNT
from vouchermill.sources.readers import read_table

ORDER_CATEGORIES = ("Sales", "Receipt", "Purchase Order", "Delivery Challan", "Contra")
LINE_CATEGORIES = ("Purchase", "Payment", "Journal", "Credit Note", "Debit Note")
ALL_CATEGORIES = ORDER_CATEGORIES + LINE_CATEGORIES
# days by which a receipt or a payment is later than its source row
RECEIPT_SHIFT, PAYMENT_SHIFT = 45, 30
LONGEST_SHIFT = max(RECEIPT_SHIFT, PAYMENT_SHIFT)


@dataclass
class Voucher:
    """Columns of one voucher kind; amounts are in cents."""

    category: str
    prefix: str
    date: Column
    party: Column
    vch_type: Column
    debit: Column
    credit: Column
    where: Column | None = None


def _choose(vouchers: list[Voucher], field: str) -> Column:
    """Value of a field by voucher kind.

    Kinds that share a Column object share a branch and the commonest is the
    default: the generated method stays small enough for the JVM to compile.
    """
    groups: dict[object, tuple[Column, list[int]]] = {}
    for i, v in enumerate(vouchers):
        value = getattr(v, field)
        key = id(value) if isinstance(value, Column) else value
        groups.setdefault(key, (value if isinstance(value, Column) else F.lit(value), []))[1].append(i)
    *others, (default, _) = sorted(groups.values(), key=lambda g: len(g[1]))
    out = None
    for value, kinds in others:
        test = F.col("_kind").isin(*kinds) if len(kinds) > 1 else F.col("_kind") == kinds[0]
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def _emit(df: DataFrame, vouchers: list[Voucher], number: Column) -> DataFrame:
    """One output row per input row and voucher that applies to it.

    Only the number of the voucher kind is exploded. Its columns are chosen by
    that number afterwards, so those a query does not read are never built.
    """
    if len(vouchers) == 1:
        rows = df if vouchers[0].where is None else df.filter(vouchers[0].where)
    else:
        kinds = [F.lit(i) if v.where is None else F.when(v.where, F.lit(i)) for i, v in enumerate(vouchers)]
        rows = df.select("*", F.explode(F.array(*kinds)).alias("_kind")).filter(F.col("_kind").isNotNull())
    return rows.select(
        _choose(vouchers, "date").alias("txn_date"),
        _choose(vouchers, "party").cast("string").alias("particulars"),
        _choose(vouchers, "vch_type").alias("vch_type"),
        F.concat(_choose(vouchers, "prefix"), number).alias("vch_no"),
        from_cents(_choose(vouchers, "debit")).alias("debit_amount"),
        from_cents(_choose(vouchers, "credit")).alias("credit_amount"),
        _choose(vouchers, "category").alias("txn_category"),
    )


def _number(*parts: Column) -> Column:
    pieces = []
    for p in parts:
        pieces += [F.lit("/"), p.cast("string")]
    return F.concat(*pieces)


ORDER_NUMBER = ("o_orderkey",)
LINE_NUMBER = ("l_orderkey", "l_linenumber")


#: ``party`` of a ledger that holds codes
CODE = "code"
_CODE_MARK = "#"


def _code(kind: str, key: Column) -> Column:
    return F.concat(F.lit(_CODE_MARK + kind), key.cast("string"))


def with_names(spark: SparkSession, folder: str, column: str = "particulars", kinds: str = "cs") -> Names:
    """Function that puts names in place of codes; texts that are no codes stay, and a code whose party has no
    row becomes NULL, as in the left join of rows with names. ``kinds`` says which dimensions occur: c and s."""
    parts = []
    if "c" in kinds:
        c = read_table(spark, folder, "customer")
        code, spelled = _code("c", F.col("c_custkey")), F.concat(F.lit("M/S "), F.upper("c_name"))
        parts.append(c.select(code.alias("_code"), F.col("c_name").alias("_name")))
        # the code of another spelling is made as that spelling is
        other = c.filter(F.col("c_custkey") % 5 == 0)
        parts.append(other.select(F.concat(F.lit("M/S "), F.upper(code)).alias("_code"), spelled.alias("_name")))
    if "s" in kinds:
        s = read_table(spark, folder, "supplier")
        parts.append(s.select(_code("s", F.col("s_suppkey")).alias("_code"), F.col("s_name").alias("_name")))
    names = parts[0]
    for p in parts[1:]:
        names = names.unionByName(p)

    def named(df: DataFrame) -> DataFrame:
        joined = df.join(names, F.col(column) == F.col("_code"), "left")
        text = F.when(~F.col(column).contains(_CODE_MARK), F.col(column))
        return joined.withColumn(column, F.coalesce("_name", text)).select(*df.columns)

    return named


def _order_vouchers(wanted: set[str]) -> list[Voucher]:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    date = F.col("o_orderdate").cast("date")
    price = whole_cents(F.col("o_totalprice"))
    zero = F.lit(0)
    name = F.col("c_name")
    # every third invoice of every fifth customer carries another spelling
    billed = F.when((cust % 5 == 0) & (key % 3 == 0), F.concat(F.lit("M/S "), F.upper(name))).otherwise(name)
    share = (
        F.when(F.col("o_orderstatus") == "F", 110).when(F.col("o_orderstatus") == "P", 95).otherwise(70)
    )
    table = {
        "Sales": Voucher(
            "Sales", "S", date, billed,
            F.when(key % 2 == 0, "GST Sales New").otherwise("GST SALES NEW 25-26"), price, zero,
        ),
        "Receipt": Voucher(
            "Receipt", "R", F.date_add(date, RECEIPT_SHIFT), name, F.lit("Receipt New"), zero, percent_of(price, share),
            cust % 25 != 0,
        ),
        "Purchase Order": Voucher(
            "Purchase Order", "PO", date, name, F.lit("Purchase Order"), price, zero,
            F.col("o_orderpriority") == "1-URGENT",
        ),
        "Delivery Challan": Voucher(
            "Delivery Challan", "DC", date, name, F.lit("Delivery Challan New"), zero, zero,
            F.col("o_orderpriority") == "5-LOW",
        ),
        "Contra": Voucher(
            "Contra", "C", date, F.lit("Bank Transfer"), F.lit("Contra"),
            F.when(key % 14 == 0, -price).otherwise(price), zero,
            (F.col("o_orderpriority") == "2-HIGH") & (key % 7 == 0),
        ),
    }
    return [table[c] for c in ORDER_CATEGORIES if c in wanted]


def _line_vouchers(wanted: set[str]) -> list[Voucher]:
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    date = F.col("l_shipdate").cast("date")
    price = whole_cents(F.col("l_extendedprice"))
    discount, tax = whole_cents(F.col("l_discount")), whole_cents(F.col("l_tax"))
    cost = percent_of(price, 100 - discount)
    levy = percent_of(price, tax)
    zero = F.lit(0)
    name = F.col("s_name")
    paid_to = (
        F.when(supp % 10 == 0, F.lit("Capital Account")).when(supp % 10 == 1, F.lit("Term Loan")).otherwise(name)
    )

    table = {
        "Purchase": Voucher(
            "Purchase", "P", date, name, F.when(line % 2 == 0, "Purchase").otherwise("Purchase New"), zero, cost
        ),
        "Payment": Voucher(
            "Payment", "Y", F.date_add(date, PAYMENT_SHIFT), paid_to, F.lit("Payment New"), percent_of(cost, 80), zero,
            F.col("l_linestatus") == "F",
        ),
        "Journal": Voucher(
            "Journal", "J", date, F.lit("Factory Overheads"), F.lit("Journal New"), levy, zero,
            line == 1,
        ),
        "Credit Note": Voucher(
            "Credit Note", "CN", date, name, F.lit("Credit Note New"), zero, percent_of(price, discount),
            (F.col("l_returnflag") == "R") & (line == 2),
        ),
        "Debit Note": Voucher(
            "Debit Note", "DN", date, name, F.lit("Debit Note New"), levy, zero,
            (F.col("l_returnflag") == "A") & (line == 3),
        ),
    }
    return [table[c] for c in LINE_CATEGORIES if c in wanted]


def ledger(
    spark: SparkSession,
    folder: str,
    categories: tuple = ALL_CATEGORIES,
    party: bool | str = True,
    derived: bool = False,
    years: tuple = (),
) -> DataFrame:
    """Day book with the asked categories; ``derived`` adds the calendar columns.

    ``party="code"`` leaves codes in place of names, so that a report can collapse
    the rows before ``with_names`` joins the dimensions.
    ``years`` names the fiscal years that the caller goes on to keep. The sources
    are then scanned for their dates only, and as far before as a voucher can be
    later than its source row.
    """
    first = after = None
    if years:
        bounds = [fiscal_year_bounds(fy) for fy in years]
        first = dt.datetime.combine(min(b[0] for b in bounds), dt.time()) - dt.timedelta(days=LONGEST_SHIFT)
        after = dt.datetime.combine(max(b[1] for b in bounds), dt.time())

    def within(rows: DataFrame, date: str) -> DataFrame:
        return rows.filter((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(after))) if years else rows

    wanted = set(categories)
    parts = []
    order_side = _order_vouchers(wanted)
    if order_side:
        rows = within(read_table(spark, folder, "orders"), "o_orderdate")
        if party == CODE:
            rows = rows.withColumn("c_name", _code("c", F.col("o_custkey")))
        elif party:
            names = read_table(spark, folder, "customer").select("c_custkey", "c_name")
            rows = rows.join(names, rows.o_custkey == names.c_custkey, "left")
        else:
            rows = rows.withColumn("c_name", F.lit(None).cast("string"))
        parts.append(_emit(rows, order_side, _number(*[F.col(c) for c in ORDER_NUMBER])))
    line_side = _line_vouchers(wanted)
    if line_side:
        rows = within(read_table(spark, folder, "lineitem"), "l_shipdate")
        if party == CODE:
            rows = rows.withColumn("s_name", _code("s", F.col("l_suppkey")))
        elif party:
            names = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")
            rows = rows.join(names, rows.l_suppkey == names.s_suppkey, "left")
        else:
            rows = rows.withColumn("s_name", F.lit(None).cast("string"))
        parts.append(_emit(rows, line_side, _number(*[F.col(c) for c in LINE_NUMBER])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_calendar(out) if derived else out


def last_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Last voucher date of each source table, for reports that need the last day of the ledger only: the
    voucher kinds are compared within the aggregate, no row is made for them."""
    sides = (("orders", _order_vouchers(set(ORDER_CATEGORIES))), ("lineitem", _line_vouchers(set(LINE_CATEGORIES))))
    parts = []
    for table, vouchers in sides:
        last = [F.max(v.date if v.where is None else F.when(v.where, v.date)) for v in vouchers]
        parts.append(read_table(spark, folder, table).agg(F.greatest(*last).alias("txn_date")))
    return parts[0].unionByName(parts[1])


def party_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Name variant and canonical name."""
    c = read_table(spark, folder, "customer").filter(F.col("c_custkey") % 5 == 0)
    return c.select(
        F.concat(F.lit("M/S "), F.upper("c_name")).alias("variant"), F.col("c_name").alias("canonical")
    )


def purchase_register(spark: SparkSession, folder: str, party: bool | str = True) -> DataFrame:
    p = ledger(spark, folder, ("Purchase",), party)
    d = F.col("txn_date")
    return p.select(
        d,
        F.col("particulars").alias("supplier_name"),
        "vch_type",
        "vch_no",
        F.col("credit_amount").alias("purchase_amount"),
        fiscal_year(d).alias("fiscal_year"),
        month_name(d).alias("month_name"),
    )


def sales_register(spark: SparkSession, folder: str, party: bool | str = True) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if party == CODE:
        rows = rows.withColumn("c_name", _code("c", F.col("o_custkey")))
    else:
        names = read_table(spark, folder, "customer").select("c_custkey", "c_name")
        rows = rows.join(names, rows.o_custkey == names.c_custkey, "left")
    date = F.col("l_shipdate").cast("date")
    quantity = F.col("l_quantity")
    net = percent_of(whole_cents(F.col("l_extendedprice")), 100 - whole_cents(F.col("l_discount")))
    tax = whole_cents(F.col("l_tax"))
    return rows.select(
        date.alias("txn_date"),
        F.col("c_name").alias("buyer_name"),
        F.lit(None).cast("string").alias("buyer_gstin"),
        F.concat(F.lit("S"), _number(F.col("l_orderkey"), F.col("l_linenumber"))).alias("voucher_no"),
        from_cents(whole_cents(quantity)).alias("quantity"),
        exact(F.coalesce(F.try_divide(F.col("l_extendedprice"), quantity), F.lit(0.0)), 2).cast(AMOUNT).alias("rate"),
        from_cents(net).alias("net_value"),
        from_cents(percent_of(net, 100 + tax)).alias("gross_total"),
        F.concat(tax.cast("string"), F.lit("%")).alias("gst_rate"),
        fiscal_year(date).alias("fiscal_year"),
    )


# Labels that put every category, and none, into the raw sheet.
RAW_LABELS = (
    "GST Sales New", "GST SALES NEW 25-26", "Purchase", "Purchase New", "Purchase Order",
    "Receipt 25-26", "Payment", "Journal New", "Contra", "Credit Note New", "Debit Note New",
    "Delivery Challan", "Stock Journal", " GST Sales New ",
)


def raw_daybook(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty six-column text sheet made from the orders: repeated headers, total
    rows, dates and amounts that do not parse, padded and missing text."""
    orders = read_table(spark, folder, "orders")
    names = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    rows = orders.join(names, orders.o_custkey == names.c_custkey, "left")
    key = F.col("o_orderkey")
    date = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice").cast(AMOUNT).cast("string")
    name = F.col("c_name")
    null = F.lit(None).cast("string")

    def text(*parts: Column) -> Column:
        return F.struct(*[p.cast("string").alias(f"_c{i}") for i, p in enumerate(parts)])

    voucher = text(
        F.when(key % 53 == 7, F.lit("n/a"))
        .when(key % 59 == 8, F.lit("31-02-1999"))
        .when(key % 2 == 0, F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.date_format(date, "dd-MM-yyyy")),
        F.when(key % 41 == 3, F.lit("Grand Total"))
        .when(key % 43 == 4, F.lit("total sales"))
        .when(key % 47 == 5, F.lit("Closing Balance"))
        .when(key % 61 == 6, F.lit(""))
        .when(key % 67 == 9, null)
        .when(key % 5 == 0, F.concat(F.lit("  "), name, F.lit("\t ")))
        .otherwise(name),
        F.element_at(F.array(*[F.lit(x) for x in RAW_LABELS]), (key % len(RAW_LABELS) + 1).cast("int")),
        F.when(key % 71 == 10, null).otherwise(F.concat(F.lit(" V/"), key.cast("string"))),
        F.when(key % 37 == 11, F.lit("abc")).when(key % 29 == 12, null).when(key % 2 == 0, price),
        F.when(key % 2 == 1, price),
    )
    header = text(*[F.lit(x) for x in ("Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit")])
    inwards = text(F.lit("Inwards Qty"), null, null, null, null, null)
    entries = F.array(voucher, F.when(key % 50 == 0, header), F.when(key % 80 == 1, inwards))
    out = rows.select(F.explode(entries).alias("v")).filter(F.col("v").isNotNull())
    return out.select(*[F.col(f"v._c{i}").alias(f"_c{i}") for i in range(6)])
