"""First-in-first-out settlement of invoices by receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vouchermill.functions.calendar import iso
from vouchermill.functions.categories import is_category
from vouchermill.functions.measures import sum_where
from vouchermill.functions.numeric import half_up, percent
from vouchermill.operators.joins import attach_row

_TOTAL = "decimal(38,2)"


def _daily(ledger: DataFrame, party: str) -> DataFrame:
    rows = ledger.filter(
        (is_category("Sales") & (F.col("debit_amount") > 0)) | (is_category("Receipt") & (F.col("credit_amount") > 0))
    )
    return (
        rows.filter(F.col(party).isNotNull())
        .groupBy(F.col(party).alias("customer"), "txn_date")
        .agg(
            sum_where(is_category("Sales"), "debit_amount").alias("invoiced"),
            sum_where(is_category("Receipt"), "credit_amount").alias("received"),
        )
    )


def fifo_settlement(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    """Amount of each invoice day that each receipt day settles.

    Amounts of one party and day settle as one, so a party has at most as many
    rows as the calendar has days, however many vouchers it holds. Each side's
    running total cuts the amount axis into intervals; ordered together, the
    piece before every cut lies in exactly one invoice interval and one receipt
    interval, which the next cut of either side names. That replaces an interval
    join, which would compare all days of a party with each other.
    """
    upto = Window.partitionBy("customer").orderBy("txn_date").rowsBetween(Window.unboundedPreceding, 0)
    running = _daily(ledger, party).select(
        "customer",
        "txn_date",
        "invoiced",
        "received",
        F.sum("invoiced").over(upto).cast(_TOTAL).alias("cum_invoiced"),
        F.sum("received").over(upto).cast(_TOTAL).alias("cum_received"),
    )

    nothing = F.lit(None).cast("date")
    cut_type = f"struct<cut:{_TOTAL},invoice_date:date,receipt_date:date>"

    def cut(end, invoice_date, receipt_date):
        return F.struct(
            end.alias("cut"), invoice_date.alias("invoice_date"), receipt_date.alias("receipt_date")
        ).cast(cut_type)

    entries = F.array(
        F.when(F.col("invoiced") > 0, cut(F.col("cum_invoiced"), F.col("txn_date"), nothing)),
        F.when(F.col("received") > 0, cut(F.col("cum_received"), nothing, F.col("txn_date"))),
    )
    cuts = running.select("customer", F.explode(entries).alias("e")).filter(F.col("e").isNotNull())
    points = cuts.groupBy("customer", F.col("e.cut").alias("cut")).agg(
        F.max("e.invoice_date").alias("invoice_date"), F.max("e.receipt_date").alias("receipt_date")
    )
    # descending, so that "the next cut of a side" is the last one seen
    down = Window.partitionBy("customer").orderBy(F.col("cut").desc())
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(
        "customer",
        F.last("invoice_date", ignorenulls=True).over(seen).alias("invoice_date"),
        F.last("receipt_date", ignorenulls=True).over(seen).alias("receipt_date"),
        (F.col("cut") - F.coalesce(F.lead("cut").over(down), F.lit(0).cast(_TOTAL))).cast(_TOTAL).alias("matched"),
    )
    settled = pieces.filter(F.col("invoice_date").isNotNull() & F.col("receipt_date").isNotNull())
    return settled.withColumn("days", F.datediff("receipt_date", "invoice_date").cast("bigint"))


def settlement_table(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    s = fifo_settlement(ledger, party)
    return s.select(
        "customer",
        iso(F.col("invoice_date")).alias("invoice_date"),
        iso(F.col("receipt_date")).alias("receipt_date"),
        half_up(F.col("matched"), 2).alias("matched_amount"),
        "days",
    )


def days_to_payment(ledger: DataFrame, party: str = "particulars") -> DataFrame:
    """Average days from invoice to payment, weighted by the settled amount."""
    s = fifo_settlement(ledger, party)
    totals = s.groupBy("customer").agg(
        F.sum("matched").cast(_TOTAL).alias("m"),
        F.sum(F.col("matched").cast("decimal(28,2)") * F.col("days").cast("decimal(8,0)")).alias("w"),
        F.min("days").alias("min_days"),
        F.max("days").alias("max_days"),
    )
    mean = percent(F.col("w"), F.col("m")) / 100.0
    return totals.select(
        "customer",
        half_up(F.col("m"), 2).alias("settled_amount"),
        half_up(mean, 1).alias("avg_days_to_payment"),
        "min_days",
        "max_days",
    )


#: last day of age of each ageing band but the open last one
AGEING_EDGES = (30, 60, 90)


def _band_names(edges: tuple) -> list[str]:
    lows = [0, *[e + 1 for e in edges]]
    return [f"{a}-{b}" for a, b in zip(lows, edges)] + [f"{lows[-1]}+"]


def _age_band(days, edges: tuple):
    names = _band_names(edges)
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(days <= edge, F.lit(name)).otherwise(out)
    return out


def _sides(ledger: DataFrame, as_of: str | None, party: str) -> DataFrame:
    """Both sides of a party's account by day up to the reference date (default: the last date of either
    side), with the totals of both and what is left of each day's amount.

    The oldest amounts are settled first, so what one side has paid in all cuts the
    running total of the other: a day is open as far as it lies above the cut. One
    window per party finds it, without matching invoices with receipts.
    """
    days = _daily(ledger, party)
    if as_of is None:
        days = attach_row(days, days.agg(F.max("txn_date").alias("as_of")))
    else:
        days = days.withColumn("as_of", F.lit(as_of).cast("date"))
    whole = Window.partitionBy("customer")
    upto = whole.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, 0)
    totals = days.filter(F.col("txn_date") <= F.col("as_of")).select(
        "customer",
        "txn_date",
        "as_of",
        "invoiced",
        "received",
        F.sum("invoiced").over(upto).cast(_TOTAL).alias("cum_invoiced"),
        F.sum("received").over(upto).cast(_TOTAL).alias("cum_received"),
        F.sum("invoiced").over(whole).cast(_TOTAL).alias("all_invoiced"),
        F.sum("received").over(whole).cast(_TOTAL).alias("all_received"),
    )

    def left(running: str, paid: str, amount: str):
        above = F.col(running) - F.col(paid)
        return F.greatest(F.least(above, F.col(amount).cast(_TOTAL)), F.lit(0).cast(_TOTAL)).cast(_TOTAL)

    return totals.withColumns(
        {
            "open_invoice": left("cum_invoiced", "all_received", "invoiced"),
            "open_advance": left("cum_received", "all_invoiced", "received"),
        }
    )


def open_items(
    ledger: DataFrame, as_of: str | None = None, party: str = "particulars", edges: tuple = AGEING_EDGES
) -> DataFrame:
    """What first-in-first-out settlement leaves of each day: unpaid invoices and unused receipts (advances).

    Later rows than ``as_of`` do not count, rows without a party are left out, and a party has open items on
    one side only. With the settled amounts up to the same date they add up to what was invoiced and received.
    """
    rows = _sides(ledger, as_of, party)
    entry = "struct<kind:string,amount:decimal(38,2),open:decimal(38,2)>"

    def item(kind: str, amount: str, rest: str):
        made = F.struct(F.lit(kind).alias("kind"), F.col(amount).alias("amount"), F.col(rest).alias("open")).cast(entry)
        return F.when(F.col(rest) > 0, made)

    entries = F.array(item("invoice", "invoiced", "open_invoice"), item("advance", "received", "open_advance"))
    found = rows.select("customer", "txn_date", "as_of", F.explode(entries).alias("e")).filter(F.col("e").isNotNull())
    age = F.datediff("as_of", "txn_date").cast("bigint")
    return found.select(
        "customer",
        F.col("e.kind").alias("kind"),
        "txn_date",
        F.col("e.amount").alias("amount"),
        F.col("e.open").alias("open_amount"),
        age.alias("age_days"),
        _age_band(age, edges).alias("age_band"),
    )


def open_items_table(ledger: DataFrame, as_of: str | None = None, party: str = "particulars") -> DataFrame:
    return open_items(ledger, as_of, party).select(
        "customer",
        "kind",
        iso(F.col("txn_date")).alias("txn_date"),
        half_up(F.col("amount"), 2).alias("amount"),
        half_up(F.col("open_amount"), 2).alias("open_amount"),
        "age_days",
        "age_band",
    )


def ageing_report(
    ledger: DataFrame, as_of: str | None = None, party: str = "particulars", edges: tuple = AGEING_EDGES
) -> DataFrame:
    """Per party: invoiced, received, settled, open by age of the invoice, and advances. One row for each party
    with an invoice or a receipt, settled or not."""
    age = F.datediff("as_of", "txn_date")
    rows = _sides(ledger, as_of, party).withColumn("band", _age_band(age, edges))
    names = _band_names(edges)
    totals = rows.groupBy("customer").agg(
        F.sum("invoiced").alias("i"),
        F.sum("received").alias("r"),
        F.sum("open_invoice").alias("o"),
        F.sum("open_advance").alias("a"),
        F.max(F.when(F.col("open_invoice") > 0, age)).cast("bigint").alias("oldest_open_days"),
        *[sum_where(F.col("band") == n, "open_invoice").alias(f"b{k}") for k, n in enumerate(names)],
    )
    return totals.select(
        "customer",
        half_up(F.col("i"), 2).alias("invoiced"),
        half_up(F.col("r"), 2).alias("received"),
        half_up(F.col("i") - F.col("o"), 2).alias("settled"),
        half_up(F.col("o"), 2).alias("open_amount"),
        *[
            half_up(F.col(f"b{k}"), 2).alias("open_" + n.replace("-", "_to_").replace("+", "_on"))
            for k, n in enumerate(names)
        ],
        half_up(F.col("a"), 2).alias("advances"),
        "oldest_open_days",
    )
