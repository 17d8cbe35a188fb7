"""Registered queries: each takes a session and the folder of the tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from vouchermill.functions import calendar as cal
from vouchermill.functions.calendar import iso
from vouchermill.functions.categories import categorise_exact, categorise_pattern, party_contains
from vouchermill.functions.numeric import half_up
from vouchermill.operators import anomalies, cleaning, customers, forecast, margin, overlap, parties, reports
from vouchermill.operators import settlement, slicers
from vouchermill.plans import feeds
from vouchermill.schemas import LEDGER
from vouchermill.session import shared_folder
from vouchermill.sources import trade_tables as tables
from vouchermill.sources.readers import read_clean_ledger, read_daybook, read_register, read_table
from vouchermill.sources.ledger_store import read_store, replace_years
from vouchermill.sources.voucher_tables import numbered_rows, unnumbered_rows, write_by_voucher
from vouchermill.sources.writers import export_ledger, write_ledger, write_result
from vouchermill.streaming import baselines, ingest, scoring, totals

# parameters of the registered queries, chosen to reach every branch of the data
FY = "1999-00"
PRIOR, CURRENT = "1999-00", "2000-01"
AS_OF = "2001-03-31"
OVERLAP_START = dt.date(2000, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]

CASH = ("Receipt", "Payment")
TRADE = ("Sales", "Purchase")


def _canonical(spark: SparkSession, folder: str, categories=("Sales",), derived: bool = False) -> DataFrame:
    rows = tables.ledger(spark, folder, categories, derived=derived)
    return parties.canonical_party(rows, tables.party_alias(spark, folder))


def _over(
    operator, categories=tables.ALL_CATEGORIES, party: bool = True, derived: bool = False, years: tuple = (), **options
) -> Query:
    """Query that applies an operator to the ledger of some categories (and of the years that the operator keeps)."""
    return lambda spark, folder: operator(tables.ledger(spark, folder, categories, party, derived, years), **options)


def _named(operator, **options) -> Query:
    """Query whose rows collapse by party codes before names are joined."""
    return lambda spark, folder: operator(
        tables.ledger(spark, folder, party=tables.CODE, years=options.get("years", ())),
        names=tables.with_names(spark, folder),
        **{k: v for k, v in options.items() if k != "years"},
    )


def _supplier_report(operator) -> Query:
    return lambda spark, folder: operator(
        tables.purchase_register(spark, folder, tables.CODE), names=tables.with_names(spark, folder, "supplier_name", "s")
    )


def _rows(df: DataFrame, *columns) -> DataFrame:
    """Ledger rows in output form: ISO dates, amounts as DOUBLE."""
    return df.select(
        *[
            iso(F.col(c)).alias(c)
            if c == "txn_date"
            else half_up(F.col(c), 2).alias(c)
            if c.endswith("_amount")
            else F.col(c)
            for c in columns
        ]
    )


# ---------------------------------------------------------------- cleaning


def clean_daybook(spark, folder):
    clean = cleaning.clean_daybook(tables.raw_daybook(spark, folder), "book-a")
    return _rows(
        clean, "txn_date", "particulars", "vch_type", "vch_no", "debit_amount", "credit_amount",
        "txn_category", "fiscal_year", "source_year", "month_num", "fiscal_month_num", "month_name",
        "day_of_week", "quarter",
    )


def rejected_rows(spark, folder):
    return cleaning.rejected_rows(tables.raw_daybook(spark, folder)).select(
        "reason", "txn_date", "particulars", "vch_type", "vch_no", "debit_amount", "credit_amount"
    )


def cleaning_steps(spark, folder):
    """Counts of every cleaning step, taken while the clean ledger is written from the landed sheet."""
    target = shared_folder(spark, "cleaning")
    tables.raw_daybook(spark, folder).write.option("header", False).csv(f"{target}/landing")
    counts = Observation()
    raw = cleaning.observe_cleaning(read_daybook(spark, f"{target}/landing"), counts)
    cleaning.clean_daybook(raw, "book-a").write.parquet(f"{target}/clean")
    return cleaning.cleaning_steps(spark, counts)


def _label_counts(categorise):
    def query(spark, folder):
        raw = tables.raw_daybook(spark, folder)
        labels = raw.select(F.col("_c2").alias("vch_type"))
        counts = labels.groupBy("vch_type").agg(F.count(F.lit(1)).alias("rows"))
        return counts.select("vch_type", categorise(F.col("vch_type")).alias("txn_category"), "rows")

    return query


def _counts_after(step):
    def query(spark, folder):
        kept = step(tables.ledger(spark, folder, party=False))
        return kept.groupBy("txn_category").agg(F.count(F.lit(1)).alias("rows")).orderBy("txn_category")

    return query


def canonical_party(spark, folder):
    rows = _canonical(spark, folder)
    return reports.invoice_summary(rows)


def _two_sources(spark, folder):
    rows = tables.ledger(spark, folder, ("Sales", "Receipt"))
    rows = rows.withColumn("number", F.regexp_extract("vch_no", r"(\d+)$", 1).cast("bigint"))
    number = F.col("number")
    # every eleventh voucher of either book has no number
    rows = rows.withColumn("vch_no", F.when(number % 11 != 0, F.col("vch_no")))
    first = rows.filter(F.col("txn_date") < F.lit(dt.date(2000, 7, 1))).drop("number")
    second = rows.filter((F.col("txn_date") >= F.lit(dt.date(1999, 10, 1))) & (number % 3 != 0)).drop("number")
    return (
        first.withColumn("source_year", F.lit("book-a")),
        second.withColumn("source_year", F.lit("book-b")),
    )


def resolve_overlap(spark, folder):
    a, b = _two_sources(spark, folder)
    return _rows(
        overlap.resolve_overlap(a, b, OVERLAP_START),
        "txn_date", "particulars", "vch_no", "debit_amount", "credit_amount", "source_year",
    )


def overlap_report(spark, folder):
    a, b = _two_sources(spark, folder)
    return overlap.overlap_report(a, b, OVERLAP_START)


def calendar(spark, folder):
    days = cal.ledger_calendar(tables.ledger(spark, folder, party=False))
    return days.select(
        iso(F.col("date")).alias("date"), "year", "month_num", "month_name", "quarter", "fy", "month_sort", "week_no"
    )


def fiscal_columns(spark, folder):
    rows = tables.ledger(spark, folder, party=False)
    counts = rows.groupBy("txn_date").agg(F.count(F.lit(1)).alias("rows"))
    c = cal.with_calendar(counts)
    return c.select(
        iso(F.col("txn_date")).alias("txn_date"), "rows", "fiscal_year", "month_num", "fiscal_month_num",
        "month_name", "day_of_week", "quarter", cal.month_bucket(F.col("txn_date")).alias("month"),
    )


def party_keyword_payments(spark, folder):
    rows = tables.ledger(spark, folder, ("Payment", "Purchase Order"))
    keyword = F.when(party_contains("CAPITAL"), "capital").when(party_contains("loan"), "loan").otherwise("none")
    t = rows.groupBy(keyword.alias("keyword"), "txn_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("debit_amount").alias("s")
    )
    return t.select("keyword", "txn_category", "rows", half_up(F.col("s"), 2).alias("amount"))


# ---------------------------------------------------------------- joins


def star_join(spark, folder):
    sales = _canonical(spark, folder)
    days = cal.ledger_calendar(tables.ledger(spark, folder, ("Sales",), party=False))
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    people = read_table(spark, folder, "customer")
    dim = people.join(nation, people.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("market"), F.col("n_name").alias("nation")
    )
    joined = parties.star_join(sales, days, dim)
    t = joined.groupBy("cal_fy", "cal_quarter", "market", "nation").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("debit_amount").alias("s")
    )
    return t.select("cal_fy", "cal_quarter", "market", "nation", "invoices", half_up(F.col("s"), 2).alias("sales"))


def star_join_suppliers(spark, folder):
    bought = tables.ledger(spark, folder, ("Purchase",))
    days = cal.ledger_calendar(tables.ledger(spark, folder, ("Purchase",), party=False))
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    firms = read_table(spark, folder, "supplier")
    dim = firms.join(nation, firms.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_name").alias("name"), F.col("n_name").alias("nation")
    )
    joined = parties.star_join(bought, days, dim)
    t = joined.groupBy("cal_fy", "cal_quarter", "nation").agg(
        F.count(F.lit(1)).alias("bills"), F.sum("credit_amount").alias("s")
    )
    return t.select("cal_fy", "cal_quarter", "nation", "bills", half_up(F.col("s"), 2).alias("purchase"))


def customer_receipts(spark, folder):
    sales = _canonical(spark, folder)
    receipts = _canonical(spark, folder, ("Receipt",))
    kept = parties.customer_receipts(receipts, sales)
    t = kept.groupBy(F.col("particulars").alias("customer")).agg(
        F.count(F.lit(1)).alias("receipts"), F.sum("credit_amount").alias("s")
    )
    return t.select("customer", "receipts", half_up(F.col("s"), 2).alias("received"))


def entity_baseline_rows(spark, folder):
    sales = _canonical(spark, folder).select("particulars", "vch_no", "debit_amount")
    rows = anomalies.with_entity_baseline(sales, "particulars", "debit_amount")
    return rows.select(
        "vch_no",
        "particulars",
        half_up(F.col("debit_amount"), 2).alias("amount"),
        "entity_rows",
        half_up(F.col("entity_avg"), 2).alias("entity_mean"),
    )


# ---------------------------------------------------------------- customers


def _rfm(spark, folder):
    return customers.rfm_banded(_canonical(spark, folder))


def _churn(spark, folder):
    return customers.churn_profile(_canonical(spark, folder), PRIOR, CURRENT, AS_OF)


def _payment(spark, folder):
    rows = _canonical(spark, folder, ("Sales", "Receipt"))
    return customers.payment_profile(rows, tables.last_dates(spark, folder))


def _churn_select(*columns):
    return lambda spark, folder: _churn(spark, folder).select(*columns)


# ---------------------------------------------------------------- anomalies


def _events(spark, folder):
    e = read_table(spark, folder, "events")
    return e.select("event_id", "user_id", "ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))


def _sales_rows(spark, folder):
    sales = _canonical(spark, folder, derived=True).filter(F.col("debit_amount") > 0)
    return sales.select("particulars", "debit_amount", "txn_date", "vch_no", "fiscal_year")


def iqr_anomalies(spark, folder):
    flagged = anomalies.iqr_anomalies(_sales_rows(spark, folder), "particulars", "debit_amount")
    return flagged.withColumn("txn_date", iso(F.col("txn_date"))).withColumnRenamed("entity", "customer")


def _purchase_rows(spark, folder):
    return tables.ledger(spark, folder, ("Purchase",)).filter(F.col("credit_amount") > 0)


def iqr_event_anomalies(spark, folder):
    flagged = anomalies.iqr_anomalies(_events(spark, folder), "user_id", "value")
    return flagged.select(
        "event_id", F.col("entity").alias("user_id"), "amount", "entity_mean", "expected_low", "expected_high",
        "deviation_pct", "flag_type",
    )


def _all_anomalies(spark, folder):
    return anomalies.all_anomalies(_canonical(spark, folder, TRADE, derived=True))


# ---------------------------------------------------------------- forecast


def _features(spark, folder):
    series = forecast.monthly_series(tables.ledger(spark, folder, ("Sales",), party=False))
    return forecast.monthly_features(series)


def _segment_features(spark, folder):
    sales = _canonical(spark, folder)
    people = read_table(spark, folder, "customer").select(
        F.col("c_name").alias("particulars"), F.col("c_mktsegment").alias("market")
    )
    rows = sales.join(people, "particulars", "left")
    return forecast.monthly_features(forecast.monthly_series(rows, ("market",)), ("market",))


def monthly_features(spark, folder):
    f = _features(spark, folder)
    return f.select(
        cal.month_bucket(F.col("month_start")).alias("month"),
        half_up(F.col("amount"), 2).alias("revenue"),
        "period",
        "month_of_year",
        half_up(F.col("sin_month"), 6).alias("sin_month"),
        half_up(F.col("cos_month"), 6).alias("cos_month"),
        "step",
    )


def future_frame(spark, folder):
    f = forecast.future_frame(_features(spark, folder))
    return f.select(
        cal.month_bucket(F.col("month_start")).alias("month"), "period", "month_of_year",
        half_up(F.col("sin_month"), 6).alias("sin_month"), half_up(F.col("cos_month"), 6).alias("cos_month"), "step",
    )


def _timeline(spark, folder):
    return forecast.forecast_timeline(_features(spark, folder), digits=0)


# ---------------------------------------------------------------- streaming


def _event_stream(spark, folder):
    schema = read_table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.select("event_id", "user_id", "ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))


def stream_daily_totals(spark, folder):
    target = shared_folder(spark, "daily-totals")
    events = _event_stream(spark, folder)
    totals.write_daily_totals(events, f"{target}/log", f"{target}/checkpoint", "ts", "event_type", "value").awaitTermination()
    t = totals.read_daily_totals(spark, f"{target}/log")
    return t.select(iso(F.col("day")).alias("day"), "category", "rows", half_up(F.col("amount"), 2).alias("amount"))


def stream_monthly_totals(spark, folder):
    """Events land in four files and come in four batches, of which two are folded into one."""
    target = shared_folder(spark, "monthly-totals")
    events = read_table(spark, folder, "events").select("ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    events.repartition(4).write.parquet(f"{target}/landing")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/landing")
    totals.write_daily_totals(stream, f"{target}/log", f"{target}/checkpoint", "ts", "event_type", "value").awaitTermination()
    totals.compact_daily_totals(spark, f"{target}/log", 1)
    t = totals.monthly_rollup(totals.read_daily_totals(spark, f"{target}/log"))
    return t.select("month", "category", "rows", half_up(F.col("amount"), 2).alias("amount"))


def stream_scoring(spark, folder):
    target = shared_folder(spark, "stream-scoring")
    limits = anomalies.iqr_limits(_events(spark, folder), "user_id", "value").filter(F.col("row_count") >= 5)
    # baselines are stored once; every batch of the stream reads the stored table
    limits.write.parquet(f"{target}/baselines")
    stored = spark.read.schema(limits.schema).parquet(f"{target}/baselines")
    flags = scoring.score_stream(_event_stream(spark, folder), stored, "user_id", "value")
    scoring.write_flags(flags, f"{target}/flags", f"{target}/checkpoint").awaitTermination()
    out = spark.read.schema(flags.schema).parquet(f"{target}/flags")
    return out.select(
        "event_id", F.col("entity").alias("user_id"), "amount", "entity_mean", "expected_low", "expected_high",
        "deviation_pct", "flag_type",
    )


#: the first dates of the second and third arrival
ARRIVALS = ("1998-01-01", "2000-01-01")


def _grown(spark, folder) -> str:
    """Sales arrive in three runs, by date, and are scored against what came before; the first two
    batches are folded before the last comes."""
    target = shared_folder(spark, "growing-baselines")
    sales = _sales_rows(spark, folder)
    run = F.lit(0)
    for start in ARRIVALS:
        run = run + F.coalesce((F.col("txn_date") >= F.lit(start).cast("date")).cast("int"), F.lit(0))
    sales.withColumn("run", run).write.partitionBy("run").parquet(f"{target}/sales")
    stored = spark.read.schema(sales.withColumn("run", run).schema).parquet(f"{target}/sales")
    for number in range(len(ARRIVALS) + 1):
        if number == len(ARRIVALS):
            baselines.compact_baselines(spark, f"{target}/log", number - 1)
        stored.filter(F.col("run") == number).drop("run").write.parquet(f"{target}/landing/{number}")
        stream = spark.readStream.schema(sales.schema).parquet(f"{target}/landing/*")
        baselines.score_and_learn(
            stream, target, f"{target}/checkpoint", "particulars", "debit_amount"
        ).awaitTermination()
    return target


def stream_growing_baselines(spark, folder):
    """Baselines after all batches: those of all rows at once."""
    grown = baselines.read_baselines(spark, f"{_grown(spark, folder)}/log", "particulars")
    return anomalies.rounded_baseline(grown, "particulars")


def stream_growing_flags(spark, folder):
    """Sales outside the range that the batches before theirs gave their customer."""
    flags = spark.read.parquet(f"{_grown(spark, folder)}/flags")
    return flags.select(
        iso(F.col("txn_date")).alias("txn_date"), "vch_no", F.col("entity").alias("customer"), "amount", "entity_mean",
        "expected_low", "expected_high", "deviation_pct", "flag_type",
    )


def _ingested(spark, raw, files_per_batch):
    """Every raw row arrives in two books; each numbered voucher is kept from the first."""
    target = shared_folder(spark, "ingest")
    raw.write.option("header", False).csv(f"{target}/landing/first")
    repeated = raw.filter(F.col("_c3").isNotNull())
    repeated.write.option("header", False).csv(f"{target}/landing/second")
    run = ingest.ingest_daybook(
        spark, f"{target}/landing/*", f"{target}/ledger", f"{target}/checkpoint", "book-a", files_per_batch, "folder"
    )
    run.awaitTermination()
    out = spark.read.schema(LEDGER).parquet(f"{target}/ledger")
    return _rows(
        out, "txn_date", "particulars", "vch_type", "vch_no", "debit_amount", "credit_amount", "txn_category",
        "fiscal_year",
    )


def stream_ingest(spark, folder):
    """A line per voucher, all files in one batch."""
    return _ingested(spark, tables.raw_daybook(spark, folder), 1000)


def stream_ingest_lines(spark, folder):
    """Up to three lines per voucher, which come in several files and batches."""
    raw = tables.raw_daybook(spark, folder)
    number = F.trim("_c3").substr(3, 20).try_cast("bigint")
    shared = F.concat(F.lit("V/"), F.call_function("div", number, F.lit(3)))
    # a file for every core, three at least; two thirds of a book's files are a batch
    files = max(3, spark.sparkContext.defaultParallelism)
    return _ingested(spark, raw.withColumn("_c3", F.coalesce(shared, "_c3")).repartition(files, "_c0"), -(-2 * files // 3))


# ---------------------------------------------------------------- stored tables


def _stored_ledger(spark, folder) -> DataFrame:
    """The derived ledger, written as a stored one and read back."""
    target = shared_folder(spark, "ledger")
    derived = cal.calendar_columns(F.col("txn_date")) | {"source_year": F.lit("trade")}
    rows = tables.ledger(spark, folder).withColumn("fiscal_year", derived.pop("fiscal_year"))
    write_ledger(rows, target, derived=derived)
    return read_clean_ledger(spark, target)


def _exported_ledger(spark, folder) -> DataFrame:
    """The derived ledger as CSV under the names of an exported file, read back."""
    target = shared_folder(spark, "export")
    rows = tables.ledger(spark, folder, derived=True).withColumn("source_year", F.lit("trade"))
    export_ledger(rows, target)
    return read_clean_ledger(spark, target, "csv")


def stored_week_53(spark, folder):
    """Rows and amounts on the days of an ISO week 53, which few fiscal years have."""
    stored = _stored_ledger(spark, folder)
    days = cal.ledger_calendar(stored).filter(F.col("week_no") == 53)
    t = slicers.ledger_of_days(stored, days).groupBy("txn_date", "fiscal_year", "txn_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("debit_amount").alias("d"), F.sum("credit_amount").alias("c")
    )
    return t.select(
        iso(F.col("txn_date")).alias("txn_date"), "fiscal_year", "txn_category", "rows",
        half_up(F.col("d"), 2).alias("debit"), half_up(F.col("c"), 2).alias("credit"),
    )


def stored_year_replaced(spark, folder):
    """A store of all years, of which one comes again with other sales and without transfers."""
    stored = _stored_ledger(spark, folder)
    store = shared_folder(spark, "ledger-store")
    years = [r.fiscal_year for r in stored.select("fiscal_year").distinct().collect()]
    replace_years(stored, store, tuple(years))
    again = cal.of_fiscal_years(read_store(spark, store), FY).filter(F.col("txn_category") != "Contra")
    more = F.when(F.col("txn_category") == "Sales", F.col("debit_amount") + 1).otherwise(F.col("debit_amount"))
    replace_years(again.withColumn("debit_amount", more.cast("decimal(18,2)")), store, (FY,))
    t = read_store(spark, store).groupBy("fiscal_year", "txn_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("debit_amount").alias("d"), F.sum("credit_amount").alias("c")
    )
    return t.select(
        "fiscal_year", "txn_category", "rows", half_up(F.col("d"), 2).alias("debit"), half_up(F.col("c"), 2).alias("credit")
    )


#: buckets of the stored voucher tables
VOUCHER_BUCKETS = 32


def _by_voucher(spark, rows, purpose):
    """Rows stored in buckets of the voucher number: the numbered ones and the others."""
    path, table = shared_folder(spark, purpose), f"{purpose}_{uuid.uuid4().hex}"
    write_by_voucher(rows, path, table, VOUCHER_BUCKETS)
    return numbered_rows(spark, table), unnumbered_rows(spark, path, rows.schema)


def stored_overlap(spark, folder):
    """Two stored books with common days, joined bucket by bucket."""
    a, b = _two_sources(spark, folder)
    found = overlap.resolve_stored_overlap(
        *_by_voucher(spark, a, "first_book"), *_by_voucher(spark, b, "second_book"), OVERLAP_START
    )
    return _rows(found, "txn_date", "particulars", "vch_no", "debit_amount", "credit_amount", "source_year")


def stored_duplicate_vouchers(spark, folder):
    """Numbers that both books of a stored ledger use, counted within their buckets."""
    a, b = _two_sources(spark, folder)
    numbered, _ = _by_voucher(spark, a.unionByName(b), "both_books")
    return reports.duplicate_vouchers(numbered)


def stored_daybook(spark, folder):
    """Day-book rows through a CSV file and the cleaning steps."""
    target = shared_folder(spark, "daybook")
    tables.raw_daybook(spark, folder).write.option("header", False).csv(target)
    clean = cleaning.clean_daybook(read_daybook(spark, target), "book-a")
    return _rows(
        clean, "txn_date", "particulars", "vch_type", "vch_no", "debit_amount", "credit_amount", "txn_category",
        "fiscal_year", "source_year", "month_num", "fiscal_month_num", "month_name", "day_of_week", "quarter",
    )


def stored_register(spark, folder):
    """Supplier spend from a purchase register written and read as CSV."""
    target = shared_folder(spark, "register")
    register = tables.purchase_register(spark, folder)
    write_result(register, target, "csv")
    return reports.supplier_spend(read_register(spark, target, register.schema))


# ---------------------------------------------------------------- registry


def _trade(operator, **options):
    return _over(operator, TRADE, party=False, **options)


def registry() -> dict[str, Query]:
    r, c, m, f = reports, customers, margin, feeds
    sales = ("Sales",)
    return {
        # cleaning and derived columns
        "clean_daybook": clean_daybook,
        "rejected_rows": rejected_rows,
        "cleaning_steps": cleaning_steps,
        "categorise_exact": _label_counts(categorise_exact),
        "categorise_pattern": _label_counts(categorise_pattern),
        "drop_zero_rows": _counts_after(cleaning.drop_zero_rows),
        "keep_positive_rows": _counts_after(cleaning.keep_positive_rows),
        "canonical_party": canonical_party,
        "resolve_overlap": resolve_overlap,
        "overlap_report": overlap_report,
        "duplicate_vouchers": _over(r.duplicate_vouchers, party=False),
        "party_keyword_payments": party_keyword_payments,
        "distinct_categories": _over(r.distinct_categories, party=False),
        "calendar": calendar,
        "fiscal_columns": fiscal_columns,
        # joins
        "star_join": star_join,
        "star_join_suppliers": star_join_suppliers,
        "customer_receipts": customer_receipts,
        "entity_baseline_rows": entity_baseline_rows,
        "sales_growth_yoy": _over(r.sales_growth, sales, party=False),
        # aggregation reports
        "monthly_sales_trend": _over(r.monthly_sales_trend, sales, party=False),
        "monthly_revenue_fy": _over(r.monthly_revenue_fy, sales, party=False, fy=FY),
        "pareto_top": _over(r.pareto_top, sales),
        "pareto_ranked": _over(r.pareto_ranked, sales),
        "supplier_spend": _supplier_report(r.supplier_spend),
        "monthly_gross_margin": _trade(r.monthly_gross_margin),
        "cash_flow_receipt_debit": _over(r.cash_flow_receipt_debit, party=False),
        "cash_flow_receipt_credit": _over(r.cash_flow_receipt_credit, party=False),
        "cash_flow_filtered": _over(r.cash_flow_filtered, CASH, party=False),
        "volume_by_weekday": _over(r.volume_by_weekday, sales, party=False),
        "tax_liability": _over(r.tax_liability, party=False),
        "quarterly_performance": _over(r.quarterly_performance, party=False),
        "top_buyers": lambda s, d: r.top_buyers(
            tables.sales_register(s, d, tables.CODE), names=tables.with_names(s, d, "buyer_name", "c")
        ),
        "zscore_outliers": lambda s, d: anomalies.zscore_outliers(
            _events(s, d), "value", ["event_id", "user_id"]
        ),
        "zscore_sales": _over(
            anomalies.zscore_outliers, sales, amount="debit_amount", columns=["vch_no", "particulars"], cut=1.5, high=1.7
        ),
        "financial_summary": _named(r.financial_summary),
        "yoy_comparison": _named(r.yoy_comparison, years=(PRIOR, CURRENT), fy_a=PRIOR, fy_b=CURRENT),
        "category_counts": _over(r.category_counts, party=False),
        "ledger_profile": _named(r.ledger_profile),
        "invoice_summary_per_customer": lambda s, d: r.invoice_summary(_canonical(s, d)),
        "receipt_summary_per_customer": lambda s, d: c.receipt_summary(_canonical(s, d, ("Sales", "Receipt"))),
        "fy_split_per_customer": lambda s, d: c.fy_split_per_customer(_canonical(s, d), PRIOR, CURRENT),
        "segment_summary": lambda s, d: c.segment_summary(_rfm(s, d)),
        "tier_summary": lambda s, d: c.tier_summary(_canonical(s, d, ("Sales", "Receipt"))),
        "churn_summary": lambda s, d: c.churn_summary(_churn(s, d)),
        "churn_impact": lambda s, d: c.churn_impact(_churn(s, d)),
        "anomaly_counts": lambda s, d: anomalies.anomaly_counts(_all_anomalies(s, d)),
        "top_anomalies": lambda s, d: anomalies.top_anomalies(_all_anomalies(s, d)),
        "anomaly_top_parties": lambda s, d: anomalies.anomaly_top_parties(_all_anomalies(s, d)),
        "margin_profile": _trade(m.margin_profile),
        "forecast_profile": lambda s, d: forecast.forecast_profile(_timeline(s, d)),
        # running totals and rankings
        "cumulative_sales": _over(f.cumulative_sales, sales),
        "top_customers_per_segment": lambda s, d: c.top_customers_per_segment(_rfm(s, d)),
        "worst_margin_months": _trade(m.worst_margin_months),
        "cumulative_cash": _over(r.cumulative_cash, CASH, party=False),
        # customers
        "rfm_banded": lambda s, d: c.by_score(_rfm(s, d)),
        "rfm_minmax": _over(c.rfm_minmax, sales),
        "payment_profile": lambda s, d: c.by_tier(_payment(s, d)),
        "churn_profile": lambda s, d: c.by_status(_churn(s, d)),
        "churn_status_default_date": lambda s, d: c.churn_profile(_canonical(s, d), PRIOR, CURRENT).select(
            "customer", "churn_status", "days_since_last"
        ),
        "revenue_at_risk": _churn_select(
            "customer", "churn_status", "revenue_lakhs", "revenue_at_risk_lakhs", "recommended_action"
        ),
        "churn_lists": lambda s, d: c.churn_lists(_churn(s, d)),
        # anomalies
        "iqr_baseline": lambda s, d: anomalies.iqr_baseline(_sales_rows(s, d), "particulars", "debit_amount"),
        "iqr_skipped": lambda s, d: anomalies.iqr_skipped(_sales_rows(s, d), "particulars"),
        "iqr_supplier_baseline": lambda s, d: anomalies.iqr_baseline(
            _purchase_rows(s, d), "particulars", "credit_amount"
        ),
        "iqr_skipped_suppliers": lambda s, d: anomalies.iqr_skipped(_purchase_rows(s, d), "particulars"),
        "iqr_anomalies": iqr_anomalies,
        "iqr_event_anomalies": iqr_event_anomalies,
        "all_anomalies": lambda s, d: anomalies.by_deviation(_all_anomalies(s, d)),
        # forecast
        "monthly_features": monthly_features,
        "future_frame": future_frame,
        "trend_fit": lambda s, d: forecast.trend_fit(_features(s, d)),
        "trend_fit_by_market": lambda s, d: forecast.trend_fit(_segment_features(s, d), ("market",)),
        "point_forecast": lambda s, d: forecast.point_forecast(_features(s, d)),
        "bootstrap_forecast": lambda s, d: forecast.rounded_forecast(
            forecast.bootstrap_forecast(_features(s, d)), digits=0
        ),
        "bootstrap_forecast_by_market": lambda s, d: forecast.rounded_forecast(
            forecast.bootstrap_forecast(_segment_features(s, d), ("market",)), ("market",), digits=0
        ),
        "forecast_timeline": _timeline,
        # margin
        "monthly_margin": _trade(m.margin_table),
        "ridge_margin": _trade(m.ridge_margin),
        "ridge_quality": _trade(m.ridge_quality),
        "ridge_quality_scaled": _trade(m.ridge_quality, scale=1.0),
        "margin_health": _trade(m.health_counts),
        "what_if": _trade(m.what_if),
        "simple_line": _trade(m.simple_line),
        # measures
        "measures_by_fy": _named(r.measures_by_year),
        "measures_by_slicers": _named(slicers.measures_by_slicers),
        "customers_by_slicers": lambda s, d: slicers.customers_by_slicers(_canonical(s, d, ("Sales", "Receipt"))),
        # feeds
        "feed_kpi_cards": _named(f.kpi_cards),
        "feed_kpi_cards_sliced": lambda s, d: f.kpi_cards(
            f.slice_ledger(tables.ledger(s, d, derived=True, years=(FY,)), FY, "Q2")
        ),
        "feed_revenue_sliced_by_segment": lambda s, d: r.monthly_sales_trend(
            f.slice_ledger(_canonical(s, d, derived=True), segments=_rfm(s, d), segment="At Risk")
        ),
        "feed_revenue_forecast": lambda s, d: f.revenue_with_average(_timeline(s, d)),
        "feed_sales_vs_purchase": _trade(f.sales_vs_purchase),
        "feed_margin_gauge": _trade(f.margin_gauge),
        "feed_revenue_by_customer": lambda s, d: f.revenue_by_customer(_canonical(s, d), _rfm(s, d)),
        "feed_pareto_line": _over(f.pareto_line, sales),
        "feed_customer_month_matrix": _over(f.customer_month_matrix, sales, fy=FY),
        "feed_sales_by_quarter": _over(f.sales_by_quarter, sales, party=False, derived=True),
        "feed_supplier_buckets": _supplier_report(f.supplier_buckets),
        "feed_cash_kpis": lambda s, d: f.cash_kpis(tables.ledger(s, d, CASH, False), _payment(s, d)),
        "feed_top_payers": _over(f.top_payers_per_month, ("Receipt",)),
        "feed_rfm_scatter": lambda s, d: f.rfm_scatter(_rfm(s, d)),
        "feed_at_risk_count": lambda s, d: f.at_risk_count(_rfm(s, d)),
        "feed_margin_colours": _trade(f.margin_colours),
        "feed_anomaly_series": lambda s, d: f.anomaly_series(_canonical(s, d)),
        "feed_year_comparison": lambda s, d: f.year_comparison(_churn(s, d)),
        "feed_collection_rates": lambda s, d: f.collection_rates(_payment(s, d)),
        "feed_recency_bands": lambda s, d: f.recency_bands(_churn(s, d)),
        # customer questions
        "order_frequency": lambda s, d: r.order_frequency(_canonical(s, d)),
        "fifo_settlement": lambda s, d: settlement.settlement_table(_canonical(s, d, ("Sales", "Receipt"))),
        "days_to_payment": lambda s, d: settlement.days_to_payment(_canonical(s, d, ("Sales", "Receipt"))),
        "open_items": lambda s, d: settlement.open_items_table(_canonical(s, d, ("Sales", "Receipt")), AS_OF),
        "ageing_report": lambda s, d: settlement.ageing_report(_canonical(s, d, ("Sales", "Receipt"))),
        "declining_customers": lambda s, d: c.declining_customers(_canonical(s, d), PRIOR, CURRENT),
        "revenue_by_product_type": lambda s, d: r.revenue_by_product_type(
            read_table(s, d, "lineitem"), read_table(s, d, "part")
        ),
        # stored tables
        "stored_ledger_revenue": lambda s, d: r.monthly_revenue_fy(_stored_ledger(s, d), FY),
        "stored_ledger_profile": lambda s, d: r.ledger_profile(_stored_ledger(s, d)),
        "stored_ledger_comparison": lambda s, d: r.yoy_comparison(_stored_ledger(s, d), PRIOR, CURRENT),
        "stored_ledger_csv": lambda s, d: r.monthly_revenue_fy(_exported_ledger(s, d), FY),
        "stored_week_53": stored_week_53,
        "stored_year_replaced": stored_year_replaced,
        "stored_overlap": stored_overlap,
        "stored_duplicate_vouchers": stored_duplicate_vouchers,
        "stored_daybook": stored_daybook,
        "stored_register": stored_register,
        # streaming
        "stream_ingest": stream_ingest,
        "stream_ingest_lines": stream_ingest_lines,
        "stream_daily_totals": stream_daily_totals,
        "stream_monthly_totals": stream_monthly_totals,
        "stream_scoring": stream_scoring,
        "stream_growing_baselines": stream_growing_baselines,
        "stream_growing_flags": stream_growing_flags,
    }
