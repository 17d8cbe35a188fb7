"""Raw sheet to clean ledger. Each step is a ``DataFrame -> DataFrame`` function
for ``.transform()``; together they are one narrow stage without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from vouchermill.config import REPEATED_HEADER_MARKS, SUMMARY_PARTIES, SUMMARY_PREFIXES
from vouchermill.functions.calendar import with_calendar
from vouchermill.functions.categories import categorise_exact, not_zero_row, positive_row
from vouchermill.functions.parsing import parse_amount_or_zero, parse_mixed_date, trim_text
from vouchermill.schemas import LEDGER, RAW_COLUMNS


def rename_positional(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in zip(df.columns[:6], RAW_COLUMNS)], *df.columns[6:])


def _repeated_header() -> Column:
    return F.coalesce(trim_text(F.col("txn_date")).isin(*REPEATED_HEADER_MARKS), F.lit(False))


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    return df.filter(~_repeated_header())


def parse_date_or_drop(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_date", parse_mixed_date(F.col("txn_date"))).dropna(subset=["txn_date"])


def parse_amounts(df: DataFrame) -> DataFrame:
    names = ("debit_amount", "credit_amount")
    return df.withColumns({n: parse_amount_or_zero(F.col(n)) for n in names})


def trim_texts(df: DataFrame, names: tuple = ("particulars", "vch_type", "vch_no")) -> DataFrame:
    return df.withColumns({n: trim_text(F.col(n)) for n in names})


def _summary_party(party: Column) -> Column:
    summary = party.isin(*SUMMARY_PARTIES)
    for prefix in SUMMARY_PREFIXES:
        summary = summary | party.startswith(prefix)
    return summary


def drop_summary_rows(df: DataFrame) -> DataFrame:
    party = F.lower(F.col("particulars"))
    return df.filter(party.isNotNull() & ~_summary_party(party))


def tag_source_year(label: str | Column):
    """Label of the file a row came from; it is not the fiscal year of its date."""
    value = F.lit(label) if isinstance(label, str) else label
    return lambda df: df.withColumn("source_year", value)


def add_category(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_category", categorise_exact(F.col("vch_type")))


def drop_zero_rows(df: DataFrame) -> DataFrame:
    return df.filter(not_zero_row())


def keep_positive_rows(df: DataFrame) -> DataFrame:
    return df.filter(positive_row())


def clean_rows(raw: DataFrame) -> DataFrame:
    """The cleaning steps without the columns that follow from others."""
    return (
        raw.transform(rename_positional)
        .transform(drop_repeated_headers)
        .transform(parse_date_or_drop)
        .transform(parse_amounts)
        .transform(trim_texts)
        .transform(drop_summary_rows)
    )


def as_ledger(rows: DataFrame, source_year: str | Column, keep: tuple = ()) -> DataFrame:
    """Clean rows with all ledger columns and those to keep."""
    full = rows.transform(tag_source_year(source_year)).transform(with_calendar).transform(add_category)
    return full.select(*LEDGER.fieldNames(), *keep)


def clean_daybook(raw: DataFrame, source_year: str | Column, keep: tuple = ()) -> DataFrame:
    """All cleaning steps, ending in the ledger columns and those to keep."""
    return as_ledger(clean_rows(raw), source_year, keep)


#: why a raw row is dropped, in the order of the steps
REPEATED_HEADER, BAD_DATE, NO_PARTY, SUMMARY_ROW = "repeated header", "bad date", "no party", "summary row"
REJECT_REASONS = (REPEATED_HEADER, BAD_DATE, NO_PARTY, SUMMARY_ROW)


def reject_reason() -> Column:
    """The first step that drops a raw row, NULL for a row that stays. A blank party is a missing one: a CSV
    file does not tell them apart."""
    party = F.lower(trim_text(F.col("particulars")))
    return (
        F.when(_repeated_header(), REPEATED_HEADER)
        .when(parse_mixed_date(F.col("txn_date")).isNull(), BAD_DATE)
        .when(party.isNull() | (party == ""), NO_PARTY)
        .when(_summary_party(party), SUMMARY_ROW)
    )


def rejected_rows(raw: DataFrame) -> DataFrame:
    """The raw rows that cleaning drops, as they came, with the reason."""
    return rename_positional(raw).withColumn("reason", reject_reason()).filter(F.col("reason").isNotNull())


def _lost_amount(name: str) -> Column:
    text = trim_text(F.col(name))
    return (F.length(text) > 0) & F.col(name).try_cast("decimal(18,2)").isNull()


def observe_cleaning(raw: DataFrame, counts: Observation) -> DataFrame:
    """The raw rows unchanged; the action that reads them also fills ``counts``.

    Counted are all rows, rows by reject reason, and among the rows that stay the
    amounts that are no number (they become 0). The counts come from the pass that
    cleans: rows are neither read nor parsed a second time. Put it where the rows are
    read, with no shuffle between them and the result, so that a task that is run
    again is counted once. Without rows every count is 0.
    """
    reason = reject_reason()
    flagged = rename_positional(raw).select(
        F.struct("*").alias("_row"),
        reason.alias("_reason"),
        (reason.isNull() & _lost_amount("debit_amount")).alias("_no_debit"),
        (reason.isNull() & _lost_amount("credit_amount")).alias("_no_credit"),
    )
    metrics = [F.count_if(F.col("_reason") == name).alias(name) for name in REJECT_REASONS]
    seen = flagged.observe(
        counts,
        F.count(F.lit(1)).alias("raw"),
        *metrics,
        F.count_if("_no_debit").alias("no debit"),
        F.count_if("_no_credit").alias("no credit"),
    )
    return seen.select("_row.*").toDF(*raw.columns)


def cleaning_steps(spark: SparkSession, counts: Observation) -> DataFrame:
    """Rows dropped and left after every step, and amounts set to 0, from the counts of a finished run."""
    found = counts.get
    left = found["raw"]
    rows = [(0, "raw", 0, left)]
    for i, reason in enumerate(REJECT_REASONS, 1):
        left -= found[reason]
        rows.append((i, reason, found[reason], left))
    for i, name in enumerate(("no debit", "no credit"), len(rows)):
        rows.append((i, name, 0, found[name]))
    return spark.createDataFrame(rows, "step int, name string, dropped bigint, rows bigint")
