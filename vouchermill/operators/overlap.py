"""Two sources that cover some of the same days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from vouchermill.operators.joins import attach_row, join_per_key


def _vouchers_from(b: DataFrame, start: dt.date) -> DataFrame:
    known = b.filter((F.col("txn_date") >= F.lit(start)) & F.col("vch_no").isNotNull())
    return known.select("vch_no").distinct()


def resolve_overlap(a: DataFrame, b: DataFrame, start: dt.date) -> DataFrame:
    """``a`` before ``start``, what only ``a`` has after it, and ``b`` after it.

    Only ``a``'s numbered vouchers on or after ``start`` are shuffled for the
    anti join. The others, and vouchers without a number (which match nothing),
    pass through.
    """
    late = F.col("txn_date") >= F.lit(start)
    numbered = F.col("vch_no").isNotNull()
    untouched = a.filter(~late | ~numbered)
    only_a = join_per_key(a.filter(late & numbered), _vouchers_from(b, start), "vch_no", "left_anti")
    return untouched.unionByName(only_a.select(*a.columns)).unionByName(b.filter(late).select(*a.columns))


def resolve_stored_overlap(
    a: DataFrame, a_unnumbered: DataFrame, b: DataFrame, b_unnumbered: DataFrame, start: dt.date
) -> DataFrame:
    """As :func:`resolve_overlap`, for tables bucketed by voucher number: buckets meet buckets, nothing is shuffled.

    The number alone is the join key, since that is what the tables are dealt by. The
    hint keeps the merge join where Spark would otherwise broadcast or hash a side.
    """
    late = F.col("txn_date") >= F.lit(start)
    taken = b.filter(late).select("vch_no").hint("merge")
    only_a = a.filter(late).join(taken, "vch_no", "left_anti").select(*a.columns)
    parts = (a.filter(~late), a_unnumbered, b.filter(late), b_unnumbered.filter(late))
    out = only_a
    for p in parts:
        out = out.unionByName(p.select(*a.columns))
    return out


def overlap_report(a: DataFrame, b: DataFrame, start: dt.date) -> DataFrame:
    """Row counts of the overlap: in ``a``, in ``b``, removed and kept."""
    late = F.col("txn_date") >= F.lit(start)
    known = _vouchers_from(b, start).withColumn("_hit", F.lit(1))
    flagged = join_per_key(a.filter(late), known, "vch_no", "left")
    counts_a = flagged.agg(
        F.count(F.lit(1)).alias("a_overlap_rows"), F.count("_hit").alias("removed_rows")
    )
    counts_b = b.filter(late).agg(F.count(F.lit(1)).alias("b_overlap_rows"))
    return attach_row(counts_a, counts_b).select(
        "a_overlap_rows",
        "b_overlap_rows",
        "removed_rows",
        (F.col("a_overlap_rows") - F.col("removed_rows")).alias("kept_rows"),
    )
