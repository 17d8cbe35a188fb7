"""Voucher categories and row predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vouchermill.config import CATEGORY_PATTERNS, OTHER, VOUCHER_TYPES
from vouchermill.functions.parsing import trim_text


def categorise_exact(vch_type: Column, labels: dict[str, tuple] = VOUCHER_TYPES) -> Column:
    """Category of a voucher type by exact match of its trimmed text."""
    text = trim_text(vch_type)
    out = None
    for category, names in labels.items():
        test = text.isin(*names)
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(OTHER)


def categorise_pattern(vch_type: Column, patterns: tuple = CATEGORY_PATTERNS) -> Column:
    """Category by the first contained word, ignoring case."""
    out = None
    for word in patterns:
        test = vch_type.ilike(f"%{word}%")
        out = F.when(test, word) if out is None else out.when(test, word)
    return out.otherwise(OTHER)


def is_category(*names: str) -> Column:
    c = F.col("txn_category")
    return c == names[0] if len(names) == 1 else c.isin(*names)


def party_contains(keyword: str, party: str = "particulars") -> Column:
    return F.coalesce(F.lower(F.col(party)).contains(keyword.lower()), F.lit(False))


def not_zero_row() -> Column:
    return ~((F.col("debit_amount") == 0) & (F.col("credit_amount") == 0))


def positive_row() -> Column:
    return (F.col("debit_amount") > 0) | (F.col("credit_amount") > 0)
