"""Tolerant parsing of raw text cells: what does not parse becomes NULL or 0."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_BLANKS = " \t\r\n\f\v"

DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy")


def _may_have(text: Column, fmt: str) -> Column:
    """False only for texts that cannot have the format: its first separator stands right behind the leading
    field, which has a fixed width (a year may have more digits after a plus sign)."""
    lead = re.match("[A-Za-z]*", fmt)[0]
    if lead not in ("yyyy", "MM", "dd") or lead == fmt:
        return F.lit(True)
    behind = F.substring(text, len(lead) + 1, 1) == fmt[len(lead)]
    return behind | text.startswith("+") if lead == "yyyy" else behind


def parse_mixed_date(c: Column, formats: tuple = DATE_FORMATS) -> Column:
    """The first format that a text has. Formats that it cannot have are not tried: a failed attempt costs
    an exception, several times the parsing of a date."""
    text = trim_text(c)
    return F.coalesce(*[F.when(_may_have(text, f), F.try_to_date(text, f)) for f in formats])


def parse_amount_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def trim_text(c: Column) -> Column:
    """Strip blanks, tabs and line breaks at both ends; NULL stays NULL."""
    return F.btrim(c, F.lit(_BLANKS))


def label_text(label: Column, texts: dict[str, str]) -> Column:
    """Look a label up in a small fixed dictionary, NULL when absent."""
    out = F.lit(None).cast("string")
    for key, text in texts.items():
        out = F.when(label == key, F.lit(text)).otherwise(out)
    return out


def label_rank(label: Column, order: tuple) -> Column:
    """Position of a label in a fixed list, from 0; NULL when absent."""
    out = F.lit(None).cast("int")
    for i, key in enumerate(order):
        out = F.when(label == key, F.lit(i)).otherwise(out)
    return out
