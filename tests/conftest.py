import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vouchermill.session import build_session  # noqa: E402

LEDGER_DDL = (
    "txn_date date, particulars string, vch_type string, vch_no string, "
    "debit_amount decimal(18,2), credit_amount decimal(18,2), txn_category string"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", {"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def make_ledger(spark):
    """Ledger from short rows: (date, party, category, amount[, voucher number])."""

    def build(rows):
        debit = {"Sales", "Payment", "Journal", "Debit Note"}
        full = []
        for i, row in enumerate(rows):
            date, party, category, amount = row[:4]
            number = row[4] if len(row) > 4 else f"V/{i}"
            amount = Decimal(str(amount))
            d, c = (amount, Decimal(0)) if category in debit else (Decimal(0), amount)
            full.append((dt.date.fromisoformat(date), party, category, number, d, c, category))
        return spark.createDataFrame(full, LEDGER_DDL)

    return build


def rows_of(df, *keys):
    """Rows as dictionaries, sorted by the given columns."""
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else out
