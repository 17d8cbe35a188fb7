"""SQL statements that check the registered queries."""

from vouchermill.oracle import customers_sql, models_sql, reports_sql


#: queries over tables written and read back: the statement of the same report
STORED = {
    "stored_ledger_revenue": "monthly_revenue_fy", "stored_ledger_profile": "ledger_profile",
    "stored_ledger_comparison": "yoy_comparison", "stored_daybook": "clean_daybook", "stored_register": "supplier_spend",
    "stored_ledger_csv": "monthly_revenue_fy", "stored_overlap": "resolve_overlap",
}


def statements() -> dict[str, str]:
    found = {**reports_sql.S, **customers_sql.S, **models_sql.S}
    return found | {name: found[same] for name, same in STORED.items()}
