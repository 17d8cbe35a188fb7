import datetime as dt

from conftest import rows_of
from vouchermill.operators.overlap import overlap_report, resolve_overlap, resolve_stored_overlap
from vouchermill.operators.reports import duplicate_vouchers
from vouchermill.sources.voucher_tables import numbered_rows, open_by_voucher, unnumbered_rows, write_by_voucher

START = dt.date(2026, 1, 1)


def books(make_ledger):
    a = make_ledger(
        [
            ("2025-12-31", "x", "Sales", 1, "V1"),  # before the start, number reused later: kept
            ("2026-01-01", "x", "Sales", 2, "V1"),  # on the start day, also in b: dropped
            ("2026-01-02", "x", "Sales", 3, "V2"),  # only in a: kept
            ("2026-01-03", "x", "Sales", 4, None),  # no number: kept
            ("2026-01-04", "x", "Sales", 5, "V9"),  # in b only before the start: kept
        ]
    )
    b = make_ledger(
        [
            ("2025-12-30", "x", "Sales", 6, "V9"),
            ("2026-01-01", "x", "Sales", 7, "V1"),
            ("2026-02-01", "x", "Sales", 8, None),
        ]
    )
    return a, b


def amounts(df):
    return sorted(int(r.debit_amount) for r in df.collect())


def test_resolve(make_ledger):
    a, b = books(make_ledger)
    assert amounts(resolve_overlap(a, b, START)) == [1, 3, 4, 5, 7, 8]


def test_second_run_changes_nothing(make_ledger):
    a, b = books(make_ledger)
    once = resolve_overlap(a, b, START)
    numbered = once.filter("vch_no is not null")
    assert amounts(resolve_overlap(numbered, b, START)) == [1, 3, 5, 7, 8]


def test_report(make_ledger):
    a, b = books(make_ledger)
    assert rows_of(overlap_report(a, b, START)) == [
        {"a_overlap_rows": 4, "b_overlap_rows": 2, "removed_rows": 1, "kept_rows": 3}
    ]


def stored(spark, df, path, table):
    write_by_voucher(df, str(path / table), table, 4)
    return numbered_rows(spark, table), unnumbered_rows(spark, str(path / table), df.schema)


def test_stored_books_are_joined_without_a_shuffle(spark, make_ledger, tmp_path):
    a, b = books(make_ledger)
    found = resolve_stored_overlap(*stored(spark, a, tmp_path, "book_a"), *stored(spark, b, tmp_path, "book_b"), START)
    assert amounts(found) == amounts(resolve_overlap(a, b, START)) == [1, 3, 4, 5, 7, 8]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # a book without rows
    none = stored(spark, b.limit(0), tmp_path, "book_none")
    assert amounts(resolve_stored_overlap(*stored(spark, a, tmp_path, "book_c"), *none, START)) == [1, 2, 3, 4, 5]


def test_stored_duplicates_are_counted_in_their_buckets(spark, make_ledger, tmp_path):
    a, b = books(make_ledger)
    both = a.unionByName(b)
    numbered, unnumbered = stored(spark, both, tmp_path, "books")
    found = duplicate_vouchers(numbered)
    assert rows_of(found) == rows_of(duplicate_vouchers(both)) == [
        {"vch_no": "V1", "count": 3}, {"vch_no": "V9", "count": 2}
    ]
    # the one exchange left sorts the report
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") > 0
    assert unnumbered.count() == 2


def test_a_stored_folder_is_registered_again(spark, make_ledger, tmp_path):
    a, _ = books(make_ledger)
    numbered, _ = stored(spark, a, tmp_path, "kept")
    before, schema = rows_of(numbered, "vch_no", "debit_amount"), numbered.schema
    spark.sql("DROP TABLE kept")  # an outer table: its files stay
    for _ in range(2):
        open_by_voucher(spark, str(tmp_path / "kept"), "kept", schema, 4)
    again = numbered_rows(spark, "kept")
    assert rows_of(again, "vch_no", "debit_amount") == before
    assert "Exchange" not in again.groupBy("vch_no").count()._jdf.queryExecution().executedPlan().toString()
