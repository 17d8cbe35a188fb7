import random
from decimal import Decimal

import numpy as np
import pytest

from conftest import rows_of
from vouchermill.config import FLAG_HIGH, FLAG_LOW
from vouchermill.functions.calendar import with_calendar
from vouchermill.operators import anomalies
from vouchermill.operators.quantiles import exact_quartiles


def frame(spark, groups):
    rows = [(g, Decimal(str(v))) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "who string, amount decimal(18,2)")


def test_quartiles_equal_numpy(spark):
    rnd = random.Random(7)
    groups = {f"g{n}": [round(rnd.lognormvariate(6, 3), 2) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 400)}
    groups["same"] = [12.34] * 30
    groups["mostly"] = [5.0] * 90 + [1e9, 0.01, 7.5]
    got = rows_of(exact_quartiles(frame(spark, groups), "who", "amount"))
    assert len(got) == len(groups)
    for r in got:
        values = groups[r["who"]]
        assert r["row_count"] == len(values)
        assert r["total_amount"] == sum(Decimal(str(v)) for v in values)
        q1, q3 = np.percentile(values, [25, 75])
        assert float(r["q1"]) == pytest.approx(q1, abs=2e-4)
        assert float(r["q3"]) == pytest.approx(q3, abs=2e-4)


def test_group_without_name_is_left_out(spark):
    df = spark.createDataFrame([(None, Decimal(1)), ("a", Decimal(2))], "who string, amount decimal(18,2)")
    assert [r["who"] for r in rows_of(exact_quartiles(df, "who", "amount"))] == ["a"]


def test_range_check(spark):
    groups = {
        "four": [1, 1, 1, 1000],  # too few rows
        "five": [10, 10, 10, 10, 10.01],  # no spread: any other value is outside
        "edge": [10, 20, 30, 40, 70, 70],  # upper fence: nothing outside
        "low": [100, 101, 102, 103, 104, 1],
    }
    df = frame(spark, groups)
    flagged = rows_of(anomalies.iqr_anomalies(df, "who", "amount"), "entity", "amount")
    assert [(r["entity"], r["amount"], r["flag_type"]) for r in flagged] == [
        ("five", 10.01, FLAG_HIGH), ("low", 1.0, FLAG_LOW),
    ]
    assert flagged[1]["deviation_pct"] == round((1 - 511 / 6) / (511 / 6) * 100, 1)
    base = {r["entity"]: r for r in rows_of(anomalies.iqr_baseline(df, "who", "amount"))}
    assert sorted(base) == ["edge", "five", "low"]
    assert base["edge"]["low_bound"] == 0.0  # the fence itself is negative
    assert rows_of(anomalies.iqr_skipped(df, "who")) == [{"entity": "four", "txn_count": 4}]


def test_value_on_the_fence_is_not_flagged(spark):
    # quartiles 10 and 20, so the fences are 0 (clipped) and 35
    values = [10, 10, 20, 20, 35, 0, 15, 15, 15]
    q1, q3 = np.percentile(values, [25, 75])
    assert (q1, q3) == (10.0, 20.0)
    assert rows_of(anomalies.iqr_anomalies(frame(spark, {"a": values}), "who", "amount")) == []
    more = rows_of(anomalies.iqr_anomalies(frame(spark, {"a": values[:4] + [35.01] + values[5:]}), "who", "amount"))
    assert [r["amount"] for r in more] == [35.01]


def test_both_sides_are_tagged(make_ledger):
    from vouchermill.functions.calendar import with_calendar

    rows = [("2024-05-01", "A", "Sales", v) for v in (1, 1, 1, 1, 1, 9)]
    rows += [("2024-05-01", "A", "Purchase", v) for v in (5, 5, 5, 5, 5, 2)]
    rows += [("2024-05-01", "A", "Sales", 0)] * 3
    got = rows_of(anomalies.all_anomalies(with_calendar(make_ledger(rows))), "txn_type")
    assert [(r["txn_type"], r["customer"], r["amount"], r["flag_type"]) for r in got] == [
        ("Purchase", "A", 2.0, FLAG_LOW), ("Sale", "A", 9.0, FLAG_HIGH),
    ]
    assert len(rows_of(anomalies.anomaly_top_parties(anomalies.all_anomalies(with_calendar(make_ledger(rows)))))) == 4


def test_zscore(spark):
    values = [10.0] * 30 + [11.0] * 30 + [500.0, 300.0, 0.0]
    df = frame(spark, {"a": values})
    x = np.array([v for v in values if v > 0])
    z = {v: (v - x.mean()) / x.std() for v in (500.0, 300.0)}
    got = rows_of(anomalies.zscore_outliers(df, "amount", ["who"]), "amount")
    assert [(r["amount"], r["z_score"]) for r in got] == [(v, round(z[v], 2)) for v in (300.0, 500.0)]
    assert [r["flag"] for r in got] == ["Outlier" if z[v] > 3 else "High" for v in (300.0, 500.0)]


def test_entity_baseline_joins_back(spark):
    got = rows_of(anomalies.with_entity_baseline(frame(spark, {"a": [1, 2], "b": [5]}), "who", "amount"), "amount")
    assert [(r["who"], r["entity_rows"], r["entity_avg"]) for r in got] == [("a", 2, 1.5), ("a", 2, 1.5), ("b", 1, 5.0)]


def test_rows_without_a_party_are_no_party(spark, make_ledger):
    """The list of all anomalies leaves them out, as the list per customer does."""
    rows = [("2024-04-01", None, "Sales", 10)] * 6 + [("2024-04-02", None, "Sales", 900)]
    rows += [("2024-04-01", "A", "Sales", 10)] * 6 + [("2024-04-02", "A", "Sales", 900)]
    flagged = rows_of(anomalies.all_anomalies(with_calendar(make_ledger(rows))))
    assert [r["customer"] for r in flagged] == ["A"]
