import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.functions.numeric import value_bucket
from vouchermill.operators.ranking import running_total_by_value, top_k_per_group, top_with_running_total
from vouchermill.operators.reports import pareto_ranked, pareto_top
from vouchermill.plans.feeds import cumulative_sales, pareto_line


def totals(spark, values):
    rows = [(f"p{i:04d}", Decimal(str(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "customer string, revenue decimal(28,2)")


@pytest.mark.parametrize("seed", range(3))
def test_running_total_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    values = [rnd.choice([0, 5, 5.25, 1e6]) for _ in range(60)]
    values += [round(rnd.lognormvariate(8, 4), 2) for _ in range(200)] + [-3.5, -1000000.01, -3.5]
    values = [Decimal(str(v)) for v in values]
    got = running_total_by_value(totals(spark, values), "revenue").collect()
    assert len(got) == len(values)
    for r in got:
        assert r.running_total == sum(v for v in values if v >= r.revenue)
        assert r["rank"] == 1 + sum(v > r.revenue for v in values)


def test_no_window_sees_all_rows(spark):
    plan = running_total_by_value(totals(spark, [1, 2]), "revenue")._jdf.queryExecution().executedPlan().toString()
    # one single-task exchange: that of the bucket totals, below the broadcast
    assert plan.count("SinglePartition") == 1


def test_bucket_keeps_order(spark):
    values = sorted(
        {0, 1, -1} | {s * (2**k + d) for k in range(1, 57) for d in (-1, 0, 1) for s in (1, -1)}
    )
    df = spark.createDataFrame([(Decimal(v) / 100,) for v in values], "v decimal(18,2)")
    got = df.select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    buckets = [r.b for r in got]
    assert buckets == sorted(buckets)
    for r in got:  # small amounts are alone in their bucket
        if abs(r.v) < 1000:
            assert buckets.count(r.b) == 1


def test_top_rows_share_ties_beyond_the_cut(spark):
    df = totals(spark, [10, 7, 7, 7, 1])
    got = rows_of(top_with_running_total(df, "revenue", 3, ["customer"]), "rank")
    assert [(r["rank"], r["customer"], int(r["running_total"])) for r in got] == [
        (1, "p0000", 10), (2, "p0001", 31), (3, "p0002", 31),
    ]


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = top_k_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_single_party(make_ledger):
    ledger = make_ledger([("2024-05-01", "A", "Sales", 5), ("2024-05-02", "A", "Purchase", 5)])
    assert rows_of(pareto_top(ledger))[0]["cumulative_pct"] == 100.0
    assert rows_of(pareto_ranked(ledger))[0]["revenue_pct"] == 100.0
    assert rows_of(cumulative_sales(ledger))[0]["cumulative_sales"] == 5.0


def test_shares_end_at_hundred(make_ledger):
    ledger = make_ledger([("2024-05-01", f"P{i}", "Sales", 1 + i % 7) for i in range(40)])
    shares = [r["cumulative_pct"] for r in rows_of(pareto_line(ledger))]
    assert max(shares) == 100.0
    assert len(shares) == 40
