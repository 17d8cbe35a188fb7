"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session (default 8)

Every query runs to completion and its rows are discarded (``noop`` sink). The
first run of a session pays for class loading and code generation, so each query
runs twice and the second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vouchermill.plans.catalog import registry
from vouchermill.session import build_session

HEADLINE = (
    "clean_daybook", "resolve_overlap", "duplicate_vouchers", "star_join", "monthly_sales_trend",
    "pareto_ranked", "supplier_spend", "monthly_gross_margin", "cash_flow_receipt_credit",
    "quarterly_performance", "top_buyers", "zscore_outliers", "financial_summary", "yoy_comparison",
    "measures_by_fy", "rfm_banded", "payment_profile", "churn_profile", "iqr_baseline", "all_anomalies",
    "trend_fit", "bootstrap_forecast", "ridge_margin", "feed_pareto_line", "fifo_settlement",
    "days_to_payment", "revenue_by_product_type",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
