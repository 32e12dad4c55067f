"""Headline queries at one scale: warm seconds per query, one JSON line.

    BENCH_SF_DIR  folder with the tables  (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores             (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillbook.plans.registered import QUERIES  # noqa: E402
from tillbook.session import local_session  # noqa: E402

HEADLINES = [
    # rankings and dashboard
    "best_selling", "hot_categories", "featured_categories_ranked", "units_by_entity",
    "dash_revenue", "dash_revenue_by_day", "dash_top_products", "dash_recent_orders",
    "seller_totals", "seller_top_products",
    # till
    "z_totals", "z_days", "z_payments", "staff_sales", "x_report", "expected_cash",
    # lists
    "product_list", "search_products", "sales_list", "orders_admin_list", "order_bill_text",
    # prices, stock, payments
    "price_lines", "bill_totals", "stock_movements", "stock_ledger", "stock_check",
    "sale_return", "apply_payments",
    # checks
    "key_conflicts", "first_source_wins", "cooldown",
]
RUNS = 2


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINES:
        seconds(spark, name, sf_dir)
        timings[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_warm_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
