"""What the physical plans must look like, with every join free to be large."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tests.conftest import SF
from tillbook.operators import running
from tillbook.plans import daybook, orders, rankings, stock
from tillbook.plans.registered import QUERIES
from tillbook.session import cut_lineage
from tillbook.sources import shop as shops
from tillbook.sources import testbed

# these run jobs while they are built, or run a stream
EAGER = {
    "append_rows", "truncate_reload", "export_tables", "stock_check", "stock_check_carts", "apply_payments",
    "apply_payments_sales", "apply_payments_rows", "cooldown", "cash_out_decisions", "order_transition",
    "order_transition_lines", "order_transition_moves", "create_sales", "create_sales_items", "create_sales_payments",
    "create_sales_moves", "create_sales_refused", "place_orders", "place_orders_items", "place_orders_refused",
    "search_products_indexed", "search_customers_indexed", "featured_from_days", "hot_categories_from_days", "hot_subcategories_from_days",
}


@pytest.fixture(scope="module", autouse=True)
def large_tables(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "4000"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_crosses_rows_or_leaves_the_jvm(spark):
    for name, build in QUERIES.items():
        if name in EAGER or name.startswith("stream"):
            continue
        text = plan(build(spark, SF))
        for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow"):
            assert banned not in text, (name, banned)


def test_the_wanted_shifts_meet_the_facts_first(spark):
    """Payments and movements are cut to the open shifts before they are joined or summed."""
    text = plan(daybook.x_report(testbed.daybook(spark, SF)))
    optimised = daybook.x_report(testbed.daybook(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert text and optimised.count("LeftSemi") >= 3


@pytest.fixture
def not_adaptive(spark):
    """Reused exchanges show in the plan only then."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_only_plans_and_moves_its_input_once(spark, monkeypatch, not_adaptive):
    """No job while the plan is made; one scan and one wide exchange, read for the rows and for the buckets' results."""
    monkeypatch.setattr(running, "cut_lineage", lambda df: pytest.fail("a job"))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    text = plan(running.running(
        lines, ["l_orderkey"], ["l_linenumber"], F.col("l_quantity"), "n", F.col("l_linenumber"), null_keys=False))
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") == 1
    assert text.count("- Exchange hashpartitioning(l_orderkey") == 1
    for query in ("stock_ledger", "shift_cash_balance", "line_numbers"):
        own = plan(QUERIES[query](spark, SF))
        assert own.count("ReusedExchange") >= 1 and "SinglePartition" not in own, query
    ledger = stock.stock_ledger(testbed.trade(spark, SF))
    wide = [x for x in plan(ledger).split("- Exchange hashpartitioning(") if x.startswith("product_id") and "_bucket" in x[:40]]
    assert len(wide) == 1
    # a filter on the key reaches the files, also those of the openings
    text = plan(ledger.where("product_id = 5"))
    for key in ("l_", "p_"):
        assert text.count(f"FileScan parquet [{key}") == text.count(f"EqualTo({key}partkey,5)") > 0


def test_running_without_keys_uses_ranges(spark, monkeypatch):
    made = []
    monkeypatch.setattr(running, "cut_lineage", lambda df: made.append(plan(df)) or cut_lineage(df))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    running.position(lines, [], ["l_orderkey", "l_linenumber"], "n").count()
    assert len(made) == 1 and "SinglePartition" not in made[0] and made[0].count("FileScan") == 1


def test_lists_move_their_lines_once(spark):
    shop = testbed.trade(spark, SF)
    text = plan(orders.orders_admin_list(shop))
    after = text[: text.index("collect_list")]
    # lines by order, and the nested lists once more for the final sort
    assert after.count("rangepartitioning") == 1
    lines = [part for part in text.split("Exchange hashpartitioning") if "collect_list" in part]
    assert len(lines) <= 3
    assert plan(orders.my_orders(shop, party=("customer", 5))).count("LeftSemi") == 1


def test_ranking_filters_and_columns_reach_the_files(spark):
    text = plan(rankings.product_units(testbed.trade(spark, SF), "2001-08-01 00:00:00", 7))
    assert text.count("GreaterThanOrEqual(o_orderdate,2001-07-25T00:00)") == 2
    assert text.count("IsNotNull(l_partkey)") == 2
    assert "l_extendedprice" not in text and "l_shipdate" not in text


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("facts")
    testbed.daybook(spark, SF).sales.withColumn("tax_percent", testbed.F.lit(0)).write.parquet(f"{folder}/sales")
    return shops.from_files(spark, str(folder))


def test_day_range_is_pushed_and_sales_are_read_once(files):
    for report in (daybook.z_totals, daybook.totals_and_days):
        text = plan(report(files, "2024-01-03", "2024-01-05"))
        assert text.count("FileScan") == 1
        assert "GreaterThanOrEqual(created_at,2024-01-03T00:00" in text
        assert "LessThan(created_at,2024-01-06T00:00" in text


def test_stock_movements_read_each_channel_once(spark):
    text = plan(stock.stock_movements(testbed.trade(spark, SF)))
    assert text.count("FileScan") == 4  # headers and lines of two channels
