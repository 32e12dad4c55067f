"""Registered queries against their SQL at the smallest scale.

A sample by default, all of them with FULL_CHECK=1 (or ``python -m checks.compare``).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, duck_rows, spark_rows
from tests.conftest import SF
from tillbook.plans.registered import QUERIES

SAMPLE = [
    "best_selling", "hot_subcategories", "featured_categories_ranked", "top_k_or_fallback", "units_by_entity",
    "dash_revenue", "seller_totals", "z_days", "z_payments", "x_report", "expected_cash", "shift_cash_balance",
    "orders_admin_list", "product_list_filtered", "search_wildcards", "key_conflicts", "update_join",
    "first_source_wins", "residual_to_largest", "line_numbers", "stock_ledger", "stock_check", "bill_totals",
    "order_transition", "order_transition_moves", "create_sales", "create_sales_refused", "place_orders", "order_return", "sale_return", "apply_payments", "cooldown", "cash_out_decisions",
    "gen_topup_products", "order_bill_text", "font_families", "stable_unit_hash", "stream_ttl_state",
    "featured_from_days", "hot_subcategories_from_days", "stream_shift_reports", "stream_session_shifts",
    "search_products_indexed", "search_customers_indexed", "weighted_pick", "weighted_pick_decimal",
]
NAMES = list(QUERIES) if os.environ.get("FULL_CHECK") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    cols, got = spark_rows(entry.queries()[name](spark, SF))
    names, want, _ = duck_rows(duck, entry.oracle_sql()[name])
    assert cols == names and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 5
