from __future__ import annotations

import pytest

from tests.conftest import table
from tillbook.plans import dashboard, rankings, seller

NOW = "2024-03-10 12:00:00"


@pytest.fixture(scope="module")
def shop(make, shop_of):
    t = "2024-03-09 10:00:00"
    old = "2024-02-01 10:00:00"
    return shop_of(
        categories=make("categories", "id name slug is_active created_at",
                        (1, "Bears", "bears", True, old), (2, "Cars", "cars", True, old),
                        (3, "Gone", "gone", False, old), (4, "Empty", "empty", True, old)),
        subcategories=make("subcategories", "id category_id name slug is_active created_at",
                           (11, 1, "Small", "bears-small", True, old), (21, 2, "Fast", "cars-fast", True, old)),
        products=make("products", "id category_id subcategory_id name slug product_code purchase_price sale_price"
                      " discount_percent discount_price stock featured is_active created_at",
                      (1, 1, 11, "A", "a", "1", 5, 10, 0, 10, 5, True, True, "2024-01-01 00:00:00"),
                      (2, 1, 11, "B", "b", None, 5, 10, 0, 10, 5, False, True, "2024-01-02 00:00:00"),
                      (3, 2, 21, "C", "c", "x", 5, 10, 50, 5, 0, True, True, "2024-01-03 00:00:00"),
                      (4, 2, None, "D", "d", "4", 5, 10, 0, 10, 5, False, False, "2024-01-04 00:00:00"),
                      (5, None, None, "E", "e", "5", 5, 10, 0, 10, 5, True, True, "2024-01-05 00:00:00")),
        customers=make("customers", "id name", (1, "Ann"), (2, "Bob")),
        users=make("users", "id name role_id", (7, "Sal", 3), (8, "Sam", 5)),
        user_roles=make("user_roles", "id name", (3, "Seller"), (5, "Staff")),
        orders=make("orders", "id user_id customer_id total_amount status created_at",
                    (1, None, 1, 100, "successful", t), (2, None, 2, 50, "pending", t),
                    (3, 7, None, 30, "successful", old), (4, None, 1, 20, "cancelled", t),
                    (5, None, 2, 0, "return", t), (6, 8, None, 10, "successful", old)),
        order_items=make("order_items", "id order_id product_id quantity returned_quantity",
                         (1, 1, 1, 4, 1), (2, 1, None, 9, 0), (3, 2, 1, 50, 0), (4, 3, 2, 4, 0),
                         (5, 4, 2, 50, 0), (6, 5, 3, 7, 7), (7, 6, 4, 6, 0)),
        sales=make("sales", "id staff_id customer_id total_amount status created_at",
                   (1, 8, None, 40, "completed", old), (2, 8, 1, 70, "voided", t), (3, 8, 1, 70, "returned", t)),
        sale_items=make("sale_items", "id sale_id product_id quantity returned_quantity",
                        (1, 1, 3, 8, 0), (2, 2, 1, 99, 0), (3, 3, 1, 99, 99)),
    )


def test_only_sold_lines_with_a_product_count(shop):
    assert table(rankings.product_units(shop)) == [(1, 4), (2, 4), (3, 8), (4, 6)]


def test_net_units_leave_out_what_came_back(shop):
    assert (1, 3) in table(rankings.product_units(shop, net=True))


def test_best_selling_skips_out_of_stock_and_breaks_ties_by_id(shop):
    rows = [(r.id, r.total_sold) for r in rankings.best_selling(shop).collect()]
    assert rows == [(1, 4), (2, 4)]


def test_top_products_keep_out_of_stock(shop):
    rows = [(r.id, r.total_sold, r.category_name) for r in dashboard.dash_top_products(shop).collect()]
    assert rows == [(3, 8, "Cars"), (1, 4, "Bears"), (2, 4, "Bears")]


def test_hot_categories_look_at_the_last_week(shop):
    assert [(r.id, r.total_sold) for r in rankings.hot_categories(shop, NOW).collect()] == [(1, 4)]


def test_inactive_product_counts_for_its_active_category(shop):
    ranked = rankings.featured_categories_ranked(shop).collect()
    assert [(r.name, r.total_sold) for r in ranked] == [("Cars", 14), ("Bears", 8), ("Empty", 0)]


def test_fallback_lists_names_with_no_units(shop):
    rows = rankings.hot_categories(shop, "2030-01-01 00:00:00", limit=2).collect()
    assert [(r.name, r.total_sold) for r in rows] == [("Bears", None), ("Cars", None)]


def test_fallback_products_are_the_newest_featured_in_stock(shop):
    out = rankings.featured_products(shop, "2030-01-01 00:00:00")
    assert [r.id for r in out.collect()] == [5, 1]
    assert "total_sold" in out.columns and "subcategory_name" in out.columns


def test_one_line_table_serves_every_ranking(shop):
    units = rankings.window_units(shop, NOW)
    assert table(units) == [(1, 4, 4), (2, 4, None), (3, 8, None), (4, 6, None)]


def test_dashboard_shares_units_and_totals(shop):
    with dashboard.dashboard(shop, NOW) as parts:
        assert table(parts["revenue"]) == [(140.0,)]
        assert table(parts["counts"]) == [(4, 4, 2)]
        assert table(parts["status_breakdown"]) == [("cancelled", 1), ("pending", 1), ("return", 1), ("successful", 1)]
        assert [r.name for r in parts["top_categories"].collect()] == ["Cars", "Bears", "Empty"]
        assert [r.id for r in parts["recent_orders"].collect()] == [5, 4, 2, 1]


def test_sellers_are_reported_at_current_cost(shop):
    assert table(seller.totals(shop)) == [(20.0, 4, 1, 4)]
    assert table(seller.seller_status(shop)) == [("successful", 1)]
    top = seller.top_products(shop).collect()
    assert [(r.id, r.total_sold, float(r.total_cost)) for r in top] == [(2, 4, 20.0)]
