from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tillbook.operators import allocation
from tillbook.plans import lifecycle, pricing, stock

ITEMS = "id order_id product_id price quantity returned_quantity"
REQ = "sale_id bigint, line_id bigint, quantity int"


@pytest.fixture(scope="module")
def products(make):
    return make("products", "id name product_code purchase_price sale_price discount_percent discount_price stock",
                (1, "A", "1", 4, 10, 0, 10, 10), (2, "B", None, 3, 8, 25, 6, 3))


@pytest.fixture(scope="module")
def orders(make):
    return make("orders", "id status total_amount", (1, "pending", 30), (2, "successful", 26),
                (3, "return", 0), (4, "successful", 10), (5, "pending", 60))


@pytest.fixture(scope="module")
def items(make):
    return make("order_items", ITEMS,
                (1, 1, 1, 10, 3, 0), (2, 2, 1, 10, 2, 0), (3, 2, 2, 6, 1, 0), (4, 3, 1, 10, 3, 3),
                (5, 4, None, 5, 2, 2), (6, 5, 2, 6, 10, 0))


def test_prices_by_mode(make, products):
    lines = make("cart bigint, product_id bigint, quantity int", "", (1, 1, 2), (1, 2, 3), (1, 9, 1))
    got = {m: table(pricing.price_lines(lines, products, m), "product_id", "price", "line_total")
           for m in ("retail", "till", "cost")}
    assert got["retail"] == got["till"] == [(1, 10.0, 20.0), (2, 6.0, 18.0)]
    assert got["cost"] == [(1, 4.0, 8.0), (2, 3.0, 9.0)]


def test_bill_clamps(make):
    carts = make("id bigint, subtotal decimal(20,2), discount_amount decimal(10,2), tax_percent decimal(5,2),"
                 " service_charge_percent decimal(5,2), amount_paid decimal(20,2)", "",
                 (1, 100, 10, 8, 10, 500), (2, 50, 80, 8, 10, 0), (3, 10, 0, 2.5, 0, None), (4, 99.99, 0, 0, 0, -1))
    got = table(pricing.bill_totals(carts), "id", "after_discount", "tax_amount", "service_amount",
                "total_amount", "amount_paid", "balance_due")
    assert got == [
        (1, 90.0, 7.2, 9.0, 106.2, 106.2, 0.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (3, 10.0, 0.25, 0.0, 10.25, 10.25, 0.0), (4, 99.99, 0.0, 0.0, 99.99, 99.99, 0.0),
    ]


def test_transitions(make, orders, items, products):
    req = make("order_id bigint, to_status string", "", (1, "successful"), (2, "return"), (3, "successful"),
               (4, "cancelled"), (5, "successful"), (9, "pending"), (3, "shipped"))
    decided, moves = lifecycle.order_transitions(orders, items, products, req)
    assert table(decided, "order_id", "to_status", "outcome", "status", "total_amount") == [
        (1, "successful", "ok", "successful", 30.0),
        (2, "return", "ok", "return", 0.0),
        (3, "shipped", "invalid status", "return", 0.0),
        (3, "successful", "ok", "successful", 0.0),
        (4, "cancelled", "ok", "cancelled", 10.0),
        (5, "successful", "not enough stock", "pending", 60.0),
        (9, "pending", "order not found", None, None),
    ]
    # approved again after a return: the full quantity leaves stock once more
    assert table(moves, "line_id", "delta") == [(1, -3), (2, 2), (3, 1), (4, -3)]
    back = lifecycle.lines_after_transition(items, decided)
    assert table(back.where("order_id = 2"), "id", "returned_quantity") == [(2, 2), (3, 1)]


def test_approved_again_after_return_is_flagged(make, items):
    again = make("orders", "id status total_amount", (3, "successful", 0), (2, "successful", 26))
    assert table(lifecycle.resold_after_return(again, items)) == [(3, 0.0)]


def test_order_return_partial_then_rest(make, orders, items):
    part = make(REQ.replace("sale", "order"), "", (2, 2, 1), (2, 2, 1), (2, 3, 0), (1, 1, 1), (9, 1, 1))
    after, lines, refused = lifecycle.order_returns(orders, items, part)
    assert table(after) == [(2, 6.0, "successful")]
    assert table(refused) == [(1, "not open for returns"), (9, "not found")]
    rest = make(REQ.replace("sale", "order"), "", (2, 3, 1))
    again, _, _ = lifecycle.order_returns(orders, lines.select(*items.columns), rest)
    assert table(again) == [(2, 0.0, "return")]


def test_order_return_is_refused_as_a_whole(make, orders, items):
    req = make(REQ.replace("sale", "order"), "", (2, 2, 1), (2, 3, 2), (4, 2, 1))
    after, _, refused = lifecycle.order_returns(orders, items, req)
    assert table(after) == []
    assert table(refused) == [(2, "more than remaining"), (4, "invalid item")]


def test_returns_are_the_same_with_shared_parts_written(make, orders, items, monkeypatch):
    written = []
    monkeypatch.setattr(lifecycle, "cut_lineage", lambda df: written.append(df) or df)
    req = make(REQ.replace("sale", "order"), "", (2, 2, 1), (2, 3, 1), (1, 1, 1), (9, 1, 1))
    plain = [table(df) for df in lifecycle.order_returns(orders, items, req)]
    assert not written
    assert [table(df) for df in lifecycle.order_returns(orders, items, req, several=True)] == plain
    assert len(written) == 2 and all(plain)


SALE = "id status subtotal total_amount amount_paid"


def test_sale_return_twice_equals_once(make):
    sales = make("sales", SALE, (1, "completed", 30, 35.19, 35.19))
    lines = make("sale_items", "id sale_id product_id price quantity returned_quantity", (1, 1, 1, 10, 3, 0))
    one, first_lines, _ = lifecycle.sale_returns(sales, lines, make(REQ, "", (1, 1, 1)))
    assert table(one) == [(1, 20.0, 23.46, -11.73, "completed")]
    then = one.selectExpr("sale_id as id", "status", "subtotal", "total_amount", "cast(35.19 as decimal(10,2)) as amount_paid")
    two, _, _ = lifecycle.sale_returns(then, first_lines.select(*lines.columns), make(REQ, "", (1, 1, 1)))
    both, _, _ = lifecycle.sale_returns(sales, lines, make(REQ, "", (1, 1, 2)))
    assert table(two) == table(both) == [(1, 10.0, 11.73, -23.46, "completed")]
    everything, _, _ = lifecycle.sale_returns(sales, lines, make(REQ, "", (1, 1, 3)))
    assert table(everything) == [(1, 0.0, 0.0, -35.19, "returned")]


def test_void_gives_back_what_is_still_out(make):
    sales = make("sales", "id status", (1, "completed"), (2, "voided"), (3, "returned"))
    lines = make("sale_items", "id sale_id product_id quantity returned_quantity",
                 (1, 1, 7, 5, 2), (2, 1, None, 4, 0), (3, 2, 7, 9, 0), (4, 1, 8, 1, 1))
    decided, back = lifecycle.void_sales(sales, lines, make("sale_id bigint", "", (1,), (2,), (3,), (4,)))
    assert table(decided, "sale_id", "outcome") == [
        (1, "ok"), (2, "already voided"), (3, "already returned"), (4, "not found")]
    assert table(back) == [(7, 3)]


def test_refused_payment_uses_nothing(make):
    sales = make("sales", "id status total_amount amount_paid balance_due",
                 (1, "completed", 100, 40, 60), (2, "returned", 50, 0, 50))
    req = make("id bigint, sale_id bigint, amount decimal(10,2), method string", "",
               (1, 1, 50, "cash"), (2, 1, 20, "cash"), (3, 1, 10, "card"), (4, 1, 0.01, "cash"),
               (5, 1, 5, "coins"), (6, 2, 5, "cash"), (7, 1, -5, "cash"), (8, 3, 1, "cash"))
    judged, after = lifecycle.apply_payments(sales, req, ["id"], F.floor(F.col("id") / 3))
    assert {r.id for r in judged.collect() if r.admitted} == {1, 3}
    assert table(after, "sale_id", "amount_paid", "balance_due") == [(1, 100.0, 0.0), (2, 0.0, 50.0)]


def test_stock_balance_is_opening_plus_movements(make, shop_of, products):
    shop = shop_of(
        products=products,
        orders=make("orders", "id status created_at", (1, "successful", "2024-01-02 00:00:00"),
                    (2, "return", "2024-01-03 00:00:00"), (3, "pending", "2024-01-01 00:00:00")),
        order_items=make("order_items", "id order_id product_id quantity returned_quantity",
                         (1, 1, 1, 4, 1), (2, 2, 1, 2, 2), (3, 3, 1, 9, 0), (4, 1, None, 3, 0)),
        sales=make("sales", "id status created_at", (1, "completed", "2024-01-01 00:00:00"),
                   (2, "voided", "2024-02-01 00:00:00"), (3, "returned", "2023-01-01 00:00:00")),
        sale_items=make("sale_items", "id sale_id product_id quantity returned_quantity",
                        (1, 1, 2, 1, 0), (2, 2, 1, 5, 2), (3, 3, 1, 3, 3)),
    )
    assert table(stock.stock_balance(shop)) == [(1, 10, -3, 7), (2, 3, -1, 2)]
    ledger = [(r.kind, r.delta, r.balance) for r in
              stock.stock_ledger(shop).where("product_id = 1").collect()]
    assert sorted(ledger)[:2] == [("approval", -4, 6), ("approval", -2, 5)]
    assert ("void", 3, 7) in ledger and ("sale_return", 2, 4) in ledger
    moves = table(stock.stock_movements(shop).groupBy("product_id").sum("delta"))
    assert moves == [(1, -3), (2, -1)]


def test_whole_carts(make, products):
    """A refused cart leaves its other lines to later carts."""
    held = {r.id: r.stock for r in products.collect()}
    lines = make("cart bigint, id bigint, product_id bigint, quantity int", "",
                 (1, 1, 2, held[2] - 1), (2, 2, 2, 2), (2, 3, 1, held[1]), (3, 4, 2, 1), (4, 5, 1, held[1]), (5, 6, 77, 1))
    out = stock.whole_carts(lines, products, "cart", ["cart"], F.floor(F.col("cart") / 2))
    assert table(out) == [(1, 1, True), (2, 2, False), (3, 1, True), (4, 1, True), (5, 1, False)]


def test_a_refused_order_leaves_its_stock_to_the_next(make):
    products = make("products", "id name stock", (1, "a", 5), (2, "b", 1))
    orders = make("orders", "id status total_amount", (1, "pending", 1), (2, "pending", 1), (3, "successful", 1), (4, "pending", 1))
    items = make("order_items", "id order_id product_id quantity returned_quantity",
                 (1, 1, 1, 5, 0), (2, 1, 2, 2, 0), (3, 2, 1, 4, 0), (4, 3, 2, 2, 1), (5, 4, 2, 2, 0))
    asked = make("order_id bigint, to_status string", "", (1, "successful"), (2, "successful"), (3, "cancelled"), (4, "successful"))
    decided, moves = lifecycle.order_transitions(orders, items, products, asked)
    assert table(decided, "order_id", "outcome") == [(1, "not enough stock"), (2, "ok"), (3, "ok"), (4, "ok")]
    assert table(moves, "line_id", "delta") == [(3, -4), (4, 1), (5, -2)]


def test_parts_add_up_after_rounding(make):
    parts = make("sale_id bigint, method string, amount decimal(10,2)", "",
                 (1, "cash", 33.33), (1, "card", 33.33), (1, "cheque", 33.34), (2, "cash", 5))
    wholes = make("sale_id bigint, old decimal(10,2), new decimal(10,2)", "", (1, 100, 10), (2, 0, 3))
    out = allocation.scale_parts(parts, wholes, "sale_id", "method", "amount", "old", "new")
    assert table(out) == [(1, "card", 3.34), (1, "cash", 3.33), (1, "cheque", 3.33), (2, "cash", 0.0)]


def test_backfills(make):
    sales = make("sales", "id shift_id staff_id total_amount amount_paid balance_due payment_method created_at",
                 (1, 1, 1, 9, 0, 9, "card", "2024-01-01 00:00:00"))
    assert table(lifecycle.as_fully_paid(sales), "amount_paid", "balance_due") == [(9.0, 0.0)]
    assert table(lifecycle.payments_from_sales(sales), "sale_id", "amount", "method") == [(1, 9.0, "card")]
    old = make("order_items", "id order_id product_id product_code", (1, 1, 1, None), (2, 1, 1, "k"), (3, 1, 5, None))
    codes = make("products", "id product_code", (1, "p1"))
    assert table(lifecycle.with_line_codes(old, codes), "id", "product_code") == [(1, "p1"), (2, "k"), (3, None)]


def test_lines_of_a_return_are_shuffled_once(spark, make):
    """Lines, requests, their parents and the headers: one shuffle of each; rows without an id meet no request."""
    items = make("order_items", ITEMS, (1, 1, 9, 5, 3, 0), (1, 1, 9, 5, 3, 0), (None, 1, 9, 5, 2, 0), (3, 2, 9, 1, 1, 0), (4, 3, 9, 1, 2, 0), (5, None, 9, 1, 1, 0))
    orders = make("orders", "id status total_amount", *[(i, "successful", 20) for i in (1, 1, 2, 3)])
    asked = spark.createDataFrame(
        [(1, 1, 1), (1, 1, 1), (1, 7, -4), (2, None, 1), (3, 4, 3), (None, 5, 1), (8, 1, 1)], "order_id bigint, line_id bigint, quantity int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after, lines, refused = lifecycle.order_returns(orders, items, asked)
        assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4
        # a repeated header repeats figures and reasons, but no line
        assert table(lines, "id", "order_id", "returned_quantity", "came_back") == [(1, 1, 2, 2)] * 2
        assert table(after) == [(1, 10.0, "successful")] * 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert table(refused) == [(2, "invalid item"), (3, "more than remaining"), (8, "not found"), (None, "not found")]
