from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tillbook.functions import hashing, money, text
from tillbook.operators import changes, nesting, quality, ranking
from tillbook.plans import catalog, identity, orders


@pytest.fixture(scope="module")
def shop(make, shop_of):
    t = "2024-01-0{} 00:00:00"
    return shop_of(
        categories=make("categories", "id name slug is_active created_at", (1, "Soft Toys", "soft-toys", True, t.format(1))),
        subcategories=make("subcategories", "id category_id name slug is_active created_at",
                           (10, 1, "Bears", "bears", True, t.format(1))),
        products=make("products", "id category_id subcategory_id name slug product_code purchase_price sale_price"
                      " discount_percent discount_price stock featured is_active created_at",
                      (1, 1, 10, "Blue_Bear", "b1", "77", 1, 2, 0, 2, 5, True, True, t.format(1)),
                      (2, 1, None, "Red 100% Car", "c1", None, 1, 2, 0, 2, 0, False, True, t.format(2)),
                      (3, None, None, "BlueXBear", "b2", "78", 1, 2, 0, 2, 50, False, True, t.format(3)),
                      (4, 1, 10, "Old", "o1", "79", 1, 2, 0, 2, 5, False, False, t.format(4))),
        customers=make("customers", "id name whatsapp_number email is_active created_at",
                       (1, "Anonymous", "anonymous-guest", None, True, t.format(1)),
                       (2, "Ann", "94001", "ann@mail.test", True, t.format(2)),
                       (3, "Bob", "94002", None, False, t.format(3)),
                       (7, "Eve", "770", None, True, t.format(4))),
        users=make("users", "id name email phone shop_name city role_id status is_active created_at",
                   (7, "Sal", "sal@shop.test", "770", "S", None, 3, "approved", True, t.format(1)),
                   (8, "Pen", "pen@shop.test", "771", None, None, 3, "pending", False, t.format(2)),
                   (9, "Cus", "ANN@mail.test", None, None, None, 4, "approved", True, t.format(3))),
        user_roles=make("user_roles", "id name", (2, "Admin"), (3, "Seller"), (4, "Customer"), (5, "Staff")),
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_public_list_hides_out_of_stock_and_sorts_newest_first(shop):
    out = catalog.product_list(shop)
    assert ids(out) == [3, 1]
    assert not {"product_code", "purchase_price"} & set(out.columns)


def test_roles_see_what_they_may(shop):
    assert ids(catalog.product_list(shop, role="Admin", staff=True, active="0")) == [4]
    assert ids(catalog.product_list(shop, role="Staff", staff=True, active="0")) == [3, 2, 1]
    assert ids(catalog.product_list(shop, role="Admin", staff=True, low_stock=True)) == [2, 1]
    seller = catalog.product_list(shop, role="Seller", staff=True).columns
    assert "purchase_price" in seller and "sale_price" not in seller and "product_code" not in seller
    assert catalog.hidden_columns("wishlist", "Seller") == ["product_code"]
    assert catalog.hidden_columns("analytics", "Staff") == ["product_code", "purchase_price"]
    assert catalog.hidden_columns("order_items", "Admin") == []


def test_search_covers_four_columns_and_wildcards(shop):
    assert ids(catalog.product_list(shop, staff=True, search="SOFT")) == [2, 1]
    assert ids(catalog.product_list(shop, staff=True, search="bears")) == [1]
    assert ids(catalog.product_list(shop, staff=True, search="78")) == [3]
    assert ids(catalog.product_list(shop, staff=True, search="blue_bear")) == [3, 1]
    assert ids(catalog.product_list(shop, staff=True, search="b%r")) == [3, 1]


def test_paging_and_groups(shop):
    assert ids(catalog.product_list(shop, staff=True, limit=1, offset=1)) == [2]
    assert ids(catalog.product_list(shop, staff=True, category="soft-toys", subcategory="bears")) == [1]
    assert ids(catalog.product_list(shop, featured=True)) == [1]
    assert ids(catalog.wholesale_list(shop)) == [3, 2, 1]


def test_account_lists(shop):
    assert ids(catalog.customers_list(shop)) == [7, 2]
    assert ids(catalog.customers_list(shop, search="9400")) == [2]
    assert ids(catalog.users_list(shop)) == [7]
    assert ids(catalog.users_list(shop, "pending")) == [8]
    assert ids(catalog.users_list(shop, "nonsense")) == [7]


def test_staff_win_over_customers(shop, make):
    req = make("n int, login string", "", (1, "770"), (2, "94001"), (3, "SAL@shop.test"), (4, "none"))
    rows = table(identity.resolve(req, "login", shop), "n", "owner_type", "owner_id")
    assert rows == [(1, "staff", 7), (2, "customer", 2), (3, "staff", 7), (4, None, None)]
    assert ("email", "ann@mail.test") in table(identity.taken_identifiers(shop))
    assert len([r for r in table(identity.taken_identifiers(shop)) if r[0] == "phone" and r[1] == "770"]) == 1


def test_keys_in_use(make, shop):
    names = make("id bigint, name string", "", (1, "Bear"), (2, "bear "), (3, "Car"), (4, " "))
    out = quality.key_conflicts(names, [(names, "name")], "name")
    assert table(out) == [(1, "Bear", False), (2, "bear ", False), (3, "Car", True), (4, " ", True)]
    fresh = make("id bigint, email string", "", (None, "ann@MAIL.test"), (None, "new@x.y"))
    both = quality.key_conflicts(fresh, [(shop.users, "email"), (shop.customers, "email")], "email")
    assert table(both, "email", "available") == [("ann@MAIL.test", False), ("new@x.y", True)]


def test_names_can_be_compared_without_accents(make):
    names = make("id bigint, name string", "", (1, "Café"), (2, "cafe "), (3, "Bar"))
    out = quality.key_conflicts(names, [(names, "name")], "name")
    assert table(out, "id", "available") == [(1, False), (2, False), (3, True)]


def test_search_ignores_accents_on_both_sides(make):
    names = make("id bigint, name string", "", (1, "Café crème"), (2, "CAFE CREME"), (3, "Cafe\u0301 Cre\u0300me"), (4, "Tea"))
    for needle in ("café", "CREM", "f_ cr%e"):
        assert table(names.where(text.contains_pattern(needle, F.col("name"))), "id") == [(1,), (2,), (3,)]


def test_nested_lines_are_whole_and_sorted(spark):
    parents = spark.range(4).selectExpr("id")
    children = spark.range(300).selectExpr(
        "case when id < 200 then 1 else 2 + id % 2 end as parent", "id as child", "id * 2 as q"
    )
    out = nesting.nest_children(parents, children, "id", "parent", ["q"], "child").collect()
    assert {r.id: [e.child for e in r["items"]] for r in out} == {
        0: [], 1: list(range(200)), 2: list(range(200, 300, 2)), 3: list(range(201, 300, 2))}
    assert len(out) == 4


def test_a_large_parent_is_one_row(spark):
    parents = spark.range(2).selectExpr("id")
    children = spark.range(25_000).selectExpr("0 as parent", "25000 - id as child")
    first, second = sorted(nesting.nest_children(parents, children, "id", "parent", [], "child").collect())
    assert [e.child for e in first["items"]] == list(range(1, 25_001)) and second["items"] == []


def test_bill_drops_absent_lines_and_keeps_blank_ones(make):
    head = make("order_id bigint, total_amount decimal(10,2), created_at timestamp_ntz, sender_name string, sender_phone string",
                "", (5, 1234.5, "2024-03-01 09:05:00", "Ann", None))
    lines = make("order_id bigint, number bigint, product_code string, product_name string, price decimal(10,2), quantity int",
                 "", (5, 2, None, "Bear", 500, 2), (5, 1, "77", "Car", 234.5, 1))
    text_ = orders.bill_text(head, lines, shop_name="Toys").first().message
    assert text_.split("\n") == [
        "*Toys - Order Request*", "", "*Order ID:* #5", "*Customer:* Ann", "*Date:* 01 Mar 2024, 09:05 AM",
        "-" * 24, "1. #77", "    1 x Rs. 235/= = Rs. 235/=", "2. Bear", "    2 x Rs. 500/= = Rs. 1,000/=",
        "-" * 24, "*Total: Rs. 1,235/=*", "", "Our staff will contact you soon. Thanks for your patience.",
    ]


def values(spark, exprs, rows, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_text_helpers(spark):
    rows = [("  Soft & Toys! ",), ("--A--",), ("Ünï x",)]
    assert values(spark, [text.slugify(F.col("s"))], rows, "s string") == [("soft-toys",), ("a",), ("n-x",)]
    mails = [(" a@b.co ",), ("a@b",), ("a b@c.d",), (None,)]
    assert values(spark, [text.valid_email(F.col("s"))], mails, "s string") == [(True,), (False,), (False,), (False,)]
    links = [("https://x/folders/Ab_9-z?y",), (" raw ",), (None,)]
    assert values(spark, [text.folder_id(F.col("s"))], links, "s string") == [("Ab_9-z",), ("raw",), ("",)]
    urls = [("/a.png",), ("a.png",), ("HTTPS://x/y",), ("",), (None,)]
    assert [v for v, in values(spark, [text.absolute_url(F.col("s"), "http://b/")], urls, "s string")] == [
        "http://b/a.png", "http://b/a.png", "HTTPS://x/y", "", ""]


def test_fonts_first_of_a_name_wins(spark):
    snippet = "href='https://f/css2?family=DM+Sans:wght@1&family=Roboto&family=DM+Sans:ital&display=swap'"
    df = spark.createDataFrame([(snippet,)], "s string").select(F.inline(text.font_families(F.col("s"))))
    assert [tuple(r) for r in df.collect()] == [("DM Sans", "DM+Sans:wght@1"), ("Roboto", "Roboto")]


def test_known_hashes_and_money(spark):
    rows = spark.createDataFrame([("a",), ("foobar",), ("",)], "s string")
    got = [f"{r[0]:08X}" for r in rows.select(hashing.fnv1a(F.col("s"))).collect()]
    assert got == ["E40C292C", "BF9CF968", "811C9DC5"]
    df = spark.sql("select cast(10 as decimal(10,2)) p, cast(6.67 as decimal(10,2)) d, cast(0 as decimal(10,2)) z,"
                   " cast(33.33 as decimal(5,2)) pct")
    row = df.select(
        money.implied_discount_percent(F.col("p"), F.col("d")), money.implied_discount_percent(F.col("z"), F.col("d")),
        money.discount_price(F.col("p"), F.col("pct")), money.scaled(F.col("p"), F.col("d"), F.col("z")),
        money.bill_ratio_bp(F.col("d"), F.col("p")),
    ).first()
    assert [float(v) for v in row] == [33.3, 0.0, 6.67, 0.0, 6670.0]


def test_changes(make, spark):
    base = make("id bigint, name string, email string", "", (1, "a", "x"), (2, "b", "y"), (3, "c", "z"))
    patch = make("id bigint, has_name boolean, name string, has_email boolean, email string", "",
                 (1, False, None, True, None), (2, True, "B", False, "no"))
    assert table(changes.partial_update(base, patch, "id", ["name", "email"])) == [
        (1, "a", None), (2, "B", "y"), (3, "c", "z")]
    cur = make("k bigint, v string, n int", "", (1, "old", 5), (2, "keep", 5))
    new = make("k bigint, v string, n int", "", (1, "new", 3), (3, "add", 3))
    out = changes.upsert_latest(cur, new, ["k"], ["v"], {"n": F.lit(0)})
    assert table(out) == [(1, "new", 0), (2, "keep", 5), (3, "add", 0)]
    missing = changes.insert_missing(cur, make("k bigint, v string, n int", "", (2, "x", 1), (4, "b", 1), (4, "a", 2)), ["k"], ["v"])
    assert table(missing) == [(4, "a", 2)]
    assert changes.insert_if_empty(cur, new).count() == 0 and changes.insert_if_empty(cur.where("k > 9"), new).count() == 2
    shaped = changes.conform(base, {"id": "bigint", "full": "string", "flag": "boolean"}, {"flag": True}, {"name": "full"})
    assert table(shaped) == [(1, "a", True), (2, "b", True), (3, "c", True)]


def test_lists_of_keys(make):
    rows = make("g string, k string, p double", "", ("ok", "a", 1.0), ("ok", "b", 0.0), ("twice", "a", 1.0), ("twice", "a", 2.0),
                ("twice", "b", 1.0), ("short", "a", 1.0), ("extra", "a", 1.0), ("extra", "b", 1.0), ("extra", "c", 1.0),
                ("half", "a", 1.0), ("half", "b", 1.5))
    got = dict(table(quality.permutation_check(rows, "g", "k", "p", ["a", "b"])))
    assert got == {"ok": True, "twice": False, "short": False, "extra": False, "half": False}


def test_references(make):
    kids = make("id bigint, p bigint", "", (1, 1), (2, 9), (3, None))
    parents = make("id bigint", "", (1,))
    assert table(quality.orphans(kids, "p", parents), "id") == [(2,)]
    assert table(quality.set_null(kids, "p", parents)) == [(1, 1), (2, None), (3, None)]
    assert table(quality.cascade(kids, "p", parents)) == [(1, 1)]


def test_latest_and_earliest(make):
    rows = make("k bigint, t bigint, v string", "", (1, 1, "a"), (1, 2, "b"), (2, 5, None))
    assert table(ranking.latest_per_key(rows, ["k"], ["t"])) == [(1, 2, "b"), (2, 5, None)]
    assert table(ranking.earliest_per_key(rows, ["k"], ["t"])) == [(1, 1, "a"), (2, 5, None)]


def test_holds_and_toggles(make, shop):
    holds = make("pos_holds", "id staff_id customer_id items note created_at",
                 (1, 1, 2, '[{"product_id": 5, "quantity": 2, "x": 1}, {"product_id": 6}]', None, "2024-01-01 00:00:00"))
    assert table(orders.hold_lines(holds)) == [(1, 1, 5, 2), (1, 2, 6, None)]
    assert orders.holds_list(holds, shop).first().customer_name == "Ann"
    taps = make("o bigint, p bigint", "", (1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 1))
    assert table(changes.toggled_on(taps, ["o", "p"]), "o", "p") == [(1, 2), (2, 1)]
