from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, table
from tillbook.session import cut_lineage
from tillbook.sources import generate, shop as shops, sinks, testbed
from tillbook.sources.schema import TABLES, struct_of


@pytest.fixture(scope="module")
def trade(spark):
    return testbed.trade(spark, SF)


def test_append_then_reload_one_partition(spark, tmp_path, make):
    path = str(tmp_path / "t")
    rows = make("orders", "id status", (1, "pending"), (2, "return"))
    sinks.reload(rows, path, partition_by="status")
    sinks.append_rows(make("orders", "id status", (3, "return")), path, partition_by="status")
    sinks.reload(make("orders", "id status", (4, "pending")), path, partition_by="status")
    assert table(spark.read.parquet(path), "id", "status") == [(2, "return"), (3, "return"), (4, "pending")]
    sinks.reload(rows, path + "2")
    sinks.reload(rows.limit(1), path + "2")
    assert spark.read.parquet(path + "2").count() == 1


def test_files_round_trip_with_given_schema(spark, tmp_path, make):
    rows = make("categories", "", (1, "A", "a", True, "2024-01-01 00:00:00"))
    rows.write.parquet(str(tmp_path / "p" / "categories"))
    rows.write.json(str(tmp_path / "j" / "categories"))
    for fmt in ("p", "j"):
        kind = {"p": "parquet", "j": "json"}[fmt]
        back = shops.from_files(spark, str(tmp_path / fmt), kind).categories
        assert back.schema == struct_of("categories") and table(back) == table(rows)
    assert set(TABLES) >= {"orders", "order_items", "sales", "sale_items", "pos_shifts"}


def test_export_is_limited_to_known_tables(spark, tmp_path, trade):
    with pytest.raises(ValueError):
        sinks.export_tables(trade, str(tmp_path), "s", ["sale_items"])
    paths = sinks.export_tables(trade, str(tmp_path / "x"), "20240101_000000", ["users"])
    assert spark.read.parquet(paths[0]).count() == trade.users.count()
    structure = sinks.export_tables(trade, str(tmp_path / "y"), "20240101_000000", ["users"], structure_only=True)
    assert '"shop_name"' in spark.read.text(structure[0]).first().value


def test_bucketed_copies_join_without_a_shuffle(spark, trade):
    spark.sql("CREATE DATABASE IF NOT EXISTS depot")
    sinks.save_bucketed(trade, "depot", 4, ["orders", "order_items"])
    depot = shops.from_catalog(spark, "depot")
    heads = depot.orders.select(F.col("id").alias("order_id"), "status")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = depot.order_items.join(heads, "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert joined.count() == trade.order_items.join(trade.orders, F.col("order_id") == trade.orders["id"]).count()


def test_months_are_folders(spark, tmp_path, trade):
    path = str(tmp_path / "m")
    sinks.save_by_month(trade.orders, path)
    back = spark.read.parquet(path)
    assert back.count() == trade.orders.count()
    assert back.where("month <> date_format(created_at, 'yyyy-MM')").count() == 0


def test_literal_rows(spark):
    df = sinks.literal_rows(spark, ["id", "name"], [(1, "it's"), (2, None), (3, "a\\b")])
    assert table(df) == [(1, "it's"), (2, None), (3, "a\\b")]


def test_topup_fills_every_category(trade):
    new = generate.topup_products(trade, ["Small", "Large", "Blue"], 20)
    sizes = trade.products.select("category_id").unionByName(new.select("category_id"))
    active = trade.categories.where("is_active").select(F.col("id").alias("category_id"))
    low = sizes.join(active, "category_id", "left_semi").groupBy("category_id").count().agg(F.min("count")).first()[0]
    assert low == 20
    codes = [int(r.product_code) for r in new.collect()]
    top = generate.max_numeric_code(trade.products).first().max_code
    assert sorted(codes) == list(range(max(2000, top + 1), max(2000, top + 1) + len(codes)))


def test_history_is_seeded_and_within_bounds(trade):
    orders, items = generate.demo_orders(trade, trade.users, "2024-01-31 00:00:00", days=20)
    again, _ = generate.demo_orders(trade, trade.users, "2024-01-31 00:00:00", days=20)
    assert table(orders, "order_key", "total_amount") == table(again, "order_key", "total_amount")
    other, _ = generate.demo_orders(trade, trade.users, "2024-01-31 00:00:00", days=20, seed=1)
    assert table(orders, "order_key", "status") != table(other, "order_key", "status")
    per_day = orders.groupBy("store_id", F.element_at(F.split("order_key", "-"), 2)).count()
    low, high = per_day.agg(F.min("count"), F.max("count")).first()
    assert low >= 1 and high <= 6 and per_day.count() == trade.users.count() * 21
    lines = items.groupBy("order_key").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("d"),
                                           F.sum(F.col("price") * F.col("quantity")).alias("t"))
    wrong = lines.join(orders, "order_key").where("n <> d or n > 3 or t <> total_amount")
    assert wrong.count() == 0 and items.where("quantity not between 1 and 3").count() == 0
    share = orders.where("status = 'successful'").count() / orders.count()
    assert 0.7 < share < 0.8


def test_weighted_slots(spark):
    items = spark.createDataFrame([(1, 2), (2, 0), (5, 3)], "id long, w long")
    assert table(generate.weighted_slots(items, "id", F.col("w"))) == [(1, 0), (1, 1), (5, 2), (5, 3), (5, 4)]


def test_picks_by_decimal_weights(spark):
    weights = [(1, "0.25"), (2, None), (3, "0.00"), (4, "1000000.50"), (7, "0.01"), (9, "-3.00")]
    items = spark.createDataFrame(weights, "id long, w string").select("id", F.col("w").cast("decimal(12,2)").alias("w"))
    ranges = generate.weighted_ranges(items, "id", F.col("w"))
    assert table(ranges) == [(1, 0.0, 0.25), (4, 0.25, 1000000.75), (7, 1000000.75, 1000000.76)]
    places = ["0.00", "0.24", "0.25", "0.25", "500000.00", "1000000.74", "1000000.75", "1000000.76", "-0.01", None]
    requests = spark.createDataFrame([(i, p) for i, p in enumerate(places)] + [(4, "500000.00")], "n long, start string")
    picked = generate.pick_by_weight(requests, F.col("start").cast("decimal(12,2)"), ranges, "id")
    assert picked.columns == ["n", "start", "id"]
    assert table(picked, "n", "id") == [
        (0, 1), (1, 1), (2, 4), (3, 4), (4, 4), (4, 4), (5, 4), (6, 7), (7, None), (8, None), (9, None)]
    assert table(generate.pick_by_weight(requests.where("n = 4"), F.lit(0), ranges.limit(0), "id"), "n", "id") == [(4, None), (4, None)]


def test_an_item_that_all_requests_get_is_spread(spark):
    requests = spark.range(20_000)
    ranges = generate.weighted_ranges(spark.createDataFrame([(1, 1), (2, 10)], "id long, w long"), "id", F.col("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # pieces this small would be put together
    try:
        picked = generate.pick_by_weight(requests.withColumnRenamed("id", "n"), F.lit(3), ranges, "id")
        sizes = [r[1] for r in picked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 15_000 and picked.where("id = 2").count() == 20_000


def test_history_joins_nothing_by_broadcast(spark):
    """What days and draws are exploded from is small, they are not: no join may send them to every task."""
    shop = testbed.trade(spark, SF)
    orders, items = generate.demo_orders(shop, shop.users, "2024-01-31 00:00:00", days=3)
    merges = [df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") for df in (orders, items)]
    # products; for orders, customers and totals as well
    assert merges[1] >= 1 and merges[0] >= 3
    slots = generate.weighted_slots(shop.products, "id", F.lit(2)).withColumnRenamed("id", "item")
    picked = generate.weighted_pick(spark.range(50), F.col("id"), slots, F.lit(50))
    assert "SortMergeJoin" in picked._jdf.queryExecution().executedPlan().toString() and picked.count() == 50


def test_history_is_dealt_and_drawn_without_writing_it(spark, trade, monkeypatch):
    """Stores of one file are dealt over tasks before their orders are made; only orders with draws close together are written."""
    written = []
    monkeypatch.setattr(generate, "cut_lineage", lambda df: written.append((kept := cut_lineage(df)).count()) or kept)
    orders, items = generate.demo_orders(trade, trade.users.coalesce(1), "2024-01-31 00:00:00", days=60)
    assert sum(written) < orders.count() / 2
    for df in (orders, items):
        made, below = df._jdf.queryExecution().executedPlan().toString().split("Generate explode(", 1)
        assert "RoundRobinPartitioning" in below and "Generate explode(" in below


def _hash(text: str) -> int:
    h = 2166136261
    for ch in text:
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    return h


def _history(stores, products, customers, days: int):
    """The history order by order, draw by draw."""
    key = lambda *parts: ":".join(str(p) for p in parts if p is not None)
    chance = lambda *parts: _hash(key(42, *parts))
    on_offer = sorted((p for p in products if p[4]), key=lambda p: (p[0] is not None, p[0] or 0))
    slots = [p[0] for p in on_offer for _ in range(chance("popularity", p[0]) % 8 + 1)]
    orders, items = [], set()
    for store in stores if customers else []:
        for ago in range(days + 1):
            for n in range(1, chance("orders", store, ago) % 6 + 2):
                name = "-".join(str(p) for p in (store, ago, n) if p is not None)
                wanted, drawn, d = min(chance("lines", store, ago, n) % 3 + 1, len(set(slots))), [], 0
                while len(drawn) < wanted:
                    d += 1
                    one = slots[chance("product", name, d) % len(slots)]
                    drawn += [one] if one not in drawn else []
                own = [(name, i, p[0], p[1], p[2] if not p[3] else round(p[2] * (100 - p[3]) / 100), chance("units", name, one) % 3 + 1)
                       for i, one in enumerate(drawn, 1) for p in on_offer if one is not None and p[0] == one]
                items |= set(own)
                who = sorted(customers)[chance("customer", store, ago, n) % len(customers)]
                orders += [(name, store, who, sum((x[4] or 0) * x[5] for x in own))] if own else []
    return sorted(orders, key=str), sorted(items, key=str)


STOCK = [(1, "a", 10.0, 0.0, True), (2, "b", 20.0, 10.0, True), (2, "b again", 5.0, 0.0, True), (3, "shut", 1.0, 0.0, False),
         (None, "no id", 7.0, 0.0, True), (None, "no id", 7.0, 0.0, True), (40, None, None, 0.0, True)]


@pytest.mark.parametrize("stock, stores", [
    (STOCK, [7, 7, None, 12]), ([*STOCK, (-5, "below", 3.0, 0.0, True)], ["x-1", "", None]),
    ([(i, f"p{i}", float(i), 0.0, True) for i in range(90, 130)], [None, None, 0, 1234567890123]), (STOCK[1:3], [3]), ([], [1]), (STOCK[:2], [1]),
])
def test_history_draw_by_draw(spark, make, shop_of, stock, stores):
    """Also with ids that come twice or not at all, and with fewer products than an order has lines."""
    products = make("products", "id name sale_price discount_percent is_active", *stock)
    customers = [5, 9, 9, 30] if stock != STOCK[:2] else []
    shop = shop_of(products=products, customers=make("customers", "id", *[(c,) for c in customers]))
    kind = "string" if isinstance(stores[0], str) else "bigint"
    orders, items = generate.demo_orders(shop, spark.createDataFrame([(s,) for s in stores], f"id {kind}"), "2024-01-31 00:00:00", days=12)
    want, lines = _history(stores, stock, customers, 12)
    got = table(items, "order_key", "line_no", "product_id", "product_name", "price", "quantity")
    assert sorted(got, key=str) == lines and bool(lines) == bool(stock and customers)
    assert sorted(table(orders, "order_key", "store_id", "customer_id", "total_amount"), key=str) == want
