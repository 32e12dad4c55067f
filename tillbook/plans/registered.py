"""Every report and operator as a named query over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.common import comparable, count_where, instant, money_sum
from tillbook.functions import hashing, money, text
from tillbook.operators import allocation, changes, nesting, quality, ranking, running, trigrams
from tillbook.operators.cooldown import accepted_requests
from tillbook.plans import (
    catalog, checkout, dashboard, daybook, identity, lifecycle, orders, pricing, rankings, rollups, seller,
    stock,
)
from tillbook.session import shared_dir
from tillbook.sources import generate, sinks, testbed
from tillbook.sources.schema import (
    ANONYMOUS_CUSTOMER, ANONYMOUS_SELLER, CASH_OUT_REASONS, ORDER_STATUSES, ROLES, SALE_STATUSES,
)
from tillbook.streaming import codes, live, runner, shifts
from tillbook.streaming import sources as stream_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

AS_OF = testbed.TRADE_AS_OF
BOOK_AS_OF = testbed.DAYBOOK_AS_OF
FROM, TO = testbed.DAYBOOK_FROM, testbed.DAYBOOK_TO


def query(fn: Callable[[SparkSession, str], DataFrame]):
    """Registers a query; its output is made comparable across engines."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
    return fn


def trade_query(fn):
    """Registers a query over the order and till tables."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: comparable(fn(testbed.trade(spark, sf_dir)))
    return fn


def book_query(fn):
    """Registers a query over the day book."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: comparable(fn(testbed.daybook(spark, sf_dir)))
    return fn


# --- rankings ---------------------------------------------------------------

PRODUCT = ["id", "name", "slug", "product_code", "sale_price", "discount_price", "stock"]


@trade_query
def combined_items(shop):
    return rankings.combined_items(shop)


@trade_query
def units_by_entity(shop):
    products = shop.products.select(F.col("id").alias("product_id"), "category_id", "subcategory_id")
    return (
        rankings.product_units(shop).join(products, "product_id")
        .rollup("category_id", "subcategory_id", "product_id")
        .agg(F.sum("total_sold").alias("total_sold"))
    )


@trade_query
def best_selling(shop):
    cols = [*PRODUCT, "category_name", "category_slug", "subcategory_name", "subcategory_slug", "total_sold"]
    return rankings.best_selling(shop).select(*cols)


@trade_query
def featured_products(shop):
    return rankings.featured_products(shop, AS_OF).select(*PRODUCT, "category_name", "subcategory_name", "total_sold")


@trade_query
def hot_categories(shop):
    return rankings.hot_categories(shop, AS_OF)


@trade_query
def hot_subcategories(shop):
    return rankings.hot_subcategories(shop, AS_OF)


def _rolled_units(shop):
    """Units of the last week from a table per day, written before the tills' last three days came in."""
    path = _scratch(shop.spark)
    late = F.col("created_at") >= instant(AS_OF) - F.expr("INTERVAL 3 DAYS")
    rollups.refresh_units(shop.replace(sales=shop.sales.where(~late)), path)
    changed = shop.sales.where(late).select(F.to_date("created_at").alias("day")).distinct()
    rollups.refresh_units(shop, path, [r["day"] for r in changed.collect()])
    return rollups.units_since(shop, path, AS_OF)


@trade_query
def featured_from_days(shop):
    out = rankings.featured_products(shop, AS_OF, units=_rolled_units(shop))
    return out.select(*PRODUCT, "category_name", "subcategory_name", "total_sold")


@trade_query
def hot_categories_from_days(shop):
    return rankings.hot_categories(shop, AS_OF, units=_rolled_units(shop))


@trade_query
def hot_subcategories_from_days(shop):
    return rankings.hot_subcategories(shop, AS_OF, units=_rolled_units(shop))


@trade_query
def featured_categories_ranked(shop):
    return rankings.featured_categories_ranked(shop)


@trade_query
def top_k_or_fallback(shop):
    """Featured products as of a day after the last sale: the fallback answers."""
    out = rankings.featured_products(shop, "2002-01-01 00:00:00")
    return out.select(*PRODUCT, "category_name", "subcategory_name", "total_sold")


@trade_query
def net_units(shop):
    return rankings.product_units(shop, net=True)


# --- dashboard --------------------------------------------------------------


@trade_query
def dash_revenue(shop):
    return dashboard.revenue(shop)


@trade_query
def dash_counts(shop):
    return dashboard.counts(shop)


@trade_query
def dash_revenue_by_day(shop):
    return dashboard.revenue_by_day(shop, AS_OF)


@trade_query
def dash_status_breakdown(shop):
    return dashboard.status_breakdown(dashboard.retail_orders(shop))


@trade_query
def dash_top_products(shop):
    return dashboard.dash_top_products(shop).select(*PRODUCT, "category_name", "category_slug", "total_sold")


@trade_query
def dash_top_categories(shop):
    return dashboard.top_categories(shop)


@trade_query
def dash_top_subcategories(shop):
    return dashboard.top_subcategories(shop)


@trade_query
def dash_recent_orders(shop):
    return dashboard.recent_orders(shop)


# --- wholesale --------------------------------------------------------------


@trade_query
def seller_totals(shop):
    return seller.totals(shop)


@trade_query
def seller_cost_by_day(shop):
    return seller.cost_by_day(shop, AS_OF)


@trade_query
def seller_top_products(shop):
    return seller.top_products(shop)


@trade_query
def seller_status(shop):
    return seller.seller_status(shop)


# --- day book ---------------------------------------------------------------


@book_query
def z_totals(shop):
    return daybook.z_totals(shop, FROM, TO)


@book_query
def totals_and_days(shop):
    return daybook.totals_and_days(shop, FROM, TO)


@book_query
def z_payments(shop):
    return daybook.z_payments(shop, FROM, TO)


@book_query
def z_days(shop):
    return daybook.z_days(shop, FROM, TO)


@book_query
def z_days_calendar(shop):
    return daybook.z_days(shop, "2023-12-28", "2024-02-02", mode="calendar")


@book_query
def date_spine(shop):
    """Staff without a sale on a day of the calendar, counted per day."""
    days = daybook.date_spine(shop.spark, "2023-12-28", "2024-02-02")
    sold = shop.sales.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("sales"))
    return days.join(sold, "day", "left").withColumn("sales", F.coalesce("sales", F.lit(0)))


@book_query
def z_shifts(shop):
    return daybook.z_shifts(shop, FROM, TO)


@book_query
def staff_sales(shop):
    return daybook.staff_sales(shop, FROM, TO)


@book_query
def sum_per_shift(shop):
    out = daybook.cash_out_per_shift(shop).withColumnRenamed("shift_id", "id")
    return (
        shop.pos_shifts.select("id").join(out, "id", "left")
        .withColumn("cash_out_total", F.coalesce("cash_out_total", F.lit(0)).cast("decimal(20,2)"))
    )


@book_query
def payment_breakdown(shop):
    return daybook.payments_by_shift(shop)


@book_query
def expected_cash(shop):
    return daybook.expected_cash(shop)


@book_query
def shift_variance(shop):
    return daybook.shift_variance(shop)


@book_query
def x_report(shop):
    pay = F.transform(
        "payments", lambda p: F.concat_ws(":", p["method"], (p["total"] * 100).cast("bigint").cast("string"))
    )
    return daybook.x_report(shop).withColumn("payments", F.concat_ws("|", pay))


@book_query
def current_per_key(shop):
    return daybook.current_shift(shop).select("staff_id", "id", "opened_at", "opening_cash")


@book_query
def one_open_shift(shop):
    """Staff with several shifts open at once, were none of them ever closed."""
    never_closed = shop.pos_shifts.withColumn("status", F.lit("open"))
    return daybook.double_open_shifts(shop.replace(pos_shifts=never_closed))


@book_query
def cash_outs_list(shop):
    return daybook.cash_outs(shop)


@book_query
def shift_cash_balance(shop):
    return daybook.cash_balance(shop)


@book_query
def cash_out_overdraw(shop):
    """Cash-outs beyond what the till had taken, were it opened empty."""
    empty = shop.pos_shifts.withColumn("opening_cash", F.lit(0).cast("decimal(10,2)"))
    return daybook.overdrawn_cash_outs(shop.replace(pos_shifts=empty))


@book_query
def cash_out_decisions(shop):
    """Which cash-outs a till opened empty could cover, refused ones leaving it as it was."""
    empty = shop.pos_shifts.withColumn("opening_cash", F.lit(0).cast("decimal(10,2)"))
    out = daybook.settled_cash_events(shop.replace(pos_shifts=empty))
    return out.select("shift_id", "kind", "id", "delta", "admitted")


# --- scans, sources, sinks --------------------------------------------------


@trade_query
def scan_active(shop):
    return catalog.content_list(shop.categories, [F.col("name"), F.col("id")])


@query
def scan_ordered_small(spark, sf):
    """Nations in the role of the font list: by name."""
    return testbed.raw(spark, sf, "nation").selectExpr(
        "n_nationkey as id", "n_name as name", "concat(n_name, ':wght@', n_regionkey) as family_param"
    ).orderBy("name")


@query
def point_lookup(spark, sf):
    """Products by slug, for the slugs of everything that ever came back."""
    shop = testbed.trade(spark, sf)
    back = shop.order_items.where("returned_quantity > 0").select(F.col("product_id").alias("id")).distinct()
    slugs = shop.products.join(back, "id", "left_semi").select("slug")
    return catalog.product_by_slug(shop, slugs).select("id", "slug", "name", "category_name", "subcategory_name")


@trade_query
def bound_parameters(shop):
    return shop.spark.sql(
        "SELECT status, count(*) AS n FROM {orders} WHERE status IN (:first, :second)"
        " AND created_at >= cast(:since AS timestamp_ntz) GROUP BY status",
        args={"first": "successful", "second": "return", "since": "1996-01-01 00:00:00"},
        orders=shop.orders,
    )


@trade_query
def literal_rows(shop):
    """Accounts per literal role, roles without accounts included."""
    roles = sinks.literal_rows(shop.spark, ["id", "name"], list(enumerate(ROLES, start=1)))
    users = shop.users.groupBy(F.col("role_id").alias("id")).agg(F.count(F.lit(1)).alias("users"))
    return roles.join(users, "id", "left").withColumn("users", F.coalesce("users", F.lit(0)))


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@trade_query
def append_rows(shop):
    """Orders written status by status into one table, read back."""
    path = _scratch(shop.spark)
    for status in ORDER_STATUSES:
        sinks.append_rows(shop.orders.where(F.col("status") == status), path)
    out = shop.spark.read.parquet(path)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total"))


@trade_query
def truncate_reload(shop):
    """All orders by status, then one status reloaded without its unpaid half: only that one changes."""
    path = _scratch(shop.spark)
    sinks.reload(shop.orders, path, partition_by="status")
    sinks.reload(shop.orders.where("status = 'pending' and customer_id is not null"), path, partition_by="status")
    out = shop.spark.read.parquet(path)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total"))


@book_query
def insert_select_backfill(shop):
    """A payment per sale for a shop without payments; nothing is added where some exist."""
    rows = lifecycle.payments_from_sales(shop.sales)
    none, some = shop.sale_payments.where("amount < 0"), shop.sale_payments
    return (
        changes.insert_if_empty(none, rows).withColumn("target", F.lit("empty"))
        .unionByName(changes.insert_if_empty(some, rows).withColumn("target", F.lit("filled")))
    )


@book_query
def upsert_latest(shop):
    """Codes per (user, purpose): sign-ups first, later views replace them and reset the attempts."""
    def codes(kind):
        return shop.events.where(F.col("event_type") == kind).select(
            F.col("user_id").alias("identifier"), (F.col("k") % 3).alias("purpose"),
            F.col("event_id").alias("payload"), (F.col("k") % 5).alias("attempts"), "ts",
        )

    current = ranking.latest_per_key(codes("signup"), ["identifier", "purpose"], ["ts", "payload"])
    return changes.upsert_latest(
        current, codes("view"), ["identifier", "purpose"], ["ts", "payload"], {"attempts": F.lit(0)}
    )


@trade_query
def insert_missing(shop):
    """Customers' phones that no staff account has."""
    existing = shop.users.select("phone")
    candidates = shop.customers.select(F.col("whatsapp_number").alias("phone"), "id", "name")
    return changes.insert_missing(existing, candidates, ["phone"], ["id"])


@trade_query
def export_tables(shop):
    """Rows of each exported table, read back from the export."""
    folder = _scratch(shop.spark)
    paths = sinks.export_tables(shop, folder, "20240131_000000")
    counted = [
        shop.spark.read.parquet(p).select(F.lit(p.rsplit("/", 1)[1]).alias("file")) for p in paths
    ]
    pile = counted[0]
    for c in counted[1:]:
        pile = pile.unionByName(c)
    return pile.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def json_column(spark, sf):
    parsed = testbed.raw(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("written"))


@query
def gen_topup_products(spark, sf):
    """Names are the category's with a part type, of which there are a few."""
    types = testbed.raw(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()
    return generate.topup_products(testbed.trade(spark, sf), [t["p_type"] for t in types], target=None)


@trade_query
def gen_demo_orders(shop):
    orders, _ = generate.demo_orders(shop, shop.users, AS_OF)
    return orders


@trade_query
def gen_demo_lines(shop):
    _, items = generate.demo_orders(shop, shop.users, AS_OF)
    return items


# --- projections, filters, predicates ---------------------------------------


@trade_query
def star_join(shop):
    return rankings.with_names(shop.products, shop)


@book_query
def dynamic_filter(shop):
    where = orders.sale_filters(role="Admin", staff_id=4, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return shop.sales.where(where).select("id", "staff_id", "total_amount", "created_at")


@book_query
def not_equal(shop):
    return shop.sales.where("status <> 'voided'").select("id", "status")


@trade_query
def in_list(shop):
    return shop.orders.where(F.col("status").isin("return", "cancelled")).select("id", "status")


@trade_query
def search_products(shop):
    named = rankings.with_names(shop.products.where("is_active"), shop)
    return catalog.search_products(named, "RïnG").select("id", "name", "category_name", "subcategory_name")


@trade_query
def search_wildcards(shop):
    """``%`` and ``_`` typed by the user work as wildcards."""
    named = rankings.with_names(shop.products.where("is_active"), shop)
    return catalog.search_products(named, "r_d%w").select("id", "name", "product_code")


@trade_query
def search_customers(shop):
    return catalog.customers_list(shop, search="0001")


@trade_query
def search_products_indexed(shop):
    """The search by an index of trigrams, written for all products before."""
    path, named = _scratch(shop.spark), rankings.with_names(shop.products.where("is_active"), shop)
    trigrams.write_index(rankings.with_names(shop.products, shop), "id", catalog.PRODUCT_TEXTS, path)
    return catalog.find_products(named, "RïnG", path).select("id", "name", "category_name", "subcategory_name")


@trade_query
def search_customers_indexed(shop):
    path = _scratch(shop.spark)
    trigrams.write_index(shop.customers, "id", catalog.CUSTOMER_TEXTS, path)
    return catalog.customers_list(shop, search="0001", index=path)


@trade_query
def customers_all(shop):
    return catalog.customers_list(shop, active=False)


@book_query
def date_between(shop):
    return shop.sales.where(daybook.on_days("2024-01-03", "2024-01-28")).select("id", "created_at")


@book_query
def ts_range(shop):
    where = orders.sale_filters(start="2024-01-03", end="2024-01-28")
    return shop.sales.where(where).select("id", "created_at")


@trade_query
def trailing_days(shop):
    return shop.orders.where(rankings.since(AS_OF, 30)).select("id", "created_at")


@trade_query
def null_checks(shop):
    return shop.orders.agg(
        F.count(F.when(F.col("customer_id").isNotNull(), 1)).alias("retail"),
        F.count(F.when(F.col("customer_id").isNull(), 1)).alias("staff"),
    )


@trade_query
def active_flag(shop):
    asked = catalog.active_flag(shop.products, "Admin", "0").withColumn("viewer", F.lit("Admin"))
    public = catalog.active_flag(shop.products, None, "0").withColumn("viewer", F.lit("public"))
    return asked.unionByName(public).select("viewer", "id", "is_active")


@trade_query
def stock_visibility(shop):
    views = {
        "public": catalog.stock_visibility(None, False),
        "staff": catalog.stock_visibility("Staff", True),
        "low": catalog.stock_visibility("Admin", True, low_stock=True),
    }
    return shop.products.agg(*[F.count(F.when(seen, 1)).alias(name) for name, seen in views.items()])


@trade_query
def low_stock(shop):
    return catalog.product_list(shop, role="Admin", staff=True, low_stock=True).select("id", "name", "stock", "product_code")


@trade_query
def exclude_sentinels(shop):
    """Accounts that are real people, customers and staff."""
    customers = shop.customers.where(F.col("whatsapp_number") != ANONYMOUS_CUSTOMER).select("id", F.lit("customer").alias("kind"))
    staff = shop.users.where(F.col("email") != ANONYMOUS_SELLER).select("id", F.lit("staff").alias("kind"))
    return customers.unionByName(staff)


@trade_query
def regex_filter(shop):
    return shop.products.where(F.col("product_code").rlike(text.DIGITS_PATTERN)).select("id", "product_code")


@trade_query
def mask_product_seller(shop):
    return catalog.mask_columns(rankings.with_names(shop.products, shop), "product", "Seller")


@trade_query
def mask_product_staff(shop):
    return catalog.mask_columns(shop.products, "product", "Staff")


@trade_query
def mask_analytics_staff(shop):
    return catalog.mask_columns(shop.products, "analytics", "Staff")


@trade_query
def mask_wishlist_seller(shop):
    return catalog.mask_columns(shop.products, "wishlist", "Seller")


@trade_query
def mask_order_items_public(shop):
    return catalog.mask_columns(shop.order_items, "order_items", None)


@trade_query
def allowlist_projection(shop):
    named = rankings.with_names(shop.products.where("is_active"), shop)
    return catalog.allowlist(named, catalog.WHOLESALE_COLUMNS)


@book_query
def row_scope(shop):
    """Sales each viewer may see: staff their own, managers and the rest of the office all."""
    own = shop.sales.groupBy(F.col("staff_id").alias("id")).agg(F.count(F.lit(1)).alias("own"))
    everything = shop.sales.select(F.count(F.lit(1))).scalar()
    roles = shop.user_roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    viewers = shop.users.join(roles, "role_id").select("id", "role").join(own, "id", "left")
    visible = F.when(F.col("role") == "Staff", F.coalesce("own", F.lit(0))).otherwise(everything)
    return viewers.select("id", "role", visible.alias("visible"))


@book_query
def domain_check(shop):
    rules = {
        "amount": F.col("amount") > 0,
        "note": (F.col("reason") != "Other") | F.coalesce(text.is_filled(F.col("note")), F.lit(False)),
        "reason": F.col("reason").isin(*CASH_OUT_REASONS),
    }
    checked = quality.domain_check(shop.cash_movements, rules)
    return checked.select("id", "amount", "reason", F.concat_ws(",", "failed").alias("failed"))


@trade_query
def product_rules(shop):
    """Discount within 0 to 100, stock a whole number of at least 1; rejected rows with reasons."""
    rules = {
        "discount": quality.within(F.col("discount_percent"), 0, 100),
        "stock": quality.whole_at_least(F.col("stock"), 1),
    }
    _, rejected = quality.split_checked(quality.domain_check(shop.products, rules))
    return rejected.select("id", "stock", F.concat_ws(",", "failed").alias("failed"))


@trade_query
def valid_email(shop):
    mails = shop.customers.select("id", F.coalesce("email", "whatsapp_number").alias("email")).unionByName(
        shop.users.select("id", F.concat(F.lit(" "), "email").alias("email"))
    )
    return mails.select("id", "email", text.valid_email(F.col("email")).alias("valid"))


# --- joins ------------------------------------------------------------------


@trade_query
def fact_header_join(shop):
    heads = shop.orders.where("status = 'successful'").select(F.col("id").alias("order_id"), "created_at")
    return shop.order_items.join(heads, "order_id").select("id", "order_id", "product_id", "quantity", "created_at")


@trade_query
def dim_enrich(shop):
    return rankings.with_names(shop.products.select("id", "category_id", "subcategory_id"), shop)


@book_query
def staff_customer_enrich(shop):
    named = orders.with_staff_and_customer(shop.sales, shop)
    return named.select("id", "staff_id", "staff_name", "customer_id", "customer_name")


@trade_query
def zero_preserving_rank(shop):
    ranked = rankings.ranked_groups(shop, shop.subcategories, "subcategory_id", rankings.product_units(shop, AS_OF, 7))
    return ranked.select("id", "name", "total_sold")


@trade_query
def role_filtered_join(shop):
    return seller.seller_orders(shop).select("id", "user_id", "status", "total_amount")


@trade_query
def multi_party_coalesce(shop):
    return orders.with_parties(shop.orders, shop).select(
        "id", "customer_name", "customer_email", "customer_phone", "orderer_role"
    )


@trade_query
def lookup_join(shop):
    """Current price and stock beside every online line."""
    return stock.lines_in_stock(shop.order_items, shop.products).select("id", "product_id", "quantity", "in_stock")


@trade_query
def nest_children(shop):
    nested = nesting.nest_children(shop.orders, shop.order_items, "id", "order_id", ["product_id", "quantity"], "id")
    return nested.select("id", nesting.items_text(F.col("items"), "id", "quantity").alias("items"))


@trade_query
def key_conflicts(shop):
    """Is each category name, product name or subcategory name free of other rows?"""
    def judged(df, kind):
        # as typed by someone else: upper case, and with accents
        names = df.select("id", F.translate(F.upper("name"), "AEIOUN", "ÁÈÎÖÚÑ").alias("name"))
        out = quality.key_conflicts(names, [(df, "name")], "name")
        return out.select(F.lit(kind).alias("kind"), "id", "available")

    return (
        judged(shop.categories, "category").unionByName(judged(shop.subcategories, "subcategory"))
        .unionByName(judged(shop.products, "product"))
    )


@trade_query
def cross_table_conflicts(shop):
    """Staff phones must be free among other staff and among customers."""
    out = quality.key_conflicts(
        shop.users.select("id", "phone"), [(shop.users, "phone"), (shop.customers, "whatsapp_number")], "phone"
    )
    return out.select("id", "phone", "available")


@trade_query
def duplicate_names(shop):
    return quality.duplicate_keys(shop.products, text.key_of(F.col("name")))


@trade_query
def update_join(shop):
    return lifecycle.with_line_codes(shop.order_items, shop.products).select("id", "order_id", "product_code")


@trade_query
def referential_checks(shop):
    """What breaks, goes and stays when inactive categories are removed."""
    kept = shop.categories.where("is_active")
    subs = shop.subcategories.select("id", "category_id")
    products = shop.products.select("id", "category_id")
    return (
        quality.orphans(subs, "category_id", kept).withColumn("kind", F.lit("orphan"))
        .unionByName(quality.cascade(subs, "category_id", kept).withColumn("kind", F.lit("cascade")))
        .unionByName(quality.set_null(products, "category_id", kept).withColumn("kind", F.lit("set_null")))
    )


@trade_query
def wrong_parent(shop):
    """Products whose subcategory belongs to another category, had they moved one category up."""
    moved = shop.products.select("id", (F.col("category_id") % 25 + 1).alias("category_id"), "subcategory_id")
    owner = shop.subcategories.select(F.col("id").alias("subcategory_id"), F.col("category_id").alias("owner"))
    return moved.join(owner, "subcategory_id").where("owner <> category_id").select("id", "category_id", "owner")


def _wishes(spark, sf):
    toggles = testbed.events(spark, sf).where("event_type = 'view'").select(
        F.when(F.col("user_id") % 2 == 0, "customer").otherwise("staff").alias("owner_type"),
        F.col("user_id").alias("owner_id"), F.col("k").cast("bigint").alias("product_id"),
        F.col("ts").alias("created_at"),
    )
    return toggles


@query
def wishlist_join(spark, sf):
    shop = testbed.trade(spark, sf)
    newest = ranking.latest_per_key(_wishes(spark, sf), ["owner_type", "owner_id", "product_id"], ["created_at"])
    out = catalog.wishlist(shop, newest)
    return out.select("owner_type", "owner_id", "product_id", "created_at", "name", "sale_price", "category_name", "category_slug")


@query
def first_source_wins(spark, sf):
    """Who sent each event, by a phone number made of the user id."""
    shop = testbed.trade(spark, sf)
    requests = testbed.events(spark, sf).select(
        "event_id", F.concat(F.lit("94"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("login")
    )
    return identity.resolve(requests, "login", shop)


# --- aggregations -----------------------------------------------------------


@book_query
def global_sum(shop):
    return shop.sale_payments.agg(money_sum("amount").alias("paid"))


@book_query
def filtered_count(shop):
    return shop.sales.agg(*[count_where(F.col("status") == s).alias(s) for s in SALE_STATUSES])


@trade_query
def status_breakdown(shop):
    return dashboard.status_breakdown(shop.orders)


@trade_query
def sum_by_day(shop):
    return dashboard.earned(shop).groupBy(F.to_date("created_at").alias("day")).agg(money_sum("total_amount").alias("revenue"))


@trade_query
def sum_of_product(shop):
    units = shop.order_items.groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("units"))
    costs = shop.products.select(F.col("id").alias("product_id"), "purchase_price")
    return units.join(costs, "product_id").agg(
        money_sum((F.col("units") * F.col("purchase_price")).cast("decimal(24,2)")).alias("cost")
    )


@book_query
def conditional_agg(shop):
    return shop.sales.groupBy("staff_id").agg(
        *[count_where(F.col("status") == s).alias(f"{s}_count") for s in SALE_STATUSES],
        *[money_sum("total_amount", F.col("status") == s).alias(f"{s}_total") for s in SALE_STATUSES],
    )


@trade_query
def sum_by_day_staff(shop):
    return (
        daybook.with_staff(shop.sales.where("status = 'completed'"), shop)
        .groupBy(F.to_date("created_at").alias("day"), "staff_id", "staff_name")
        .agg(F.count(F.lit(1)).alias("n"), money_sum("total_amount").alias("total"))
    )


@book_query
def staff_day_totals(shop):
    return daybook.staff_sales(shop, FROM, TO).drop("staff_name")


@trade_query
def max_numeric_code(shop):
    return generate.max_numeric_code(shop.products)


@trade_query
def all_rows_satisfy(shop):
    back = F.col("returned_quantity") >= F.col("quantity")
    return quality.all_rows_satisfy(shop.order_items, "order_id", back, "all_back")


@trade_query
def distinct_values(shop):
    days = shop.sales.select(F.to_date("created_at").cast("string").alias("value"))
    names = shop.products.select(F.col("name").alias("value"))
    return days.unionByName(names).distinct()


@trade_query
def completeness(shop):
    sections = {"contact": ["email", "phone"], "shop": ["shop_name", "city"], "status": ["status"]}
    return quality.completeness(shop.users, sections, "id")


@trade_query
def column_fill(shop):
    return quality.column_fill(shop.customers.select("id", "name", "whatsapp_number", "email"))


@trade_query
def existence_count(shop):
    return generate.children_per_parent(shop.orders.select("id"), shop.order_items, "order_id")


@book_query
def residual_to_largest(shop):
    """Payments of each sale scaled from the total to the subtotal."""
    wholes = shop.sales.select(F.col("id").alias("sale_id"), "total_amount", "subtotal")
    return allocation.scale_parts(shop.sale_payments, wholes, "sale_id", "method", "amount", "total_amount", "subtotal")


# --- lists ------------------------------------------------------------------


@trade_query
def sales_list(shop):
    out = orders.sales_list(shop)
    return out.select("id", "staff_id", "staff_name", "customer_id", "customer_name", "total_amount", "status", "created_at")


@book_query
def sales_list_filtered(shop):
    where = orders.sale_filters(role="Staff", me=3, staff_id=5, start="2024-01-10")
    out = orders.sales_list(shop, where)
    return out.select("id", "staff_id", "staff_name", "customer_name", "total_amount", "created_at")


@trade_query
def sale_detail(shop):
    out = orders.sale_detail(shop)
    return out.select(
        "id", "staff_name", "customer_name", "total_amount", "status",
        nesting.items_text(F.col("items"), "id", "product_id", "quantity", "returned_quantity").alias("items"),
    )


@trade_query
def orders_admin_list(shop):
    out = orders.orders_admin_list(shop)
    return out.select(
        "id", "total_amount", "status", "created_at", "customer_name", "customer_email", "customer_phone",
        "orderer_role",
        nesting.items_text(F.col("items"), "id", "product_code", "price", "quantity").alias("items"),
    )


@trade_query
def my_orders(shop):
    out = orders.my_orders(shop)
    return out.select(
        "party_type", "party_id", "id", "status", "total_amount",
        nesting.items_text(F.col("items"), "id", "product_name", "quantity").alias("items"),
    )


@trade_query
def product_list(shop):
    return catalog.product_list(shop)


@trade_query
def product_list_filtered(shop):
    out = catalog.product_list(
        shop, role="Seller", staff=True, category="brand-4", search="e", limit=25, offset=5
    )
    return out


@trade_query
def wholesale_list(shop):
    return catalog.wholesale_list(shop, search="ÉconomY")


@trade_query
def users_list(shop):
    return catalog.users_list(shop)


@trade_query
def users_pending(shop):
    return catalog.users_list(shop, "pending")


@trade_query
def subcategory_list(shop):
    return catalog.subcategory_list(shop)


def _holds(shop):
    return shop.events.where("event_type = 'view'").select(
        F.col("event_id").alias("id"), "staff_id", F.col("user_id").alias("customer_id"),
        F.concat(
            F.lit('[{"product_id": '), "user_id", F.lit(', "quantity": '), "k",
            F.lit('}, {"product_id": '), "event_id", F.lit(', "quantity": 1, "note": "gift"}]'),
        ).alias("items"),
        F.col("ts").alias("created_at"),
    )


@book_query
def holds_list(shop):
    out = orders.holds_list(_holds(shop), shop)
    return out.select("id", "staff_id", "customer_name", "created_at", nesting.items_text(F.col("items"), "product_id", "quantity").alias("items"))


@book_query
def json_items(shop):
    return orders.hold_lines(_holds(shop))


# --- sorts, limits, sets ----------------------------------------------------


@trade_query
def multi_key_order(shop):
    """Rank of every category under two keys, nulls first, as the list shows it."""
    ranked = rankings.ranked_groups(shop, shop.categories, "category_id")
    listed = running.position(
        ranked.withColumn("_less", -F.col("total_sold")), [], ["_less", "name"], "rank"
    )
    return listed.select("id", "name", "total_sold", "rank")


@trade_query
def page(shop):
    return ranking.page(shop.products.select("id", "created_at"), catalog.newest(), limit=40, offset=120)


@trade_query
def top_k(shop):
    order = [F.col("total_amount").desc(), F.col("id")]
    return ranking.top_k(shop.orders.select("id", "total_amount"), order, 25)


@trade_query
def priority_order(shop):
    """Per role: the approved account if there is one, else any, lowest id first."""
    first = F.when(F.col("status") == "approved", 0).otherwise(1)
    rows = shop.users.select("role_id", "id", "name", "status", first.alias("priority"))
    return ranking.earliest_per_key(rows, ["role_id"], ["priority", "id"])


@book_query
def arg_max(shop):
    """Largest payment of each sale, the earliest on ties."""
    rows = shop.sale_payments.select("sale_id", "id", "amount", (-F.col("amount")).alias("less"))
    return ranking.earliest_per_key(rows, ["sale_id"], ["less", "id"]).select("sale_id", "id", "amount")


@trade_query
def union_all_channels(shop):
    return dashboard.earned(shop)


@trade_query
def union_distinct(shop):
    return identity.taken_identifiers(shop)


@trade_query
def set_difference(shop):
    """Customers who never ordered online."""
    buyers = shop.orders.select(F.col("customer_id").alias("id"))
    return shop.customers.select("id", "name").join(buyers, "id", "left_anti")


@book_query
def permutation_check(shop):
    """Does a user's list of event types name each of the five exactly once?"""
    keys = ["click", "error", "purchase", "signup", "view"]
    lists = shop.events.select(
        F.concat_ws("-", "user_id", F.col("day").cast("string")).alias("list"), "event_type", F.col("k").alias("position")
    )
    return quality.permutation_check(lists, "list", "event_type", "position", keys)


# --- windows ----------------------------------------------------------------


@trade_query
def line_numbers(shop):
    out = orders.line_numbers(shop.order_items, "order_id", ["line_no", "id"], F.floor(F.col("line_no") / 10_000))
    return out.select("order_id", "id", "number")


@book_query
def latest_per_key(shop):
    return ranking.latest_per_key(
        shop.events.select("user_id", "event_type", "ts", "event_id", "v"), ["user_id", "event_type"], ["ts", "event_id"]
    )


@trade_query
def stock_ledger(shop):
    return stock.stock_ledger(shop)


@trade_query
def share_of_total(shop):
    value = F.col("price") * F.col("quantity")
    return allocation.share_of_total(shop.sale_items, "sale_id", value, "share").select("id", "sale_id", "share")


@book_query
def cooldown(shop):
    """Code requests per user and type, at most one a day."""
    events = shop.events.select("user_id", "event_type", "ts", "event_id")
    return accepted_requests(events, ["user_id", "event_type"], "ts", "event_id", seconds=86_400)


# --- scalars ----------------------------------------------------------------


@trade_query
def discount_price(shop):
    return shop.products.select(
        "id", money.discount_price(F.col("sale_price"), F.col("discount_percent")).alias("discount_price")
    )


@trade_query
def implied_discount_pct(shop):
    return shop.products.select(
        "id", money.implied_discount_percent(F.col("sale_price"), F.col("discount_price")).alias("percent"),
        money.implied_discount_percent(F.col("sale_price"), F.col("purchase_price")).alias("margin"),
    )


@trade_query
def scalar_basics(shop):
    return shop.orders.select(
        "id",
        F.coalesce("shipping_name", F.lit("-")).alias("receiver"),
        F.when(F.col("customer_id").isNull(), "staff").otherwise("customer").alias("party"),
        F.to_date("created_at").alias("day"),
        F.col("shipping_name").try_cast("bigint").alias("as_number"),
        F.datediff(F.to_date(instant(AS_OF)), F.to_date("created_at")).alias("age_days"),
        text.key_of(F.concat(F.lit("  "), "status", F.lit(" "))).alias("status_key"),
    )


@query
def slugify(spark, sf):
    return testbed.pages(spark, sf).select("page_id", text.slugify(F.col("url")).alias("slug"))


@query
def extract_url_params(spark, sf):
    pages = testbed.pages(spark, sf)
    picked = [F.concat_ws("|", text.query_parameter(F.col("url"), n)).alias(n) for n in ("page", "ref", "utm_source")]
    return pages.select("page_id", *picked)


@query
def font_families(spark, sf):
    """Families in a link made of the page's host and path, first of a name wins."""
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    snippet = F.concat(
        F.lit('<link href="https://fonts.test/css2?family='), F.replace(host, F.lit("."), F.lit("+")),
        F.lit(":wght@400&family=Noto+Sans%20Mono:ital&family="), F.replace(host, F.lit("."), F.lit("+")),
        F.lit(':wght@700" rel="stylesheet">'),
    )
    fonts = testbed.pages(spark, sf).select("page_id", F.posexplode(text.font_families(snippet)).alias("pos", "font"))
    return fonts.select("page_id", "pos", "font.*")


@query
def page_links(spark, sf):
    """Links of each page made absolute."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = testbed.pages(spark, sf).select("page_id", F.posexplode(hrefs).alias("pos", "href"))
    return links.select("page_id", "pos", text.absolute_url(F.col("href"), "https://shop.test/").alias("link"))


@query
def resolve_url(spark, sf):
    pages = testbed.pages(spark, sf)
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_extract("url", "//[^/]+/(.*)$", 1))
    return pages.select("page_id", text.absolute_url(path, "https://shop.test").alias("link"))


@query
def folder_id(spark, sf):
    given = F.when(
        F.col("page_id") % 2 == 0, F.concat("url", F.lit("/folders/a_"), "page_id", F.lit("?usp=x"))
    ).otherwise(F.concat(F.lit(" id-"), "page_id", F.lit(" ")))
    return testbed.pages(spark, sf).select("page_id", text.folder_id(given).alias("folder"))


@trade_query
def format_money(shop):
    return shop.orders.select("id", money.format_money(F.col("total_amount")).alias("total"))


@book_query
def format_datetime(shop):
    return shop.events.select("event_id", text.bill_datetime(F.col("ts")).alias("shown"))


@book_query
def timestamp_suffix(shop):
    return shop.events.select("event_id", text.file_stamp(F.col("ts")).alias("stamp"))


@trade_query
def is_filled(shop):
    return shop.customers.select("id", text.is_filled(F.col("email")).alias("filled"))


@trade_query
def scalar_math(shop):
    p, q = F.col("price"), F.col("quantity")
    return shop.order_items.select(
        "id",
        F.greatest(F.lit(0), q - 25).alias("over"),
        F.least(q, F.lit(10)).alias("capped"),
        F.ceil(p / 60).cast("bigint").alias("minutes"),
        F.round(p, 0).cast("bigint").alias("whole"),
        F.abs(q - 25).alias("distance"),
    )


@trade_query
def net_qty(shop):
    return shop.sale_items.select("id", money.net_quantity(F.col("quantity"), F.col("returned_quantity")).alias("net"))


@trade_query
def round2(shop):
    return shop.order_items.select("id", money.round2(F.col("price") * F.expr("0.125")).cast("decimal(10,2)").alias("eighth"))


@trade_query
def stable_unit_hash(shop):
    key = F.concat(F.lit("z:"), "slug")
    return shop.products.select("id", hashing.fnv1a(key).alias("hash"), F.floor(hashing.stable_unit(key) * 100).alias("percentile"))


@trade_query
def bill_ratio(shop):
    return shop.sales.select("id", money.bill_ratio_bp(F.col("total_amount"), F.col("subtotal")).alias("ratio"))


@trade_query
def item_label(shop):
    return shop.order_items.select("id", text.item_label(F.col("product_code"), F.col("product_name")).alias("label"))


@trade_query
def weighted_pick(shop):
    """A product for every customer, by popularity."""
    weight = F.col("stock") % 8 + 1
    slots = generate.weighted_slots(shop.products, "id", weight).withColumnRenamed("id", "product_id")
    total = shop.products.select(F.sum(weight)).scalar()
    return generate.weighted_pick(shop.customers.select("id"), F.col("id") * 7919, slots, total)


@trade_query
def weighted_pick_decimal(shop):
    """A product for every customer, the dearer the likelier: weights are prices."""
    ranges = generate.weighted_ranges(shop.products.withColumnRenamed("id", "product_id"), "product_id", F.col("sale_price"))
    cents = (shop.products.select(F.sum("sale_price")).scalar() * 100).cast("bigint")
    at = (F.pmod(F.col("id") * 7_919_777, cents) / F.lit(100)).cast("decimal(20,2)")
    return generate.pick_by_weight(shop.customers.select("id"), at, ranges, "product_id")


@trade_query
def order_bill_text(shop):
    """The message of every customer order."""
    items = orders.line_numbers(shop.order_items, "order_id", ["line_no", "id"], F.floor(F.col("line_no") / 10_000))
    people = shop.customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("sender_name"),
        F.when(F.col("id") % 2 == 0, F.col("whatsapp_number")).alias("sender_phone"),
    )
    heads = shop.orders.join(people, "customer_id").withColumnRenamed("id", "order_id")
    return orders.bill_text(heads, items)


@trade_query
def seller_bill_text(shop):
    """The message of every seller order, at cost."""
    heads = seller.seller_orders(shop).withColumnRenamed("id", "order_id")
    people = shop.users.select(
        F.col("id").alias("user_id"), F.col("name").alias("sender_name"), F.col("phone").alias("sender_phone"),
        "shop_name", F.when(F.col("id") % 2 == 0, F.col("city")).alias("city"),
    )
    items = orders.line_numbers(shop.order_items, "order_id", ["line_no", "id"], F.floor(F.col("line_no") / 10_000))
    return orders.bill_text(heads.join(people, "user_id"), items, seller=True)


@query
def rename_status(spark, sf):
    renamed = changes.rename_values(F.col("o_orderstatus"), {"O": "pending", "P": "pending", "F": "successful"})
    return testbed.raw(spark, sf, "orders").groupBy(renamed.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- state changes ----------------------------------------------------------


@trade_query
def price_lines(shop):
    """Every online line at the price its order's party pays."""
    lines = nesting.with_parent(pricing.price_modes(shop), shop.order_items, "order_id", "order_id", ["mode"])
    return pricing.price_lines(lines, shop.products, F.col("mode")).select(
        "id", "order_id", "product_name", "product_code", "price", "quantity", "line_total"
    )


def _new_carts(spark, sf):
    """The till's sales asked for anew: (shop, carts, lines), with all that can be wrong with them."""
    shop = testbed.trade(spark, sf)
    shop = shop.replace(pos_shifts=testbed.daybook(spark, sf).pos_shifts)
    id_ = F.col("id")
    carts = shop.sales.select(
        id_.alias("cart_id"), F.when(id_ % 19 == 0, id_).otherwise(F.col("staff_id")).alias("staff_id"), "customer_id", "created_at",
        F.when(id_ % 4 > 0, F.col("discount_amount")).alias("discount_amount"),
        F.when(id_ % 3 == 0, F.lit(2)).cast("decimal(5,2)").alias("tax_percent"),
        F.lit(None).cast("decimal(5,2)").alias("service_charge_percent"),
        F.when(id_ % 5 == 0, F.col("balance_due")).alias("amount_paid"),
        F.when(id_ % 23 == 0, "barter").when(id_ % 2 == 0, "card").alias("payment_method"),
    )
    lines = shop.sale_items.where(id_.isNotNull() & (F.col("sale_id") % 29 > 0)).select(
        F.col("sale_id").alias("cart_id"), id_.alias("line_id"), "product_id",
        F.when((F.col("sale_id") % 31 == 0) & (F.col("quantity") % 2 == 0), 0).otherwise(F.ceil(F.col("quantity") / 10)).cast("int").alias("quantity"),
    )
    return shop, carts, lines


def _rung_up(spark, sf):
    shop, carts, lines = _new_carts(spark, sf)
    return checkout.create_sales(shop, carts, lines, checkout.TillSettings(tax_percent=Decimal(5), service_percent=Decimal("2.5")))


@query
def create_sales(spark, sf):
    return _rung_up(spark, sf).sales


@query
def create_sales_items(spark, sf):
    return _rung_up(spark, sf).items


@query
def create_sales_payments(spark, sf):
    return _rung_up(spark, sf).payments


@query
def create_sales_moves(spark, sf):
    moves = _rung_up(spark, sf).moves
    return moves.groupBy("product_id").agg(F.sum("delta").cast("bigint").alias("moved"))


@query
def create_sales_refused(spark, sf):
    return _rung_up(spark, sf).refused


def _asked_orders(shop):
    id_ = F.col("id")
    carts = shop.orders.select(
        id_.alias("cart_id"), "user_id", "customer_id", "created_at", "shipping_name",
        F.lit(None).cast("string").alias("shipping_phone"), F.lit(None).cast("string").alias("shipping_address"),
    )
    lines = shop.order_items.where(F.col("order_id") % 29 > 0).select(
        F.col("order_id").alias("cart_id"), id_.alias("line_id"),
        F.when(F.col("order_id") % 17 == 0, -F.col("product_id")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(F.col("quantity") < 5, 0).otherwise(F.ceil(F.col("quantity") / 8)).cast("int").alias("quantity"),
    )
    return checkout.place_orders(shop, carts, lines)


@trade_query
def place_orders(shop):
    return _asked_orders(shop).orders


@trade_query
def place_orders_items(shop):
    return _asked_orders(shop).items


@trade_query
def place_orders_refused(shop):
    return _asked_orders(shop).refused


def _till_carts(shop):
    priced = pricing.price_lines(shop.sale_items, shop.products, "till")
    sales = shop.sales.select(F.col("id").alias("sale_id"), "status", "discount_amount", "balance_due")
    return pricing.cart_totals(priced, "sale_id").join(sales, "sale_id").select(
        "sale_id", "status", "subtotal",
        F.when(F.col("sale_id") % 7 == 0, F.col("subtotal") + 1).otherwise(F.least("discount_amount", "subtotal")).alias("discount_amount"),
        (F.col("sale_id") % 4 * F.expr("2.5")).alias("tax_percent"),
        (F.col("sale_id") % 3 * 5).cast("decimal(5,2)").alias("service_charge_percent"),
        F.when(F.col("sale_id") % 5 == 0, None).when(F.col("sale_id") % 5 == 1, F.lit(-1))
        .otherwise(F.col("balance_due")).cast("decimal(20,2)").alias("amount_paid"),
    )


@trade_query
def bill_totals(shop):
    out = pricing.bill_totals(_till_carts(shop))
    return out.drop("tax_percent", "service_charge_percent")


def _stock_requests(shop):
    heads = shop.orders.select(F.col("id").alias("order_id"), "created_at")
    return shop.order_items.select("order_id", "id", "product_id", "quantity").join(heads, "order_id")


@trade_query
def stock_check(shop):
    """Order lines served in request order while stock lasts."""
    served = stock.reserve_stock(
        _stock_requests(shop), shop.products, ["created_at", "order_id", "id"], F.date_trunc("month", "created_at"))
    return served.select("id", "order_id", "product_id", "quantity", "admitted")


@trade_query
def stock_check_carts(shop):
    """Orders served one after the other, each as a whole or not at all."""
    return stock.whole_carts(
        _stock_requests(shop), shop.products, "order_id", ["created_at", "order_id"], F.date_trunc("month", "created_at"))


def _status_requests(shop):
    word = F.element_at(
        F.array(*[F.lit(s) for s in (*ORDER_STATUSES, "shipped")]), (F.col("id") % 5 + 1).cast("int")
    )
    # asked for within a week of the order
    when = F.timestamp_add("DAY", (F.col("id") % 7).cast("int"), F.col("created_at"))
    return shop.orders.select(F.col("id").alias("order_id"), word.alias("to_status"), when.alias("requested_at"))


@trade_query
def order_transition(shop):
    decided, _ = lifecycle.order_transitions(shop.orders, shop.order_items, shop.products, _status_requests(shop))
    return decided.drop("requested_at")


@trade_query
def order_transition_lines(shop):
    decided, _ = lifecycle.order_transitions(shop.orders, shop.order_items, shop.products, _status_requests(shop))
    lines = lifecycle.lines_after_transition(shop.order_items, decided)
    return lines.select("id", "order_id", "returned_quantity")


@trade_query
def order_transition_moves(shop):
    _, moves = lifecycle.order_transitions(shop.orders, shop.order_items, shop.products, _status_requests(shop))
    return moves


@trade_query
def resold_after_return(shop):
    return lifecycle.resold_after_return(shop.orders, shop.order_items)


def _return_requests(items, parent):
    """Per line: bring back a third of it; products numbered by multiples of 97 ask for too much."""
    third = F.floor(F.col("quantity") / 3)
    asked = F.when(F.col("product_id") % 97 == 0, F.col("quantity") + 1).otherwise(third)
    return items.select(parent, F.col("id").alias("line_id"), asked.cast("int").alias("quantity"))


@trade_query
def order_return(shop):
    after, _, _ = lifecycle.order_returns(shop.orders, shop.order_items, _return_requests(shop.order_items, "order_id"))
    return after


@trade_query
def order_return_refused(shop):
    _, _, refused = lifecycle.order_returns(shop.orders, shop.order_items, _return_requests(shop.order_items, "order_id"))
    return refused


@trade_query
def order_return_lines(shop):
    _, lines, _ = lifecycle.order_returns(shop.orders, shop.order_items, _return_requests(shop.order_items, "order_id"))
    return lines.select("id", "order_id", "returned_quantity", "came_back")


def _billed_sales(shop):
    """Sales whose bill is that of their own lines."""
    carts = pricing.cart_totals(
        shop.sale_items.withColumn("line_total", (F.col("price") * F.col("quantity")).cast("decimal(20,2)")), "sale_id"
    )
    sales = shop.sales.select(F.col("id").alias("sale_id"), "status")
    bills = pricing.bill_totals(
        carts.join(sales, "sale_id").select(
            "sale_id", "status", "subtotal",
            F.round(F.col("subtotal") * (F.col("sale_id") % 5) * F.expr("0.01"), 2).alias("discount_amount"),
            (F.col("sale_id") % 4 * F.expr("2.5")).alias("tax_percent"),
            F.lit(0).alias("service_charge_percent"),
            F.lit(None).cast("decimal(20,2)").alias("amount_paid"),
        )
    )
    return bills.withColumnRenamed("sale_id", "id")


def _unreturned(items):
    return items.withColumn("returned_quantity", F.lit(0))


@trade_query
def sale_return(shop):
    items = _unreturned(shop.sale_items)
    after, _, _ = lifecycle.sale_returns(_billed_sales(shop), items, _return_requests(items, "sale_id"))
    return after


@trade_query
def sale_return_lines(shop):
    items = _unreturned(shop.sale_items)
    _, lines, _ = lifecycle.sale_returns(_billed_sales(shop), items, _return_requests(items, "sale_id"))
    return lines.select("id", "sale_id", "returned_quantity", "came_back")


@trade_query
def sale_return_refused(shop):
    items = _unreturned(shop.sale_items)
    _, _, refused = lifecycle.sale_returns(_billed_sales(shop), items, _return_requests(items, "sale_id"))
    return refused


@trade_query
def stock_movements(shop):
    return stock.stock_movements(shop)


@trade_query
def stock_balance(shop):
    return stock.stock_balance(shop)


@trade_query
def void_sales(shop):
    requests = shop.sales.select((F.col("id") + 1).alias("sale_id"), F.lit(1).alias("voided_by"))
    decided, _ = lifecycle.void_sales(shop.sales, shop.sale_items, requests)
    return decided.select("sale_id", "outcome")


@trade_query
def void_restock(shop):
    requests = shop.sales.select(F.col("id").alias("sale_id"), F.lit(1).alias("voided_by"))
    _, back = lifecycle.void_sales(shop.sales, shop.sale_items, requests)
    return back


def _late_requests(shop):
    """Late payments five times over, so that many no longer fit."""
    late = shop.sale_payments.where("id <> sale_id")
    # some of a kind that the till does not know, some on sales that do not exist
    method = F.when(F.col("id") % 11 == 0, "barter").otherwise(F.col("method"))
    sale = F.when(F.col("id") % 13 == 0, -F.col("id")).otherwise(F.col("sale_id"))
    amount = F.when(F.col("id") % 17 == 0, 0).otherwise(F.col("amount") * 5)
    return late.select(
        "id", sale.alias("sale_id"), amount.cast("decimal(10,2)").alias("amount"), method.alias("method"),
        # taken by twice as many people as have a shift open
        (F.col("staff_id") + F.when(F.col("id") % 3 == 0, 1000).otherwise(0)).alias("staff_id"), "created_at",
    )


@book_query
def apply_payments(shop):
    judged, _ = lifecycle.apply_payments(
        shop.sales, _late_requests(shop), ["created_at", "id"], F.date_trunc("hour", "created_at"), shop.pos_shifts
    )
    return judged.select("id", "sale_id", "amount", "admitted", "reason")


@book_query
def apply_payments_rows(shop):
    judged, _ = lifecycle.apply_payments(
        shop.sales, _late_requests(shop), ["created_at", "id"], F.date_trunc("hour", "created_at"), shop.pos_shifts
    )
    return lifecycle.payment_rows(judged)


@book_query
def apply_payments_sales(shop):
    _, after = lifecycle.apply_payments(
        shop.sales, _late_requests(shop), ["created_at", "id"], F.date_trunc("hour", "created_at"), shop.pos_shifts
    )
    return after


@book_query
def close_shifts(shop):
    counted = shop.pos_shifts.where("status = 'open'").select(
        F.col("id").alias("shift_id"), (F.col("opening_cash") + F.col("staff_id")).alias("counted_cash"),
        instant(BOOK_AS_OF).alias("counted_at"),
    )
    return lifecycle.close_shifts(shop, counted)


@trade_query
def soft_delete_restore(shop):
    """Products nobody ordered online go; everything ordered comes back."""
    ordered = shop.order_items.select(F.col("product_id").alias("id"))
    heads = shop.orders.where("status = 'successful'").select(F.col("id").alias("order_id"))
    sold = shop.order_items.join(heads, "order_id", "left_semi").select(F.col("product_id").alias("id"))
    unsold = shop.products.select("id").join(sold, "id", "left_anti")
    gone = changes.set_active(shop.products, unsold, False)
    return changes.set_active(gone, ordered, True).select("id", "is_active")


@trade_query
def partial_update(shop):
    """One patch per customer: a new e-mail for some, none for others, the name left alone."""
    patches = shop.customers.select(
        "id",
        (F.col("id") % 2 == 0).alias("has_email"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("new"), "id", F.lit("@mail.test"))).alias("email"),
        (F.col("id") % 3 == 0).alias("has_name"),
        F.upper("name").alias("name"),
    )
    return changes.partial_update(shop.customers, patches, "id", ["email", "name"]).select("id", "name", "email")


@query
def wishlist_toggle(spark, sf):
    return changes.toggled_on(_wishes(spark, sf), ["owner_type", "owner_id", "product_id"])


@query
def approve_reject(spark, sf):
    """Sign-up events decide on the seller accounts, the last one counts."""
    shop = testbed.trade(spark, sf)
    decisions = testbed.events(spark, sf).where("event_type = 'signup'").select(
        (F.col("user_id") % 40).alias("id"), (F.col("k") % 2 == 0).alias("approve"), F.col("ts").alias("decided_at")
    )
    return changes.decide(shop.users, decisions).select("id", "status", "is_active")


@book_query
def backfills(shop):
    return lifecycle.as_fully_paid(shop.sales).select("id", "total_amount", "amount_paid", "balance_due")


@trade_query
def backfill_legal_text(shop):
    """Placeholder pages for shops that never wrote them, every seller having one row of settings."""
    settings = shop.users.select(
        "id", F.col("shop_name").alias("terms_content"), F.lit(None).cast("string").alias("return_policy_content"),
        F.col("city").alias("privacy_policy_content"), F.col("phone").alias("about_content"),
    )
    return lifecycle.with_legal_text(settings)


@trade_query
def backfill_codes_by_slug(shop):
    """Codes for products without one, given by slug."""
    codes = shop.products.select("slug", F.concat(F.lit("S"), "id").alias("product_code"))
    return changes.fill_missing(shop.products, codes, "slug", "slug", ["product_code"]).select("id", "product_code")


@trade_query
def price_migration(shop):
    """Products with one price and a discounted one, brought to price and percent."""
    old = shop.products.select(
        "id", F.col("sale_price").alias("price"),
        F.when(F.col("discount_percent") > 0, F.col("discount_price")).alias("discount_price"),
    )
    return lifecycle.migrate_prices(old)


@trade_query
def role_migration(shop):
    """Accounts with the role as a word, brought to the role's id; unknown words mean customer."""
    words = F.array(*[F.lit(w) for w in ("seller", "admin", "superadmin", "guest")])
    old = shop.users.select("id", F.element_at(words, (F.col("id") % 4 + 1).cast("int")).alias("role"))
    return lifecycle.role_ids(old, shop.user_roles)


@trade_query
def ensure_columns(shop):
    """Customers in the current shape: renamed, a flag added, an old column dropped."""
    old = shop.customers.select("id", F.col("name").alias("full_name"), "whatsapp_number", F.lit("x").alias("smtp_host"))
    return changes.conform(
        old, {"id": "bigint", "name": "string", "whatsapp_number": "string", "is_active": "boolean", "city": "string"},
        defaults={"is_active": True}, renames={"full_name": "name"},
    )


# --- streams ----------------------------------------------------------------


def _event_stream(spark, sf):
    return stream_sources.event_stream(spark, f"{sf}/events*.parquet")


@query
def stream_x_report(spark, sf):
    events = _event_stream(spark, sf)
    report = live.x_report(live.event_sales(events), live.event_cash_outs(events))
    return runner.current(runner.run_available(report), ["shift_id"])


def _as_stream(df: DataFrame) -> DataFrame:
    """A table as it comes in: written to the shared folder, read as a stream of files."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query
def stream_shift_reports(spark, sf):
    """Every shift followed from its opening until it is handed over, with late payments."""
    shop, events = testbed.daybook(spark, sf), _event_stream(spark, sf)
    till = shop.pos_shifts
    openings, closings = _as_stream(till.select("id", "opening_cash", "opened_at")), _as_stream(
        till.where("status = 'closed'").select("id", "closing_cash", "closed_at")
    )
    entries = shifts.entries(
        openings, live.event_sales(events), _as_stream(shop.sale_payments), live.event_cash_outs(events), closings
    )
    pay = F.transform("payments", lambda p: F.concat_ws(":", p["method"], (p["total"] * 100).cast("bigint").cast("string")))
    return shifts.reports(*shifts.follow(entries)).withColumn("payments", F.concat_ws("|", pay))


@query
def stream_revenue_by_day(spark, sf):
    report = live.revenue_by_day(live.event_sales(_event_stream(spark, sf)))
    return runner.current(runner.run_available(report), ["day"])


@query
def stream_hot_products(spark, sf):
    units = live.trailing_units(live.event_items(_event_stream(spark, sf)))
    return runner.run_top(units, ["until"], ["product_id"], "total_sold", 5)


@query
def stream_ttl_state(spark, sf):
    """Codes by user: sign-ups, views and clicks ask for one, errors and purchases try one. Hours for minutes."""
    events = stream_sources.with_event_time(_event_stream(spark, sf), "ts", "1 day").select(
        F.col("user_id").alias("identifier"),
        F.when(F.col("user_id") % 2 == 0, "register").otherwise("reset").alias("purpose"),
        "event_id", "ts",
        F.when(F.col("event_type").isin("signup", "view"), "request").otherwise("check").alias("kind"),
        (F.col("k") % 4 == 0).alias("correct"),
    )
    return codes.follow_codes(events, ttl=36_000, cooldown=3_600, attempts=2)[1]


@query
def stream_dedupe(spark, sf):
    """Events once each, though every file is read with each event twice."""
    stream = _event_stream(spark, sf)
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    rows = runner.run_available(live.unique_events(doubled, ["event_id"]), mode="append")
    return rows.select("event_id", "user_id", "event_type", "v")


@query
def stream_dedupe_upsert(spark, sf):
    """Latest code per (user, purpose), kept by upserting each micro-batch."""
    stream = _event_stream(spark, sf).where("event_type in ('view', 'signup')").select(
        F.col("user_id").alias("identifier"), (F.col("k") % 3).alias("purpose"), F.col("event_id").alias("payload"), "ts"
    )
    return runner.run_upsert(stream, ["identifier", "purpose"], ["ts", "payload"])


@query
def stream_stock(spark, sf):
    moved = live.stock(live.event_moves(_event_stream(spark, sf)), testbed.trade(spark, sf).products)
    return runner.current(runner.run_available(moved), ["product_id"])


@query
def session_shifts(spark, sf):
    """Working sessions of staff, batch form of the session window."""
    return live.working_sessions(testbed.events(spark, sf))


@query
def stream_session_shifts(spark, sf):
    """The same from the stream: sessions that are over, and those still going on when it stops."""
    going_on, over = shifts.sessions(_event_stream(spark, sf))
    return going_on.unionByName(over)
