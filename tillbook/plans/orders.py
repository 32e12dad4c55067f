"""Order, sale and cart lists with their parties and lines; bills as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.common import all_of, instant
from tillbook.functions.money import format_money
from tillbook.functions.text import bill_datetime, is_filled, item_label
from tillbook.operators.nesting import nest_children
from tillbook.operators.ranking import top_k
from tillbook.operators.running import position
from tillbook.plans.catalog import hidden_columns
from tillbook.sources.shop import Shop

SALES_LIST_LIMIT = 200
ITEM_FIELDS = ["product_id", "product_name", "product_code", "price", "quantity", "returned_quantity"]
# The bill's divider and closing line.
DIVIDER = "-" * 24
CLOSING = "Our staff will contact you soon. Thanks for your patience."


def with_parties(orders: DataFrame, shop: Shop) -> DataFrame:
    """Who placed the order: staff or customer name, e-mail, phone and role.

    An order has one of the two; where a key is null, the order's own id stands
    in as a number that no party has, so these orders don't meet in one task.
    """
    nobody = -1 - F.col("id")
    orders_keyed = orders.withColumn("_user", F.coalesce("user_id", nobody)).withColumn("_customer", F.coalesce("customer_id", nobody))
    users = shop.users.select(
        F.col("id").alias("_user"), F.col("name").alias("_u_name"), F.col("email").alias("_u_email"),
        F.col("phone").alias("_u_phone"), "role_id",
    )
    roles = shop.user_roles.select(F.col("id").alias("role_id"), F.col("name").alias("_role"))
    # the role is the user's own, so it is joined before the orders are
    users = users.join(roles, "role_id", "left").drop("role_id")
    customers = shop.customers.select(
        F.col("id").alias("_customer"), F.col("name").alias("_c_name"),
        F.col("email").alias("_c_email"), F.col("whatsapp_number").alias("_c_phone"),
    )
    joined = orders_keyed.join(users, "_user", "left").join(customers, "_customer", "left")
    return joined.select(
        *orders.columns,
        F.coalesce("_u_name", "_c_name").alias("customer_name"),
        F.coalesce("_u_email", "_c_email").alias("customer_email"),
        F.coalesce("_u_phone", "_c_phone").alias("customer_phone"),
        F.when(F.col("customer_id").isNotNull(), "Customer").otherwise(F.col("_role")).alias("orderer_role"),
    )


def orders_admin_list(shop: Shop) -> DataFrame:
    """Every order with its party and its lines, newest first."""
    nested = nest_children(with_parties(shop.orders, shop), shop.order_items, "id", "order_id", ITEM_FIELDS, "id")
    return nested.orderBy(F.col("created_at").desc(), F.col("id").desc())


def lines_of(lines: DataFrame, headers: DataFrame, parent: str) -> DataFrame:
    """The lines of these headers only."""
    return lines.join(headers.select(F.col("id").alias(parent)), parent, "left_semi")


def my_orders(shop: Shop, role: str | None = None, party: tuple[str, int] | None = None) -> DataFrame:
    """Own orders with lines, of all parties or of one; the party is (party_type, party_id).

    For one party only its orders' lines are nested. The product code shows to
    managers only.
    """
    fields = [f for f in ITEM_FIELDS if f not in hidden_columns("order_items", role)]
    orders = shop.orders.withColumn(
        "party_type", F.when(F.col("customer_id").isNotNull(), "customer").otherwise("staff")
    ).withColumn("party_id", F.coalesce("customer_id", "user_id"))
    lines = shop.order_items
    if party is not None:
        orders = orders.where((F.col("party_type") == party[0]) & (F.col("party_id") == party[1]))
        lines = lines_of(lines, orders, "order_id")
    nested = nest_children(orders, lines, "id", "order_id", fields, "id")
    return nested.orderBy("party_type", "party_id", F.col("created_at").desc(), F.col("id").desc())


def with_staff_and_customer(sales: DataFrame, shop: Shop) -> DataFrame:
    staff = shop.users.select(F.col("id").alias("staff_id"), F.col("name").alias("staff_name"))
    customers = shop.customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("customer_name")
    )
    return sales.join(staff, "staff_id").join(customers, "customer_id", "left")


def sale_filters(
    role: str | None = None,
    me: int | None = None,
    staff_id: int | None = None,
    shift_id: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> Column:
    """Request filters; staff are held to their own sales whatever they ask for.

    ``end`` compares with the instant, so a bare date leaves out the rest of
    that day.
    """
    preds = []
    if role == "Staff":
        preds.append(F.col("staff_id") == me)
    elif staff_id:
        preds.append(F.col("staff_id") == staff_id)
    if shift_id:
        preds.append(F.col("shift_id") == shift_id)
    if start:
        preds.append(F.col("created_at") >= instant(start))
    if end:
        preds.append(F.col("created_at") <= instant(end))
    return all_of(preds)


def sales_list(
    shop: Shop, where: Column | None = None, limit: int = SALES_LIST_LIMIT, keys_checked: bool = False
) -> DataFrame:
    """Newest sales that match, with names. Names are joined to the kept rows only.

    ``keys_checked``: every sale's staff is known to exist, so sales need no
    join before the top-k.
    """
    sales = shop.sales if where is None else shop.sales.where(where)
    if not keys_checked:
        sales = sales.join(shop.users.select(F.col("id").alias("staff_id")), "staff_id", "left_semi")
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return with_staff_and_customer(top_k(sales, order, limit), shop).orderBy(*order)


def sale_detail(shop: Shop, where: Column | None = None) -> DataFrame:
    """Sales with names and lines: all of them, or those that match; then only their lines are nested."""
    sales, lines = shop.sales, shop.sale_items
    if where is not None:
        sales = sales.where(where)
        lines = lines_of(lines, sales, "sale_id")
    return nest_children(with_staff_and_customer(sales, shop), lines, "id", "sale_id", ITEM_FIELDS, "id")


HOLD_ITEMS = "array<struct<product_id: bigint, quantity: int>>"


def holds_list(holds: DataFrame, shop: Shop) -> DataFrame:
    """Parked carts with the customer's name and their JSON items parsed, newest first."""
    customers = shop.customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("customer_name")
    )
    return (
        holds.join(customers, "customer_id", "left")
        .withColumn("items", F.from_json("items", HOLD_ITEMS))
        .orderBy("staff_id", F.col("created_at").desc(), F.col("id").desc())
    )


def hold_lines(holds: DataFrame) -> DataFrame:
    """One row per item of each parked cart."""
    return holds.withColumn("items", F.from_json("items", HOLD_ITEMS)).select(
        F.col("id").alias("hold_id"), F.posexplode("items").alias("pos", "item")
    ).select("hold_id", (F.col("pos") + 1).alias("line_no"), "item.*")


def line_numbers(items: DataFrame, parent: str, order: list[str], bucket: Column) -> DataFrame:
    """1-based number of each line within its order."""
    return position(items, [parent], order, "number", bucket)


def bill_text(
    orders: DataFrame,
    numbered: DataFrame,
    parent: str = "order_id",
    shop_name: str = "Shop",
    seller: bool = False,
) -> DataFrame:
    """The order as one message: header, numbered lines, total. Empty lines stay, absent ones drop.

    ``orders`` carries order_id, total_amount, created_at, sender_name,
    sender_phone and, for sellers, shop_name and city; ``numbered`` the lines
    with their number. An order without lines has header and total only.
    """
    note = " (cost)" if seller else ""
    line = F.concat(
        F.col("number").cast("string"), F.lit(". "), item_label(F.col("product_code"), F.col("product_name")),
        F.lit("\n    "), F.col("quantity").cast("string"), F.lit(" x "), format_money(F.col("price")),
        F.lit(f"{note} = "), format_money(F.col("price") * F.col("quantity")),
    )
    lines = (
        numbered.select(parent, "number", line.alias("_line"))
        .groupBy(parent)
        .agg(F.sort_array(F.collect_list(F.struct("number", F.col("_line").alias("line")))).alias("_lines"))
        .select(parent, F.concat_ws("\n", F.transform("_lines", lambda e: e["line"])).alias("_lines"))
    )

    def labelled(label: str, col: str) -> Column:
        return F.when(is_filled(F.col(col)), F.concat(F.lit(f"*{label}:* "), F.col(col)))

    head = [
        F.lit(f"*{shop_name} - {'Seller Order' if seller else 'Order Request'}*"),
        F.lit(""),
        F.concat(F.lit("*Order ID:* #"), F.col(parent).cast("string")),
        F.concat(F.lit("*Seller:* " if seller else "*Customer:* "), F.coalesce("sender_name", F.lit(""))),
        labelled("Contact", "sender_phone"),
        *([labelled("Shop", "shop_name"), labelled("City", "city")] if seller else []),
        F.concat(F.lit("*Date:* "), bill_datetime(F.col("created_at"))),
        F.lit(DIVIDER),
    ]
    total = F.concat(
        F.lit("*Total (Cost Price): " if seller else "*Total: "), format_money(F.col("total_amount")), F.lit("*")
    )
    tail = [F.lit(DIVIDER), total, F.lit(""), F.lit(CLOSING)]
    return orders.join(lines, parent, "left").select(
        parent, F.concat_ws("\n", *head, F.col("_lines"), *tail).alias("message")
    )
