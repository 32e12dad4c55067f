"""Carts to sales at the till and to orders online, as batch jobs with a table per output."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.common import MONEY, PERCENT
from tillbook.functions.text import is_filled
from tillbook.operators.nesting import with_parent
from tillbook.plans import daybook, pricing, seller, stock
from tillbook.session import cut_lineage
from tillbook.sources.schema import PAYMENT_METHODS
from tillbook.sources.shop import Shop


@dataclass(frozen=True)
class TillSettings:
    """What the shop's settings say of the till."""

    active: bool = True
    tax_percent: Decimal = Decimal(0)
    service_percent: Decimal = Decimal(0)
    display_price: str = "sale"

    @classmethod
    def of(cls, shop: Shop) -> TillSettings:
        row = shop.settings.select(
            "pos_is_active", "pos_tax_percent", "pos_service_charge_percent", "pos_display_price"
        ).first()
        return cls(*row) if row else cls(active=False)


class Sales(NamedTuple):
    sales: DataFrame
    items: DataFrame
    payments: DataFrame
    moves: DataFrame
    refused: DataFrame


class Orders(NamedTuple):
    orders: DataFrame
    items: DataFrame
    refused: DataFrame


def create_sales(shop: Shop, carts: DataFrame, lines: DataFrame, till: TillSettings) -> Sales:
    """Rings up carts in the order they were made.

    ``carts``: cart_id, staff_id, customer_id, created_at, discount_amount,
    tax_percent, service_charge_percent, amount_paid, payment_method; percents
    left null come from the settings, a null method is cash, a null payment is
    the whole total. ``lines``: cart_id, line_id, product_id, quantity.

    A cart is sold as a whole or refused with the first reason that holds; carts
    are served one after the other (see ``stock.whole_carts``).
    """
    method = F.coalesce("payment_method", F.lit("cash"))
    sizes = lines.groupBy("cart_id").agg(
        F.bool_or(F.col("product_id").isNull() | (F.coalesce("quantity", F.lit(0)) <= 0)).alias("_bad")
    )
    heads = (
        carts.withColumn("payment_method", method)
        .join(daybook.open_shift_ids(shop.pos_shifts), "staff_id", "left").join(sizes, "cart_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_bad").isNull(), "no items")
            .when(~F.col("payment_method").isin(*PAYMENT_METHODS), "invalid method")
            .when(F.lit(not till.active), "till is off")
            .when(F.col("shift_id").isNull(), "no open shift")
            .when(F.col("_bad"), "invalid item"),
        ).drop("_bad")
    )
    heads = cut_lineage(heads)
    asked = with_parent(heads.where("reason is null"), lines, "cart_id", "cart_id", ["created_at"])
    asked = cut_lineage(asked)
    whole = cut_lineage(stock.whole_carts(asked, shop.products, "cart_id", ["created_at", "cart_id"], F.date_trunc("hour", "created_at")))
    whole = whole.select("cart_id", "accepted")
    judged = heads.join(whole, "cart_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(~F.col("accepted"), "not enough stock"))
    )
    sold = judged.where("reason is null").drop("reason", "accepted")

    kept = asked.join(whole.where("accepted"), "cart_id", "left_semi")
    mode = "cost" if till.display_price == "cost" else "till"
    priced = pricing.price_lines(kept.select("cart_id", "line_id", "product_id", "quantity"), shop.products, mode)
    priced = cut_lineage(priced)
    defaults = {"tax_percent": till.tax_percent, "service_charge_percent": till.service_percent}
    billed = pricing.cart_totals(priced, "cart_id").join(sold, "cart_id").withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)).cast(PERCENT) for name, value in defaults.items()}
    ).withColumn("discount_amount", F.coalesce("discount_amount", F.lit(0)).cast(MONEY))
    sales = pricing.bill_totals(billed).select(
        F.col("cart_id").alias("id"), "shift_id", "staff_id", "customer_id", F.col("subtotal").cast(MONEY).alias("subtotal"),
        "discount_amount", "tax_percent", "service_charge_percent",
        *[F.col(c).cast(MONEY).alias(c) for c in ("total_amount", "amount_paid", "balance_due")],
        "payment_method", F.lit("completed").alias("status"), "created_at",
    )
    return Sales(
        sales,
        priced.select(F.col("line_id").alias("id"), F.col("cart_id").alias("sale_id"), "product_id", "product_name",
                      "product_code", "price", "quantity", F.lit(0).alias("returned_quantity")),
        sales.where("amount_paid > 0").select(
            F.col("id").alias("sale_id"), "shift_id", "staff_id", F.col("amount_paid").alias("amount"),
            F.col("payment_method").alias("method"), "created_at"),
        priced.select("product_id", "cart_id", "line_id", (-F.col("quantity")).cast("bigint").alias("delta")),
        judged.where("reason is not null").select("cart_id", "reason"),
    )


def place_orders(shop: Shop, carts: DataFrame, lines: DataFrame) -> Orders:
    """Orders as they are asked for; no stock is taken before approval, so carts don't compete.

    ``carts``: cart_id, user_id or customer_id, created_at, shipping_name,
    shipping_phone, shipping_address. ``lines``: cart_id, line_id, product_id,
    quantity (null or 0 counts as 1). Sellers pay cost, others the retail price.
    """
    sellers = seller.users_in_role(shop, "Seller").select(F.col("id").alias("user_id"), F.lit("cost").alias("_mode"))
    parties = shop.users.select(F.col("id").alias("user_id"), F.col("name").alias("_u_name"), F.col("phone").alias("_u_phone"))
    customers = shop.customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("_c_name"), F.col("whatsapp_number").alias("_c_phone")
    )
    wanted = F.when(F.coalesce("quantity", F.lit(0)) == 0, 1).otherwise(F.col("quantity"))
    products = shop.products.select(F.col("id").alias("product_id"), F.col("stock").alias("_stock"))
    checked = lines.withColumn("quantity", wanted).join(products, "product_id", "left")
    faults = checked.groupBy("cart_id").agg(
        F.bool_or(F.col("_stock").isNull()).alias("_unknown"),
        F.bool_or(F.coalesce(F.col("_stock") < F.col("quantity"), F.lit(False))).alias("_short"),
    )
    judged = cut_lineage(
        carts.join(faults, "cart_id", "left").join(sellers, "user_id", "left").withColumn(
            "reason",
            F.when(F.col("_unknown").isNull(), "no items").when(F.col("_unknown"), "product not found")
            .when(F.col("_short"), "not enough stock"),
        ).drop("_unknown", "_short")
    )
    placed = judged.where("reason is null").withColumn("_mode", F.coalesce("_mode", F.lit("retail")))
    own = with_parent(placed, lines, "cart_id", "cart_id", ["_mode"])
    priced = cut_lineage(pricing.price_lines(own, shop.products, F.col("_mode")).drop("_mode"))
    named = (
        placed.join(pricing.cart_totals(priced, "cart_id"), "cart_id")
        .join(parties, "user_id", "left").join(customers, "customer_id", "left")
    )

    def given(own_value: str, *others: str):
        return F.coalesce(F.when(is_filled(F.col(own_value)), F.col(own_value)), *others)

    return Orders(
        named.select(
            F.col("cart_id").alias("id"), "user_id", "customer_id", F.col("subtotal").cast(MONEY).alias("total_amount"),
            F.lit("pending").alias("status"), F.lit("cod").alias("payment_method"),
            given("shipping_name", "_u_name", "_c_name").alias("shipping_name"),
            given("shipping_phone", "_u_phone", "_c_phone").alias("shipping_phone"),
            "shipping_address", "created_at"),
        priced.select(F.col("line_id").alias("id"), F.col("cart_id").alias("order_id"), "product_id", "product_name",
                      "product_code", "price", "quantity", F.lit(0).alias("returned_quantity")),
        judged.where("reason is not null").select("cart_id", "reason"),
    )
