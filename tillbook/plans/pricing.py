"""Prices of cart lines and the arithmetic of a bill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.common import MONEY, money_sum
from tillbook.functions.money import percent_of, round2, unit_price
from tillbook.sources.shop import Shop


MODES = ("retail", "till", "cost")


def price_lines(lines: DataFrame, products: DataFrame, mode: str | Column) -> DataFrame:
    """Adds name, code, unit price and line total from the product's current prices.

    ``mode``: ``retail`` (online), ``till`` (POS) or ``cost`` (sellers), for all
    lines or as a column of the lines. Lines of unknown products drop out;
    ``quantity`` of 0 or null counts as 1 online.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    priced = products.select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        "product_code",
        *[unit_price(m).cast(MONEY).alias(f"_{m}") for m in MODES],
    )
    own = [c for c in lines.columns if c not in ("product_name", "product_code", "price")]
    units = F.col("quantity")
    units = F.when((mode != "till") & (F.coalesce(units, F.lit(0)) == 0), F.lit(1)).otherwise(units)
    price = F.coalesce(*[F.when(mode == m, F.col(f"_{m}")) for m in MODES])
    return (
        lines.select(*own).withColumn("quantity", units).join(priced, "product_id")
        .withColumn("price", price).drop(*[f"_{m}" for m in MODES])
        .withColumn("line_total", (F.col("price") * F.col("quantity")).cast("decimal(20,2)"))
    )


def cart_totals(priced: DataFrame, cart: str) -> DataFrame:
    return priced.groupBy(cart).agg(money_sum("line_total").alias("subtotal"))


def bill_totals(carts: DataFrame) -> DataFrame:
    """Discount, tax, service charge, payment and balance of each cart.

    Needs subtotal, discount_amount, tax_percent, service_charge_percent and
    amount_paid (null or negative: paid in full). Amounts are kept exact and
    rounded half-up once, where the sale stores them.
    """
    after = F.greatest(F.lit(0), F.col("subtotal") - F.coalesce("discount_amount", F.lit(0)))
    with_after = carts.withColumn("_after", after.cast("decimal(20,2)"))
    tax = percent_of(F.col("_after"), F.coalesce("tax_percent", F.lit(0)))
    service = percent_of(F.col("_after"), F.coalesce("service_charge_percent", F.lit(0)))
    totals = with_after.withColumn("_tax", tax).withColumn("_service", service).withColumn(
        "_total", F.col("_after") + F.col("_tax") + F.col("_service")
    )
    paid = F.when(
        F.col("amount_paid").isNull() | (F.col("amount_paid") < 0), F.col("_total")
    ).otherwise(F.least("amount_paid", "_total"))

    def cents(x: Column) -> Column:
        return round2(x).cast("decimal(20,2)")

    return totals.withColumn("_paid", paid).select(
        *[c for c in carts.columns if c != "amount_paid"],
        cents(F.col("_after")).alias("after_discount"),
        cents(F.col("_tax")).alias("tax_amount"),
        cents(F.col("_service")).alias("service_amount"),
        cents(F.col("_total")).alias("total_amount"),
        cents(F.col("_paid")).alias("amount_paid"),
        cents(F.col("_total") - F.col("_paid")).alias("balance_due"),
    )


def price_modes(shop: Shop) -> DataFrame:
    """(order_id, mode) of every order: sellers pay cost, others retail."""
    from tillbook.plans.seller import users_in_role

    sellers = users_in_role(shop, "Seller").select(F.col("id").alias("user_id"), F.lit("cost").alias("mode"))
    orders = shop.orders.select(F.col("id").alias("order_id"), "user_id").join(sellers, "user_id", "left")
    return orders.select("order_id", F.coalesce("mode", F.lit("retail")).alias("mode"))
