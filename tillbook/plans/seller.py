"""Wholesale: what sellers ordered, at cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.common import money_sum
from tillbook.operators.ranking import top_k
from tillbook.plans.dashboard import status_breakdown
from tillbook.plans.rankings import by_units, since
from tillbook.sources.shop import Shop


def users_in_role(shop: Shop, role: str) -> DataFrame:
    wanted = shop.user_roles.where(F.col("name") == role).select(F.col("id").alias("role_id"))
    return shop.users.join(wanted, "role_id", "left_semi")


def seller_orders(shop: Shop) -> DataFrame:
    sellers = users_in_role(shop, "Seller").select(F.col("id").alias("user_id"))
    return shop.orders.join(sellers, "user_id", "left_semi")


def approved_lines(shop: Shop, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Lines of approved seller orders: (product_id, quantity, created_at)."""
    orders = seller_orders(shop).where((F.col("status") == "successful") & since(as_of, days))
    headers = orders.select(F.col("id").alias("order_id"), "created_at")
    return shop.order_items.select("order_id", "product_id", "quantity").join(headers, "order_id")


def _costs(shop: Shop) -> DataFrame:
    return shop.products.select(F.col("id").alias("product_id"), "purchase_price")


def totals(shop: Shop) -> DataFrame:
    """Cost, units, approved orders and active products as one row.

    Lines are reduced to units per product before they meet the prices, so the
    price join carries one row per product.
    """
    units = approved_lines(shop).groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("units"))
    priced = units.join(_costs(shop), "product_id", "left").select(
        F.lit(0).alias("part"),
        (F.col("units") * F.col("purchase_price")).cast("decimal(20,2)").alias("cost"),
        "units",
    )
    none = F.lit(None)
    orders = seller_orders(shop).where("status = 'successful'").select(
        F.lit(1).alias("part"), none.cast("decimal(20,2)").alias("cost"), none.cast("bigint").alias("units")
    )
    products = shop.products.where("is_active").select(
        F.lit(2).alias("part"), none.cast("decimal(20,2)").alias("cost"), none.cast("bigint").alias("units")
    )
    return priced.unionByName(orders).unionByName(products).agg(
        money_sum("cost").alias("total_cost"),
        F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("units_sold"),
        F.count(F.when(F.col("part") == 1, 1)).alias("order_count"),
        F.count(F.when(F.col("part") == 2, 1)).alias("product_count"),
    )


def cost_by_day(shop: Shop, as_of: str, days: int = 30) -> DataFrame:
    units = (
        approved_lines(shop, as_of, days)
        .groupBy(F.to_date("created_at").alias("day"), "product_id")
        .agg(F.sum("quantity").cast("bigint").alias("units"))
    )
    return (
        units.join(_costs(shop), "product_id").groupBy("day")
        .agg(money_sum((F.col("units") * F.col("purchase_price")).cast("decimal(20,2)")).alias("cost"))
        .orderBy("day")
    )


def top_products(shop: Shop, limit: int = 10) -> DataFrame:
    units = (
        approved_lines(shop).groupBy(F.col("product_id").alias("id"))
        .agg(F.sum("quantity").cast("bigint").alias("total_sold"))
    )
    products = shop.products.where("is_active").select(
        "id", "name", "product_code", "purchase_price", "category_id"
    )
    best = top_k(products.join(units, "id"), by_units(), limit)
    names = shop.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return best.join(names, "category_id", "left").select(
        "id", "name", "product_code", "purchase_price", "category_name", "total_sold",
        (F.col("total_sold") * F.col("purchase_price")).cast("decimal(20,2)").alias("total_cost"),
    ).orderBy(*by_units())


def seller_status(shop: Shop) -> DataFrame:
    return status_breakdown(seller_orders(shop))
