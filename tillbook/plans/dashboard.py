"""The retail dashboard: revenue, counts, breakdowns and rankings."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.common import money_sum
from tillbook.operators.ranking import top_k
from tillbook.plans import rankings
from tillbook.sources.shop import Shop


def retail_orders(shop: Shop) -> DataFrame:
    """Orders placed by customers; seller orders are reported on their own."""
    return shop.orders.where("customer_id is not null")


def earned(shop: Shop, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Amounts that count as revenue, both channels: (created_at, total_amount)."""
    recent = rankings.since(as_of, days)
    cols = ["created_at", "total_amount"]
    online = retail_orders(shop).where((F.col("status") == "successful") & recent).select(*cols)
    till = shop.sales.where((F.col("status") == "completed") & recent).select(*cols)
    return online.unionByName(till)


def revenue(shop: Shop) -> DataFrame:
    return earned(shop).agg(money_sum("total_amount").alias("revenue"))


def counts(shop: Shop) -> DataFrame:
    """Retail orders, active products and customers as one row."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("what"))

    pile = (
        counted(retail_orders(shop), "order_count")
        .unionByName(counted(shop.products.where("is_active"), "product_count"))
        .unionByName(counted(shop.customers, "customer_count"))
    )
    names = ("order_count", "product_count", "customer_count")
    return pile.agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])


def revenue_by_day(shop: Shop, as_of: str, days: int = 30) -> DataFrame:
    return (
        earned(shop, as_of, days).groupBy(F.to_date("created_at").alias("day"))
        .agg(money_sum("total_amount").alias("revenue"))
        .orderBy("day")
    )


def status_breakdown(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def dash_top_products(shop: Shop, limit: int = 10, units: DataFrame | None = None) -> DataFrame:
    units = rankings.product_units(shop) if units is None else units
    return rankings.top_products(shop, units, limit, subcategory=False)


def _top_groups(shop: Shop, dim: DataFrame, by: str, limit: int, units) -> DataFrame:
    ranked = rankings.ranked_groups(shop, dim, by, units)
    return top_k(ranked, rankings.by_units_name(), limit).select("id", "name", "total_sold")


def top_categories(shop: Shop, limit: int = 5, units: DataFrame | None = None) -> DataFrame:
    return _top_groups(shop, shop.categories, "category_id", limit, units)


def top_subcategories(shop: Shop, limit: int = 5, units: DataFrame | None = None) -> DataFrame:
    return _top_groups(shop, shop.subcategories, "subcategory_id", limit, units)


def recent_orders(shop: Shop, limit: int = 10, keys_checked: bool = True) -> DataFrame:
    """Newest retail orders; the customer's name is joined to the kept rows only.

    The shop enforces that an order's customer exists. Where that is in doubt
    (see ``quality.orphans``), ``keys_checked=False`` leaves orphans out first.
    """
    orders = retail_orders(shop)
    if not keys_checked:
        known = shop.customers.select(F.col("id").alias("customer_id"))
        orders = orders.join(known, "customer_id", "left_semi")
    order = [F.col("created_at").desc(), F.col("id").desc()]
    newest = top_k(orders, order, limit)
    names = shop.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    return newest.join(names, "customer_id").select(
        "id", "total_amount", "status", "created_at", "customer_name"
    ).orderBy(*order)


@contextmanager
def dashboard(shop: Shop, as_of: str):
    """All sections as named DataFrames.

    The lines are read once: every ranking shares one persisted table with a
    row per product, released when the block ends.
    """
    units = rankings.window_units(shop, as_of).persist()
    try:
        yield {
            "revenue": revenue(shop),
            "counts": counts(shop),
            "revenue_by_day": revenue_by_day(shop, as_of),
            "status_breakdown": status_breakdown(retail_orders(shop)),
            "top_products": dash_top_products(shop, units=units.drop("recent_sold")),
            "top_categories": top_categories(shop, units=units.drop("recent_sold")),
            "top_subcategories": top_subcategories(shop, units=units.drop("recent_sold")),
            "recent_orders": recent_orders(shop),
        }
    finally:
        units.unpersist()
