"""Best sellers and hot categories over both channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.common import instant
from tillbook.functions.money import net_quantity
from tillbook.operators.ranking import top_k, top_k_or_fallback
from tillbook.sources.shop import Shop

def by_units() -> list[Column]:
    return [F.col("total_sold").desc(), F.col("id")]


def since(as_of: str | None, days: int | None) -> Column:
    """``created_at >= as_of - days``; always true without a number of days."""
    if not days:
        return F.lit(True)
    return F.col("created_at") >= instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def combined_items(
    shop: Shop, as_of: str | None = None, days: int | None = None, net: bool = False, when: Column | None = None
) -> DataFrame:
    """Sold lines of both channels as (product_id, quantity, created_at).

    Status and date filters sit on the headers, below the joins, and reach the
    files. Lines that carry their header's ``created_at``, as ``sinks.dated_lines``
    writes them, are filtered by it too. ``net`` counts what was kept instead of what was sold;
    ``when`` is a further condition on ``created_at``.
    """
    dated = since(as_of, days) if when is None else since(as_of, days) & when

    def channel(headers: DataFrame, lines: DataFrame, parent: str, status: str) -> DataFrame:
        kept = headers.where((F.col("status") == status) & dated).select(
            F.col("id").alias(parent), "created_at"
        )
        units = net_quantity(F.col("quantity"), F.col("returned_quantity")) if net else F.col("quantity")
        if "created_at" in lines.columns:
            lines = lines.where(dated)
        return (
            lines.where(F.col("product_id").isNotNull()).select(parent, "product_id", units.alias("quantity"))
            .join(kept, parent)
            .select("product_id", "quantity", "created_at")
        )

    online = channel(shop.orders, shop.order_items, "order_id", "successful")
    till = channel(shop.sales, shop.sale_items, "sale_id", "completed")
    return online.unionByName(till)


def product_units(
    shop: Shop, as_of: str | None = None, days: int | None = None, net: bool = False
) -> DataFrame:
    """Units per product: one row per sold product, whatever the number of lines."""
    return (
        combined_items(shop, as_of, days, net).groupBy("product_id")
        .agg(F.sum("quantity").cast("bigint").alias("total_sold"))
    )


def window_units(shop: Shop, as_of: str, days: int = 7, net: bool = False) -> DataFrame:
    """All-time and trailing units per product from one pass over the lines.

    Everything in the rankings and the dashboard derives from this table, which
    has a row per product; write or persist it instead of the lines.
    """
    recent = since(as_of, days)
    return (
        combined_items(shop, net=net).groupBy("product_id")
        .agg(
            F.sum("quantity").cast("bigint").alias("total_sold"),
            F.sum(F.when(recent, F.col("quantity"))).cast("bigint").alias("recent_sold"),
        )
    )


def with_names(products: DataFrame, shop: Shop, subcategory: bool = True) -> DataFrame:
    """Adds category (and subcategory) name and slug; products without one keep nulls."""
    out = products.join(_renamed(shop.categories, "category"), "category_id", "left")
    if subcategory:
        out = out.join(_renamed(shop.subcategories, "subcategory"), "subcategory_id", "left")
    return out


def _renamed(dim: DataFrame, what: str) -> DataFrame:
    return dim.select(
        F.col("id").alias(f"{what}_id"),
        F.col("name").alias(f"{what}_name"),
        F.col("slug").alias(f"{what}_slug"),
    )


def top_products(
    shop: Shop,
    units: DataFrame,
    limit: int,
    in_stock: bool = False,
    subcategory: bool = True,
) -> DataFrame:
    """Most sold active products. Only the winners are joined to the names."""
    products = shop.products.where("is_active")
    if in_stock:
        products = products.where("stock > 0")
    ranked = products.join(units, products["id"] == units["product_id"]).drop("product_id")
    return with_names(top_k(ranked, by_units(), limit), shop, subcategory).orderBy(*by_units())


def _or_newest(shop: Shop, first: DataFrame, limit: int, featured: bool = False) -> DataFrame:
    other = shop.products.where("is_active and stock > 0")
    if featured:
        other = other.where("featured")
    newest = [F.col("created_at").desc(), F.col("id")]
    other = with_names(top_k(other, newest, limit), shop, subcategory=False)
    return top_k_or_fallback(first, by_units(), other, newest, limit)


def best_selling(shop: Shop, limit: int = 5, units: DataFrame | None = None) -> DataFrame:
    """All-time best sellers in stock; the newest products when nothing was sold."""
    units = product_units(shop) if units is None else units
    return _or_newest(shop, top_products(shop, units, limit, in_stock=True), limit)


def featured_products(
    shop: Shop, as_of: str, limit: int = 3, days: int = 7, units: DataFrame | None = None
) -> DataFrame:
    """Best sellers of the last week in stock; the newest featured products otherwise."""
    units = product_units(shop, as_of, days) if units is None else units
    return _or_newest(shop, top_products(shop, units, limit, in_stock=True), limit, featured=True)


def group_units(shop: Shop, units: DataFrame, by: str) -> DataFrame:
    """Rolls product units up to ``category_id`` or ``subcategory_id``."""
    products = shop.products.select(F.col("id").alias("product_id"), by)
    return (
        units.join(products, "product_id").groupBy(by)
        .agg(F.sum("total_sold").cast("bigint").alias("total_sold"))
    )


def _hot(shop: Shop, dim: DataFrame, by: str, as_of: str, limit: int, days: int, units) -> DataFrame:
    units = product_units(shop, as_of, days) if units is None else units
    active = dim.where("is_active")
    first = active.join(group_units(shop, units, by), active["id"] == F.col(by), "inner")
    first = first.select(*[active[c] for c in dim.columns], "total_sold")
    return top_k_or_fallback(first, by_units(), active, [F.col("name"), F.col("id")], limit)


def hot_categories(
    shop: Shop, as_of: str, limit: int = 10, days: int = 7, units: DataFrame | None = None
) -> DataFrame:
    """Active categories by units of the last week; by name when there are none."""
    return _hot(shop, shop.categories, "category_id", as_of, limit, days, units)


def hot_subcategories(
    shop: Shop, as_of: str, limit: int = 10, days: int = 7, units: DataFrame | None = None
) -> DataFrame:
    return _hot(shop, shop.subcategories, "subcategory_id", as_of, limit, days, units)


def ranked_groups(shop: Shop, dim: DataFrame, by: str, units: DataFrame | None = None) -> DataFrame:
    """Every active group with its all-time units, 0 where nothing was sold."""
    units = product_units(shop) if units is None else units
    sums = group_units(shop, units, by).withColumnRenamed(by, "_group")
    active = dim.where("is_active")
    return (
        active.join(sums, active["id"] == sums["_group"], "left").drop("_group")
        .withColumn("total_sold", F.coalesce("total_sold", F.lit(0)))
    )


def by_units_name() -> list[Column]:
    return [F.col("total_sold").desc(), F.col("name"), F.col("id")]


def featured_categories_ranked(shop: Shop, units: DataFrame | None = None) -> DataFrame:
    return ranked_groups(shop, shop.categories, "category_id", units).orderBy(*by_units_name())
