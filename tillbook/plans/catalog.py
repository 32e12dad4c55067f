"""Catalogue, customer and staff lists: search, visibility, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.common import all_of
from tillbook.functions.text import contains_pattern
from tillbook.operators import trigrams
from tillbook.operators.ranking import page
from tillbook.plans.rankings import with_names
from tillbook.sources.schema import ANONYMOUS_CUSTOMER, ANONYMOUS_SELLER, USER_STATUSES
from tillbook.sources.shop import Shop

MANAGERS = ("Admin", "SuperAdmin")
LOW_STOCK = 10

# What a search looks at.
PRODUCT_TEXTS = ["name", "product_code", "category_name", "subcategory_name"]
CUSTOMER_TEXTS = ["name", "whatsapp_number"]

# Which roles see the product code and the cost, by surface, and
# what sellers do not see. A role not named sees neither.
_SEE_CODE = {
    "product": ("Admin", "SuperAdmin", "Staff"),
    "analytics": MANAGERS,
    "wishlist": MANAGERS,
    "order_items": MANAGERS,
}
_RETAIL_PRICES = ("sale_price", "discount_percent", "discount_price")

PUBLIC_SETTINGS = (
    "id", "store_name", "store_short_name", "store_logo", "store_icon", "whatsapp_number", "address",
    "email", "theme_color_light", "theme_color_dark", "active_font", "terms_content",
    "return_policy_content", "privacy_policy_content", "about_content", "updated_at", "pos_is_active",
    "pos_tax_percent", "pos_service_charge_percent", "pos_receipt_phone", "pos_display_price",
)
WHOLESALE_COLUMNS = (
    "id", "slug", "name", "product_code", "purchase_price", "stock",
    "category_name", "category_slug", "subcategory_name", "subcategory_slug",
)


def hidden_columns(surface: str, role: str | None) -> list[str]:
    hidden = []
    sees_code = role in _SEE_CODE[surface]
    if not sees_code:
        hidden.append("product_code")
    if surface == "order_items":
        return hidden
    if not sees_code and role != "Seller":
        hidden.append("purchase_price")
    if role == "Seller" and surface != "wishlist":
        hidden.extend(_RETAIL_PRICES)
    return hidden


def mask_columns(df: DataFrame, surface: str, role: str | None) -> DataFrame:
    return df.drop(*hidden_columns(surface, role))


def allowlist(df: DataFrame, columns) -> DataFrame:
    """The public columns that the table has, in the list's order."""
    return df.select(*[c for c in columns if c in df.columns])


def wanted_active(role: str | None, active: str | None) -> bool:
    """Only managers may ask for inactive rows."""
    if role in MANAGERS and active is not None:
        return active not in ("0", "false")
    return True


def active_flag(df: DataFrame, role: str | None = None, active: str | None = None) -> DataFrame:
    return df.where(F.col("is_active") == F.lit(wanted_active(role, active)))


def stock_visibility(role: str | None, staff: bool, low_stock: bool = False) -> Column:
    """Managers may list low stock; the public sees what is in stock; staff see all."""
    if role in MANAGERS and low_stock:
        return F.col("stock") < LOW_STOCK
    return F.lit(True) if staff else F.col("stock") > 0


def search_products(named: DataFrame, text: str | None) -> DataFrame:
    """Name, code, category or subcategory contains the text, case ignored, ``%`` and ``_`` wild."""
    if not text:
        return named
    return named.where(contains_pattern(text, *[F.col(c) for c in PRODUCT_TEXTS]))


def find_products(named: DataFrame, text: str | None, index: str) -> DataFrame:
    """As ``search_products``, by an index of ``PRODUCT_TEXTS`` (``trigrams.write_index``) instead of a scan of the texts."""
    if not text:
        return named
    found = trigrams.matching_ids(named.sparkSession, index, text)
    return named.join(found, "id", "left_semi")


def product_list(
    shop: Shop,
    role: str | None = None,
    staff: bool = False,
    category: str | None = None,
    subcategory: str | None = None,
    search: str | None = None,
    featured: bool = False,
    active: str | None = None,
    low_stock: bool = False,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """The catalogue as one role sees it, newest first."""
    products = active_flag(shop.products, role, active).where(stock_visibility(role, staff, low_stock))
    if featured:
        products = products.where("featured")
    named = _in_group(with_names(products, shop), category, subcategory)
    found = search_products(named, search)
    return mask_columns(page(found, newest(), limit, offset), "product", role)


def newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id")]


def _in_group(named: DataFrame, category: str | None, subcategory: str | None) -> DataFrame:
    preds = []
    if category:
        preds.append(F.col("category_slug") == category)
    if subcategory:
        preds.append(F.col("subcategory_slug") == subcategory)
    return named.where(all_of(preds))


def product_by_slug(shop: Shop, slugs: DataFrame, role: str | None = None) -> DataFrame:
    """Products for a list of slugs; only managers find inactive ones."""
    products = shop.products if role in MANAGERS else shop.products.where("is_active")
    found = products.join(slugs.select("slug"), "slug", "left_semi")
    return mask_columns(with_names(found, shop), "product", role)


def wholesale_list(
    shop: Shop, category: str | None = None, subcategory: str | None = None, search: str | None = None
) -> DataFrame:
    """Cost-price list: restricted columns, out-of-stock products included."""
    named = _in_group(with_names(shop.products.where("is_active"), shop), category, subcategory)
    return search_products(named, search).orderBy(*newest()).select(*WHOLESALE_COLUMNS)


def customers_list(
    shop: Shop, search: str | None = None, active: bool = True, index: str | None = None
) -> DataFrame:
    """Customers without the shared guest account, newest first.

    ``index``: the folder of an index of ``CUSTOMER_TEXTS``; without it a search scans the texts.
    """
    rows = shop.customers.where(
        (F.col("is_active") == F.lit(active)) & (F.col("whatsapp_number") != ANONYMOUS_CUSTOMER)
    )
    if search and index:
        rows = rows.join(trigrams.matching_ids(shop.spark, index, search), "id", "left_semi")
    elif search:
        rows = rows.where(contains_pattern(search, *[F.col(c) for c in CUSTOMER_TEXTS]))
    return rows.orderBy(*newest()).select(
        "id", "name", "email", F.col("whatsapp_number").alias("phone"), "is_active", "created_at"
    )


def users_list(shop: Shop, status: str | None = None) -> DataFrame:
    """Staff and sellers of one status (approved unless a known one is asked for)."""
    status = status if status in USER_STATUSES else "approved"
    roles = shop.user_roles.where(F.col("name").isin("Admin", "Seller", "Staff")).select(
        F.col("id").alias("role_id"), F.col("name").alias("role")
    )
    rows = shop.users.where((F.col("status") == status) & (F.col("email") != ANONYMOUS_SELLER))
    return rows.join(roles, "role_id").orderBy(*newest()).select(
        "id", "name", "email", "phone", "shop_name", "city", "role", "status", "is_active", "created_at"
    )


def subcategory_list(
    shop: Shop, role: str | None = None, active: str | None = None, category: str | None = None
) -> DataFrame:
    cats = shop.categories.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("slug").alias("category_slug"),
    )
    rows = active_flag(shop.subcategories, role, active).join(cats, "category_id")
    if category:
        rows = rows.where(F.col("category_slug") == category)
    return rows.orderBy("name", "id")


def content_list(df: DataFrame, order: list[Column], role: str | None = None, active: str | None = None) -> DataFrame:
    """Offers, banners, blogs, categories: active rows in display order."""
    return active_flag(df, role, active).orderBy(*order)


def wishlist(shop: Shop, items: DataFrame) -> DataFrame:
    """Wished products with category for every owner, newest wish first."""
    cats = shop.categories.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("slug").alias("category_slug"),
    )
    products = shop.products.withColumnRenamed("id", "product_id").withColumnRenamed("created_at", "listed_at")
    return (
        items.join(products, "product_id").join(cats, "category_id", "left")
        .orderBy("owner_type", "owner_id", F.col("created_at").desc(), "product_id")
    )
