"""Explicit schemas of the shop tables (columnar at rest, money as decimals)."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "user_roles": ("id bigint, name string"),
    "users": (
        "id bigint, name string, email string, phone string, address string, shop_name string,"
        " city string, role_id bigint, status string, is_active boolean, created_at timestamp_ntz"
    ),
    "customers": (
        "id bigint, name string, whatsapp_number string, email string, is_active boolean,"
        " created_at timestamp_ntz"
    ),
    "categories": ("id bigint, name string, slug string, is_active boolean, created_at timestamp_ntz"),
    "subcategories": (
        "id bigint, category_id bigint, name string, slug string, is_active boolean,"
        " created_at timestamp_ntz"
    ),
    "products": (
        "id bigint, category_id bigint, subcategory_id bigint, name string, slug string,"
        " product_code string, description string, purchase_price decimal(10,2),"
        " sale_price decimal(10,2), discount_percent decimal(5,2), discount_price decimal(10,2),"
        " stock int, featured boolean, is_active boolean, created_at timestamp_ntz"
    ),
    "orders": (
        "id bigint, user_id bigint, customer_id bigint, total_amount decimal(10,2), status string,"
        " payment_method string, shipping_name string, shipping_phone string,"
        " shipping_address string, created_at timestamp_ntz"
    ),
    "order_items": (
        "id bigint, order_id bigint, product_id bigint, product_name string, product_code string,"
        " price decimal(10,2), quantity int, returned_quantity int"
    ),
    "wishlist_items": (
        "id bigint, owner_type string, owner_id bigint, product_id bigint, created_at timestamp_ntz"
    ),
    "offers": ("id bigint, image string, is_active boolean, created_at timestamp_ntz"),
    "banners": ("id bigint, image string, is_active boolean, created_at timestamp_ntz"),
    "blogs": (
        "id bigint, subject string, message string, images string, is_active boolean,"
        " created_at timestamp_ntz"
    ),
    "otp_codes": (
        "id bigint, identifier string, purpose string, payload string, attempts int,"
        " expires_at timestamp_ntz, verified_at timestamp_ntz, created_at timestamp_ntz"
    ),
    "settings": (
        "id bigint, store_name string, store_short_name string, store_logo string, store_icon string,"
        " whatsapp_number string, address string, email string, theme_color_light string,"
        " theme_color_dark string, active_font string, terms_content string,"
        " return_policy_content string, privacy_policy_content string, about_content string,"
        " pos_is_active boolean, pos_tax_percent decimal(5,2),"
        " pos_service_charge_percent decimal(5,2), pos_receipt_phone string,"
        " pos_display_price string, updated_at timestamp_ntz"
    ),
    "fonts": ("id bigint, name string, family_param string, created_at timestamp_ntz"),
    "home_sections": ("id bigint, section_key string, position int, is_visible boolean"),
    "pos_shifts": (
        "id bigint, staff_id bigint, opening_cash decimal(10,2), opened_at timestamp_ntz,"
        " closing_cash decimal(10,2), expected_cash decimal(10,2), closed_at timestamp_ntz,"
        " status string"
    ),
    "sales": (
        "id bigint, shift_id bigint, staff_id bigint, customer_id bigint, subtotal decimal(10,2),"
        " discount_amount decimal(10,2), tax_percent decimal(5,2),"
        " service_charge_percent decimal(5,2), total_amount decimal(10,2),"
        " amount_paid decimal(10,2), balance_due decimal(10,2), payment_method string,"
        " status string, voided_at timestamp_ntz, voided_by bigint, created_at timestamp_ntz"
    ),
    "sale_items": (
        "id bigint, sale_id bigint, product_id bigint, product_name string, product_code string,"
        " price decimal(10,2), quantity int, returned_quantity int"
    ),
    "sale_payments": (
        "id bigint, sale_id bigint, shift_id bigint, staff_id bigint, amount decimal(10,2),"
        " method string, created_at timestamp_ntz"
    ),
    "cash_movements": (
        "id bigint, shift_id bigint, staff_id bigint, amount decimal(10,2), reason string,"
        " note string, created_at timestamp_ntz"
    ),
    "pos_holds": (
        "id bigint, staff_id bigint, customer_id bigint, items string, note string,"
        " created_at timestamp_ntz"
    ),
}


def struct_of(table: str) -> T.StructType:
    """The table's schema as a struct (needs a session)."""
    return T.StructType.fromDDL(TABLES[table])


# Tables that may be exported.
EXPORTABLE_TABLES = (
    "user_roles", "users", "customers", "categories", "subcategories", "products",
    "orders", "order_items", "wishlist_items", "offers", "banners", "blogs",
    "otp_codes", "settings", "fonts", "home_sections",
)

# Domains of the enumerated columns.
ORDER_STATUSES = ("pending", "successful", "return", "cancelled")
SALE_STATUSES = ("completed", "voided", "returned")
USER_STATUSES = ("pending", "approved", "rejected")
PAYMENT_METHODS = ("cash", "card", "cheque")
CASH_OUT_REASONS = ("Salary", "Delivery", "Collection", "Lunch", "Other")
ROLES = ("SuperAdmin", "Admin", "Seller", "Customer", "Staff")
ASSIGNABLE_ROLES = ("Seller", "Admin", "Staff")
ANONYMOUS_CUSTOMER = "anonymous-guest"
ANONYMOUS_SELLER = "anonymous-seller@internal.local"
HOME_SECTIONS = (
    "offer_banner", "hot_categories", "featured_products", "featured_categories",
    "subcategory_spotlight", "best_selling", "banner_carousel", "all_products",
)
