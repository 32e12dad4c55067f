"""The benchmark's order, part and event tables in the roles of a shop.

``trade`` turns orders and line items into online orders and till sales;
``daybook`` turns the event stream into shifts, sales, payments and cash-outs.
Both are plain projections, so column pruning and filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.sources.schema import ROLES
from tillbook.sources.shop import Shop

TRADE_AS_OF = "2001-08-01 00:00:00"
DAYBOOK_AS_OF = "2024-01-31 00:00:00"
DAYBOOK_FROM, DAYBOOK_TO = "2024-01-01", "2024-01-30"

_EPOCH = "timestamp_ntz'2000-01-01 00:00:00'"


# Given, not inferred: opening a table costs no job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
    "pages": "page_id bigint, url string, html string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _brand_number(col: str) -> str:
    return f"cast(replace({col}, 'Brand#', '') as int)"


# The part types, in the order that numbers the subcategories.
_TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
_TYPE_NUMBER = "array_position(array({}), p_type)".format(", ".join(f"'{t}'" for t in _TYPES))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    priced = _read(spark, sf, "part").selectExpr(
        "p_partkey as id",
        f"{_brand_number('p_brand')} as category_id",
        f"cast({_brand_number('p_brand')} * 10 + {_TYPE_NUMBER} as int) as subcategory_id",
        "p_name as name",
        "concat(replace(lower(trim(p_name)), ' ', '-'), '-', p_partkey) as slug",
        "case p_partkey % 10 when 3 then null when 7 then concat('TB-', p_partkey)"
        " else cast(1000 + p_partkey as string) end as product_code",
        "cast(p_retailprice as decimal(10,2)) as sale_price",
        "cast((p_size % 4) * 5 as decimal(5,2)) as discount_percent",
        "p_size - 1 as stock",
        "p_partkey % 10 = 0 as featured",
        "p_partkey % 20 <> 0 as is_active",
        f"timestampadd(DAY, cast(p_partkey as int), {_EPOCH}) as created_at",
    )
    return priced.selectExpr(
        "*",
        "cast(round(sale_price * 0.70, 2) as decimal(10,2)) as purchase_price",
        "cast(round(sale_price - sale_price * discount_percent * 0.01, 2) as decimal(10,2))"
        " as discount_price",
    )


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _read(spark, sf, "part").select("p_brand").distinct()
        .selectExpr(f"{_brand_number('p_brand')} as id", "p_brand as name")
        .selectExpr(
            "id", "name", "concat('brand-', id) as slug", "id % 10 <> 0 as is_active",
            f"timestampadd(DAY, id, {_EPOCH}) as created_at",
        )
    )


def _subcategories(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _read(spark, sf, "part").select("p_brand", "p_type").distinct()
        .selectExpr(
            f"cast({_brand_number('p_brand')} * 10 + {_TYPE_NUMBER} as int) as id",
            f"{_brand_number('p_brand')} as category_id",
            "p_type as name",
        )
        .selectExpr(
            "id", "category_id", "name", "concat('brand-', category_id, '-', lower(name)) as slug",
            "category_id % 10 <> 0 as is_active",
            f"timestampadd(DAY, id, {_EPOCH}) as created_at",
        )
    )


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").selectExpr(
        "c_custkey as id",
        "c_name as name",
        "case when c_custkey = 0 then 'anonymous-guest'"
        " else concat('94', lpad(cast(c_custkey as string), 9, '0')) end as whatsapp_number",
        "case when c_custkey % 3 = 0 then null"
        " else concat(lower(c_mktsegment), c_custkey, '@mail.test') end as email",
        "c_custkey % 15 <> 0 as is_active",
        f"timestampadd(DAY, cast(c_custkey as int), {_EPOCH}) as created_at",
    )


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "supplier").selectExpr(
        "s_suppkey as id",
        "s_name as name",
        "case when s_suppkey = 0 then 'anonymous-seller@internal.local'"
        " else concat('staff', s_suppkey, '@shop.test') end as email",
        "case when s_suppkey % 5 = 0 then concat('94', lpad(cast(s_suppkey as string), 9, '0'))"
        " else concat('77', lpad(cast(s_suppkey as string), 7, '0')) end as phone",
        "case when s_suppkey % 3 = 0 then concat('Shop ', s_suppkey) end as shop_name",
        "concat('City ', s_nationkey) as city",
        "case s_suppkey % 3 when 0 then 3L when 1 then 5L else 2L end as role_id",
        "case s_suppkey % 7 when 5 then 'pending' when 6 then 'rejected' else 'approved' end as status",
        "s_suppkey % 7 < 5 as is_active",
        f"timestampadd(DAY, cast(s_suppkey as int), {_EPOCH}) as created_at",
    )


def user_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ROLES, start=1)), "id bigint, name string")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _read(spark, sf, "orders").where("o_orderpriority < '4'")
        .selectExpr(
            "o_orderkey as id",
            "case when o_orderkey % 4 = 0 then o_custkey % 10 end as user_id",
            "case when o_orderkey % 4 <> 0 then o_custkey end as customer_id",
            "cast(o_totalprice as decimal(10,2)) as total_amount",
            "case o_orderstatus when 'F' then 'successful' when 'O' then 'pending'"
            " else case when o_orderkey % 2 = 0 then 'return' else 'cancelled' end end as status",
            "'cod' as payment_method",
            "case when o_orderkey % 3 <> 0 then concat('Receiver ', o_custkey) end as shipping_name",
            "o_orderdate as created_at",
        )
    )


def _trade_sales(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _read(spark, sf, "orders").where("o_orderpriority >= '4'")
        .selectExpr(
            "o_orderkey as id",
            "o_custkey % 10 as staff_id",
            "o_custkey as customer_id",
            "cast(o_totalprice as decimal(10,2)) as subtotal",
            "o_orderkey",
            "case when o_orderstatus <> 'P' then 'completed'"
            " when o_orderkey % 2 = 0 then 'voided' else 'returned' end as status",
            "element_at(array('cash', 'card', 'cheque'), cast(o_orderkey % 3 as int) + 1)"
            " as payment_method",
            "o_orderdate as created_at",
        )
        .selectExpr(
            "*", "cast(round(subtotal * (o_orderkey % 5) * 0.01, 2) as decimal(10,2)) as discount_amount"
        )
        .selectExpr("*", "cast(subtotal - discount_amount as decimal(10,2)) as total_amount")
        .selectExpr(
            "*",
            "cast(case when o_orderkey % 4 = 0 then round(total_amount * 0.5, 2) else total_amount end"
            " as decimal(10,2)) as amount_paid",
        )
        .selectExpr("*", "cast(total_amount - amount_paid as decimal(10,2)) as balance_due")
        .drop("o_orderkey")
    )


def _lines(spark: SparkSession, sf: str, parent: str) -> DataFrame:
    """Every line; the inner join with a channel's headers keeps that channel's lines."""
    return _read(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id",
        f"l_orderkey as {parent}",
        "l_linenumber as line_no",
        "l_partkey as product_id",
        "concat('Item ', l_partkey) as product_name",
        "case when l_partkey % 10 = 4 then null else cast(1000 + l_partkey as string) end as product_code",
        "cast(round(cast(l_extendedprice as decimal(12,2)) * 0.01, 2) as decimal(10,2)) as price",
        "cast(l_quantity as int) as quantity",
        "cast(case l_returnflag when 'R' then l_quantity when 'A' then floor(l_quantity * 0.5)"
        " else 0 end as int) as returned_quantity",
    )


def trade(spark: SparkSession, sf: str) -> Shop:
    return Shop(
        spark,
        {
            "products": lambda: _products(spark, sf),
            "categories": lambda: _categories(spark, sf),
            "subcategories": lambda: _subcategories(spark, sf),
            "customers": lambda: _customers(spark, sf),
            "users": lambda: _users(spark, sf),
            "user_roles": lambda: user_roles(spark),
            "orders": lambda: _orders(spark, sf),
            "order_items": lambda: _lines(spark, sf, "order_id"),
            "sales": lambda: _trade_sales(spark, sf),
            "sale_items": lambda: _lines(spark, sf, "sale_id"),
        },
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the columns the day book uses."""
    return day_events(_read(spark, sf, "events"))


def day_events(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "event_id", "ts", "user_id", "event_type",
        "cast(ts as date) as day",
        "user_id % 10 as staff_id",
        "cast(value as decimal(10,2)) as v",
        "cast(get_json_object(props, '$.k') as int) as k",
    )


_SHIFT_ID = "cast(datediff(day, date'2024-01-01') as bigint) * 10 + staff_id"


def book_sales(ev: DataFrame) -> DataFrame:
    return (
        ev.where("event_type = 'purchase'")
        .selectExpr(
            "event_id as id",
            f"{_SHIFT_ID} as shift_id",
            "staff_id",
            "user_id as customer_id",
            "v as subtotal",
            "cast(round(v * (k % 5) * 0.01, 2) as decimal(10,2)) as discount_amount",
            "k",
            "element_at(array('cash', 'card', 'cheque'), cast(event_id % 3 as int) + 1) as payment_method",
            "case k % 10 when 0 then 'voided' when 1 then 'returned' else 'completed' end as status",
            "ts as created_at",
        )
        .selectExpr("*", "cast(subtotal - discount_amount as decimal(10,2)) as total_amount")
        .selectExpr(
            "*",
            "cast(case when k % 4 = 0 then round(subtotal * 0.5, 2) else total_amount end"
            " as decimal(10,2)) as amount_paid",
        )
        .selectExpr("*", "cast(total_amount - amount_paid as decimal(10,2)) as balance_due")
        .drop("k")
    )


def _late_payments(ev: DataFrame) -> DataFrame:
    """Clicks that pay towards the user's first sale with a balance, when that sale is earlier."""
    first = (
        book_sales(ev).where("balance_due > 0").groupBy("customer_id")
        .agg(F.min(F.struct("created_at", "id")).alias("first"))
        .selectExpr("customer_id", "first.created_at as first_ts", "first.id as sale_id")
    )
    clicks = ev.where("event_type = 'click' and event_id % 5 = 0")
    return (
        clicks.join(first, clicks.user_id == first.customer_id)
        .where("ts > first_ts")
        .selectExpr(
            "event_id as id", "sale_id", f"{_SHIFT_ID} as shift_id", "staff_id",
            "cast(round(v * 0.1, 2) as decimal(10,2)) as amount", "'cash' as method", "ts as created_at",
        )
    )


def _book_payments(ev: DataFrame) -> DataFrame:
    at_sale = book_sales(ev).selectExpr(
        "id", "id as sale_id", "shift_id", "staff_id", "amount_paid as amount",
        "payment_method as method", "created_at",
    )
    return at_sale.unionByName(_late_payments(ev))


def book_cash_movements(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'error'").selectExpr(
        "event_id as id", f"{_SHIFT_ID} as shift_id", "staff_id",
        "cast(round(v * 0.1, 2) as decimal(10,2)) as amount",
        "element_at(array('Salary', 'Delivery', 'Collection', 'Lunch', 'Other'), k % 5 + 1) as reason",
        "case when k % 2 = 0 then concat('note ', k) end as note",
        "ts as created_at",
    )


def _book_shifts(ev: DataFrame) -> DataFrame:
    last_day = ev.select(F.max("day")).scalar()
    opened = ev.groupBy("staff_id", "day").agg(F.min("ts").alias("opened_at"))
    return opened.withColumn("is_last", F.col("day") == last_day).selectExpr(
        f"{_SHIFT_ID} as id", "staff_id",
        "cast(100 + staff_id as decimal(10,2)) as opening_cash",
        "opened_at",
        "case when not is_last then cast(100 + staff_id + day(day) * 20 as decimal(10,2)) end"
        " as closing_cash",
        "case when not is_last then cast(date_add(day, 1) as timestamp_ntz) end as closed_at",
        "case when is_last then 'open' else 'closed' end as status",
    )


def daybook(spark: SparkSession, sf: str) -> Shop:
    return Shop(
        spark,
        {
            "events": lambda: events(spark, sf),
            "users": lambda: _users(spark, sf),
            "user_roles": lambda: user_roles(spark),
            "customers": lambda: _customers(spark, sf),
            "sales": lambda: book_sales(events(spark, sf)),
            "sale_payments": lambda: _book_payments(events(spark, sf)),
            "cash_movements": lambda: book_cash_movements(events(spark, sf)),
            "pos_shifts": lambda: _book_shifts(events(spark, sf)),
        },
    )


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages")


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _read(spark, sf, name)
