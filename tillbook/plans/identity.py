"""Who an e-mail address or phone number belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.text import is_filled, key_of
from tillbook.operators.ranking import earliest_per_key
from tillbook.sources.shop import Shop


def identities(shop: Shop, customer_email: bool = False) -> DataFrame:
    """One owner per identifier: staff by e-mail or phone, else the customer by phone.

    The either-or condition is two plain key lists instead of a join on OR.
    """
    sources = [
        (shop.users, "email", "staff", 0),
        (shop.users, "phone", "staff", 0),
        (shop.customers, "whatsapp_number", "customer", 1),
    ]
    if customer_email:
        sources.append((shop.customers, "email", "customer", 1))
    lists = [
        table.where(is_filled(F.col(column))).select(
            key_of(F.col(column)).alias("key"),
            F.lit(priority).alias("priority"),
            F.lit(kind).alias("owner_type"),
            F.col("id").alias("owner_id"),
            F.col("name").alias("owner_name"),
        )
        for table, column, kind, priority in sources
    ]
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    return earliest_per_key(union, ["key"], ["priority", "owner_id"]).drop("priority")


def resolve(requests: DataFrame, column: str, shop: Shop, customer_email: bool = False) -> DataFrame:
    """The owner of each request's identifier; null where nobody has it."""
    return (
        requests.withColumn("key", key_of(F.col(column)))
        .join(identities(shop, customer_email), "key", "left").drop("key")
    )


def taken_identifiers(shop: Shop) -> DataFrame:
    """Phones and e-mails in use by any account, each once."""
    def keys(table: DataFrame, column: str, kind: str) -> DataFrame:
        return table.where(is_filled(F.col(column))).select(
            F.lit(kind).alias("kind"), key_of(F.col(column)).alias("key")
        )

    return (
        keys(shop.customers, "whatsapp_number", "phone").union(keys(shop.users, "phone", "phone"))
        .union(keys(shop.customers, "email", "email")).union(keys(shop.users, "email", "email"))
        .distinct()
    )
