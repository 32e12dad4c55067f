"""Stock: what moved it, what is left, and which requests it can serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.operators.admission import admit_in_order, admit_whole
from tillbook.operators.running import running
from tillbook.sources.shop import Shop

# The order in which effects at the same instant are read, and their names.
MOVES = ("approval", "order_return", "sale", "sale_return", "void")


def stock_movements(shop: Shop) -> DataFrame:
    """Every effect on stock, signed: (product_id, created_at, kind, line_id, delta).

    Approved orders and all sales take their quantity; returns give back what
    came back (everything on a fully returned order or sale); a voided sale
    gives back the rest.
    """
    q, r = F.col("quantity"), F.col("returned_quantity")
    status = F.col("status")

    def channel(headers: DataFrame, lines: DataFrame, parent: str) -> DataFrame:
        heads = headers.select(F.col("id").alias(parent), "status", "created_at")
        cols = [parent, F.col("id").alias("line_id"), "product_id", "quantity", "returned_quantity"]
        return lines.where("product_id is not null").select(*cols).join(heads, parent)

    def effects(lines: DataFrame, kinds: list[tuple[str, Column]]) -> DataFrame:
        """One pass over the lines: each line carries its few possible effects."""
        entries = F.array(*[F.struct(F.lit(k).alias("kind"), d.cast("bigint").alias("delta")) for k, d in kinds])
        return lines.select("product_id", "created_at", "line_id", F.inline(entries)).where("delta <> 0")

    online = channel(
        shop.orders.where(status.isin("successful", "return")), shop.order_items, "order_id"
    )
    till = channel(shop.sales, shop.sale_items, "sale_id")
    gone = F.when(status.isin("return", "returned"), q).otherwise(r)
    return effects(online, [("approval", -q), ("order_return", gone)]).unionByName(
        effects(
            till,
            [
                ("sale", -q),
                ("sale_return", gone),
                ("void", F.when(status == "voided", F.greatest(F.lit(0), q - r)).otherwise(F.lit(0))),
            ],
        )
    )


def stock_balance(shop: Shop) -> DataFrame:
    """Opening stock, net movement and what that leaves, for every product."""
    moved = stock_movements(shop).groupBy(F.col("product_id").alias("id")).agg(F.sum("delta").alias("moved"))
    return shop.products.select("id", "stock").join(moved, "id", "left").select(
        F.col("id").alias("product_id"),
        F.col("stock").cast("bigint").alias("opening"),
        F.coalesce("moved", F.lit(0)).alias("moved"),
        (F.col("stock") + F.coalesce("moved", F.lit(0))).alias("balance"),
    )


def stock_ledger(shop: Shop, unit: str = "hour") -> DataFrame:
    """Stock after each movement, running per product through time.

    ``unit`` is the time span of one product that is walked in one piece.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in MOVES]), F.col("kind"))
    moves = stock_movements(shop).withColumn("step", rank.cast("int"))
    walked = running(
        moves, ["product_id"], ["created_at", "step", "line_id"], F.col("delta"), "_moved",
        bucket=F.date_trunc(unit, "created_at"), null_keys=False,
    )
    opening = shop.products.select(F.col("id").alias("product_id"), "stock")
    return walked.join(opening, "product_id").select(
        "product_id", "created_at", "kind", "line_id", "delta",
        (F.col("stock") + F.col("_moved")).cast("bigint").alias("balance"),
    )


def lines_in_stock(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``in_stock``: the line alone could be served now. Unknown products cannot."""
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").alias("_stock"))
    return lines.join(stock, "product_id", "left").withColumn(
        "in_stock", F.coalesce(F.col("_stock") >= F.col("quantity"), F.lit(False))
    ).drop("_stock")


def reserve_stock(
    lines: DataFrame, products: DataFrame, order: list[str], bucket: Column
) -> DataFrame:
    """Adds ``admitted``: lines served in request order while their product lasts.

    Products are independent of each other: a line that fits is served even if
    another line of its cart is not. For carts sold as a whole see ``whole_carts``.
    """
    capacity = products.select(F.col("id").alias("product_id"), F.col("stock").alias("capacity"))
    return admit_in_order(lines, capacity, "product_id", order, "quantity", bucket)


def whole_carts(lines: DataFrame, products: DataFrame, cart: str, order: list[str], bucket: Column) -> DataFrame:
    """(cart, lines, accepted): carts served one after the other, each as a whole or not at all.

    A cart is refused if any line asks for more than its product then holds, and
    leaves all stock to later carts. ``order`` is the same in a cart's lines and
    ends with the cart.
    """
    opening = products.select(F.col("id").alias("product_id"), F.col("stock").alias("opening"))
    taken = admit_whole(lines.withColumn("_taken", -F.col("quantity")), opening, cart, "product_id", order, "_taken", bucket)
    sizes = lines.groupBy(cart).agg(F.count(F.lit(1)).alias("lines"))
    return sizes.join(taken, cart).select(cart, "lines", F.col("admitted").alias("accepted"))
