"""Status changes, returns, voids, payments and shift closing, as batch jobs.

Each takes current rows and a table of requests and gives the changed rows and
the refused requests with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.common import MONEY, money_sum
from tillbook.functions.money import discount_price, implied_discount_percent, scaled
from tillbook.operators.admission import admit_in_order, admit_whole
from tillbook.operators.changes import fill_missing, rename_values
from tillbook.plans import daybook
from tillbook.session import cut_lineage
from tillbook.sources.schema import ORDER_STATUSES, PAYMENT_METHODS
from tillbook.sources.shop import Shop


def order_transitions(
    orders: DataFrame, items: DataFrame, products: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Status requests (order_id, to_status, requested_at), one per order, in the order they were made.

    Returns the requests with outcome, new status and new total, and the stock
    movements of the accepted ones. Approving takes every line's quantity from
    what its product still holds at that moment. Leaving ``successful`` gives back
    what has not come back yet; to ``return`` it also empties the order. Without
    ``requested_at`` requests go by order id.

    Orders are taken one after the other, each as a whole: one with any line that
    its product can't serve is refused and leaves all stock as it was. As in the
    shop, lines of one product are checked one by one against what it holds
    before the order.
    """
    current = orders.select(
        F.col("id").alias("order_id"), F.col("status").alias("from_status"), "total_amount"
    )
    asked = requests.join(current, "order_id", "left")
    when = F.col("requested_at") if "requested_at" in requests.columns else F.lit(None).cast("timestamp_ntz")
    known = F.col("to_status").isin(*ORDER_STATUSES) & F.col("from_status").isNotNull()
    approving = known & (F.col("to_status") == "successful") & (F.col("from_status") != "successful")
    leaving = known & (F.col("from_status") == "successful") & (F.col("to_status") != "successful")

    lines = items.where("product_id is not null").select(
        "order_id", F.col("id").alias("line_id"), "product_id", "quantity", "returned_quantity"
    )
    outstanding = F.greatest(F.lit(0), F.col("quantity") - F.col("returned_quantity"))
    moving = asked.where(approving | leaving).select("order_id", when.alias("_when"), approving.alias("_takes"))
    events = (
        lines.join(moving, "order_id")
        .withColumn("delta", F.when(F.col("_takes"), -F.col("quantity")).otherwise(outstanding).cast("bigint"))
        .where("delta <> 0").drop("quantity", "returned_quantity")
    )
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").alias("opening"))
    # one reading of the events for the decision, the refusals and the movements
    events = cut_lineage(events)
    served = cut_lineage(admit_whole(
        events, stock, "order_id", "product_id", ["_when", "order_id"], "delta",
        F.coalesce(F.unix_millis(F.col("_when").cast("timestamp")), F.col("order_id")),
    ))
    short = served.where("not admitted").select("order_id", F.lit(True).alias("_short"))
    outcome = (
        F.when(~F.col("to_status").isin(*ORDER_STATUSES), "invalid status")
        .when(F.col("from_status").isNull(), "order not found")
        .when(approving & F.coalesce("_short", F.lit(False)), "not enough stock")
        .otherwise("ok")
    )
    decided = asked.join(short, "order_id", "left").withColumn("outcome", outcome).drop("_short")
    ok = F.col("outcome") == "ok"
    emptied = ok & leaving & (F.col("to_status") == "return")
    decided = decided.withColumn(
        "status", F.when(ok, F.col("to_status")).otherwise(F.col("from_status"))
    ).withColumn("total_amount", F.when(emptied, F.lit(0).cast(MONEY)).otherwise(F.col("total_amount")))
    moves = events.join(short, "order_id", "left_anti").select(
        "order_id", "line_id", "product_id", F.col("delta").cast("bigint").alias("delta")
    )
    return decided, moves


def lines_after_transition(items: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines of orders that left ``successful`` for ``return`` count as fully returned."""
    gone = decided.where(
        "outcome = 'ok' and from_status = 'successful' and to_status = 'return'"
    ).select("order_id", F.lit(True).alias("_gone"))
    return (
        items.join(gone, "order_id", "left")
        .withColumn(
            "returned_quantity",
            F.when(F.col("_gone"), F.col("quantity")).otherwise(F.col("returned_quantity")),
        )
        .select(*items.columns)
    )


def resold_after_return(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Approved orders whose lines all count as returned: approved again after a return."""
    full = items.groupBy("order_id").agg(
        F.bool_and(F.col("returned_quantity") >= F.col("quantity")).alias("all_back")
    )
    return (
        orders.where("status = 'successful'").join(full, orders["id"] == full["order_id"])
        .where("all_back").select("id", "total_amount")
    )


def _apply_returns(
    headers: DataFrame, items: DataFrame, requests: DataFrame, parent: str, open_status: str, several: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared part of both returns: (lines after, figures per parent, refused parents).

    ``requests``: parent, line_id, quantity. A request covers one parent and is
    refused as a whole. Non-positive quantities are ignored. This only plans, and
    each result repeats what it needs of the others; with ``several`` what they
    share is written once, which pays if more than one is used.

    Lines and requests lie in one table that is shuffled by parent once: what a
    line is asked for and what holds for its parent are windows over it, so
    neither is joined back.
    """
    shared = cut_lineage if several else lambda df: df
    kinds = {f.name: f.dataType for f in items.schema.fields}
    concerned = requests.select(parent).distinct()
    lines = items.join(concerned, parent, "left_semi").withColumns({"_line": F.lit(True), "_asked": F.lit(None).cast("bigint")})
    asked = requests.select(
        parent, F.col("line_id").alias("id"), F.lit(False).alias("_line"),
        F.when(F.col("quantity") > 0, F.col("quantity")).cast("bigint").alias("_asked")).repartition(parent)
    # a row without an id is no known line, whatever asks for it
    known = F.col("_line") & F.col("id").isNotNull()
    of_line, of_parent = Window.partitionBy(parent, "id"), Window.partitionBy(parent)
    # both sides of a join by parent and of a shuffle by it lie alike, so the shuffle of their union is planned only where it is needed
    met = lines.unionByName(asked, allowMissingColumns=True).repartition(parent).withColumns({
        "came_back": F.when(known, F.coalesce(F.sum("_asked").over(of_line), F.lit(0))).otherwise(F.coalesce("_asked", F.lit(0))).cast("bigint"),
        "_unmet": F.when(known, False).otherwise(F.col("id").isNull() | ~F.bool_or("_line").over(of_line)),
    })
    met = shared(met.drop("_asked"))

    left = F.col("quantity") - F.col("returned_quantity")
    after = left - F.col("came_back")
    marks = {
        "_foreign": F.bool_or(F.col("_unmet") & (F.col("came_back") > 0)),
        "_over": F.bool_or(known & (F.col("came_back") > left)),
        "all_back": F.bool_and(F.when(known, after <= 0)),
    }
    fault = lambda which: F.coalesce(which, F.lit(False))
    status = headers.select(F.col("id").alias("_parent"), F.col("status").alias("_status"))
    verdict = shared(
        met.groupBy(F.col(parent).alias("_parent")).agg(
            *[x.alias(name) for name, x in marks.items()],
            money_sum(F.col("price") * F.col("came_back"), known).alias("returned_value"),
            money_sum(F.col("price") * after, known).alias("remaining_value"),
        ).join(status, "_parent", "left").withColumn(
            "reason",
            F.when(F.col("_status").isNull(), "not found")
            .when(F.col("_status") != open_status, "not open for returns")
            .when(F.col("_foreign"), "invalid item")
            .when(F.col("_over"), "more than remaining"),
        )
    )
    refused = verdict.where("reason is not null").select(F.col("_parent").alias(parent), "reason")
    # a parent without any line has no figures
    accepted = verdict.where("reason is null and all_back is not null")
    open_ = headers.where(F.col("status") == open_status).select(F.col("id").alias(parent))
    touched = (
        met.withColumns({name: x.over(of_parent) for name, x in marks.items()})
        .where(known & ~fault(F.col("_foreign")) & ~fault(F.col("_over")) & F.col("all_back").isNotNull())
        .join(open_, parent, "left_semi")
        .withColumn("returned_quantity", F.col("returned_quantity") + F.col("came_back"))
        .select(*[F.col(c).cast(kinds[c]) if c in (parent, "id") else F.col(c) for c in items.columns], "came_back")
    )
    figures = accepted.select(F.col("_parent").alias(parent), "returned_value", "remaining_value", "all_back")
    return touched, figures, refused


def order_returns(
    orders: DataFrame, items: DataFrame, requests: DataFrame, several: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Partial or full returns of approved orders: (orders after, lines after, refused).

    The total becomes the value of what is left; with nothing left the status
    becomes ``return``. ``several``: see ``_apply_returns``.
    """
    lines, figures, refused = _apply_returns(orders, items, requests, "order_id", "successful", several)
    after = figures.select(
        "order_id",
        F.col("remaining_value").alias("total_amount"),
        F.when(F.col("all_back"), "return").otherwise("successful").alias("status"),
    )
    return after, lines, refused


def sale_returns(
    sales: DataFrame, items: DataFrame, requests: DataFrame, several: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same at the till: the total shrinks in proportion to the subtotal.

    Total and subtotal keep their ratio, so returning in two steps equals one.
    The balance may become negative: a refund is owed.
    """
    lines, figures, refused = _apply_returns(sales, items, requests, "sale_id", "completed", several)
    money = sales.select(F.col("id").alias("sale_id"), "subtotal", "total_amount", "amount_paid")
    kept = F.col("subtotal") - F.col("returned_value")
    total = F.when(
        F.col("subtotal") > 0, scaled(F.col("total_amount"), kept, F.col("subtotal"))
    ).otherwise(F.col("total_amount"))
    after = (
        figures.join(money, "sale_id").withColumn("_total", total.cast(MONEY)).select(
            "sale_id",
            kept.cast("decimal(20,2)").alias("subtotal"),
            F.col("_total").alias("total_amount"),
            (F.col("_total") - F.col("amount_paid")).cast("decimal(20,2)").alias("balance_due"),
            F.when(F.col("all_back"), "returned").otherwise("completed").alias("status"),
        )
    )
    return after, lines, refused


def void_sales(
    sales: DataFrame, items: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Voids the listed sales (sale_id, voided_by, voided_at): (decisions, stock given back).

    Voided or returned sales are refused; only what is still out goes back to
    stock.
    """
    status = sales.select(F.col("id").alias("sale_id"), "status")
    decided = requests.join(status, "sale_id", "left").withColumn(
        "outcome",
        F.when(F.col("status").isNull(), "not found")
        .when(F.col("status") == "voided", "already voided")
        .when(F.col("status") == "returned", "already returned")
        .otherwise("ok"),
    )
    voided = decided.where("outcome = 'ok'").select("sale_id")
    back = (
        items.join(voided, "sale_id", "left_semi")
        .where("product_id is not null and quantity > returned_quantity")
        .groupBy("product_id")
        .agg(F.sum(F.col("quantity") - F.col("returned_quantity")).cast("bigint").alias("restored"))
    )
    return decided, back


def apply_payments(
    sales: DataFrame, requests: DataFrame, order: list[str], bucket: Column, shifts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Payments (id, sale_id, amount, method, …) taken in order: (requests judged, sales after).

    A payment must be positive, of a known method, on a completed sale, and at
    most the balance left by the payments accepted before it. A refused payment
    uses up nothing and has a ``reason``. With ``shifts``, whoever takes it
    (``staff_id``) must also have a shift open, whose id the request then carries.
    """
    if shifts is not None:
        open_ = daybook.open_shift_ids(shifts)
        requests = requests.drop("shift_id").join(open_, "staff_id", "left")
    status = sales.select(
        F.col("id").alias("sale_id"), F.col("status").alias("_status"), (F.col("balance_due") * 100).cast("bigint").alias("capacity")
    )
    asked = requests.join(status.drop("capacity"), "sale_id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("amount") > 0, F.lit(False)), "invalid amount")
        .when(~F.coalesce(F.col("method").isin(*PAYMENT_METHODS), F.lit(False)), "invalid method")
        .when(F.col("shift_id").isNull() if shifts is not None else F.lit(False), "no open shift")
        .when(F.col("_status").isNull(), "sale not found")
        .when(F.col("_status") != "completed", "sale not completed"),
    ).drop("_status")
    cents = F.when(F.col("reason").isNull(), (F.col("amount") * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    room = status.where("_status = 'completed'").drop("_status")
    judged = admit_in_order(asked.withColumn("_cents", cents), room, "sale_id", order, "_cents", bucket).drop("_cents")
    over = F.when(~F.col("admitted"), F.coalesce("reason", F.lit("more than the balance due")))
    judged = judged.withColumn("reason", over)
    paid = judged.where("admitted").groupBy("sale_id").agg(money_sum("amount").alias("_paid"))
    after = (
        sales.withColumnRenamed("id", "sale_id").join(paid, "sale_id", "left")
        .withColumn("_paid", F.coalesce("_paid", F.lit(0)))
        .select(
            "sale_id", "status", "total_amount",
            (F.col("amount_paid") + F.col("_paid")).cast(MONEY).alias("amount_paid"),
            (F.col("balance_due") - F.col("_paid")).cast(MONEY).alias("balance_due"),
        )
    )
    return judged, after


def payment_rows(judged: DataFrame) -> DataFrame:
    """The payments that the accepted requests become."""
    return judged.where("admitted").select("id", "sale_id", "shift_id", "staff_id", "amount", "method", "created_at")


def close_shifts(shop: Shop, counted: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Closes the open shifts that were counted (shift_id, counted_cash, counted_at).

    Every shift comes back; closed ones carry the counted and the expected cash.
    ``totals`` (shift_id, cash_out_total): kept from earlier closings. They stand
    for shifts that are closed already, and cash movements are read only for the
    others; without it all movements are summed.
    """
    counted = counted.select("shift_id", "counted_cash", "counted_at")
    shifts = shop.pos_shifts.withColumnRenamed("id", "shift_id").drop("expected_cash").join(counted, "shift_id", "left")
    closing = (F.col("status") == "open") & (F.col("counted_cash") >= 0)
    # only the shifts that close now are worked out
    wanted = shifts.where(closing).withColumnRenamed("shift_id", "id")
    due = daybook.expected_cash(shop, wanted).select("shift_id", "expected_cash")
    if totals is None:
        out = daybook.cash_out_per_shift(shop)
    else:
        # a shift that is open now may still have changed
        closed = shifts.where("status = 'closed'").select("shift_id")
        kept = totals.select("shift_id", "cash_out_total").join(closed, "shift_id", "left_semi")
        others = shifts.join(kept, "shift_id", "left_anti").select(F.col("shift_id").alias("id"))
        out = daybook.cash_out_per_shift(shop, others).unionByName(kept)
    sums = shifts.join(due, "shift_id", "left").join(out, "shift_id", "left")
    sums = sums.withColumn("cash_out_total", F.coalesce("cash_out_total", F.lit(0)).cast("decimal(20,2)"))
    return sums.select(
        "shift_id", "staff_id", "opening_cash",
        F.when(closing, F.col("counted_cash")).otherwise(F.col("closing_cash")).cast(MONEY).alias("closing_cash"),
        F.when(closing, F.col("expected_cash")).cast("decimal(20,2)").alias("expected_cash"),
        F.when(closing, F.col("counted_at")).otherwise(F.col("closed_at")).alias("closed_at"),
        F.when(closing, "closed").otherwise(F.col("status")).alias("status"),
        "cash_out_total",
    )


def payments_from_sales(sales: DataFrame) -> DataFrame:
    """One payment per historic sale, for shops that kept none."""
    return sales.select(
        F.col("id").alias("sale_id"), "shift_id", "staff_id",
        F.col("total_amount").alias("amount"), F.col("payment_method").alias("method"), "created_at",
    )


def as_fully_paid(sales: DataFrame) -> DataFrame:
    """Historic sales from before part payments count as paid in full."""
    return sales.withColumn("amount_paid", F.col("total_amount")).withColumn(
        "balance_due", F.lit(0).cast(MONEY)
    )


def with_line_codes(items: DataFrame, products: DataFrame) -> DataFrame:
    """Missing product codes on lines, taken from the product."""
    return fill_missing(items, products, "product_id", "id", ["product_code"])


# Fixed value: text of a legal page nobody has written yet.
PLACEHOLDER = "Update Soon"
LEGAL_COLUMNS = ("terms_content", "return_policy_content", "privacy_policy_content", "about_content")


def with_legal_text(settings: DataFrame) -> DataFrame:
    filled = {c: F.coalesce(c, F.lit(PLACEHOLDER)) for c in LEGAL_COLUMNS}
    return settings.withColumns(filled)


def migrate_prices(products: DataFrame) -> DataFrame:
    """From (price, discount_price) to sale price, percent and the price the percent gives."""
    percent = implied_discount_percent(F.col("price"), F.col("discount_price"))
    kept = [c for c in products.columns if c not in ("price", "discount_price", "purchase_price")]
    bought = F.col("purchase_price") if "purchase_price" in products.columns else F.lit(0)
    return (
        products.select(
            *kept, bought.cast(MONEY).alias("purchase_price"),
            F.col("price").cast(MONEY).alias("sale_price"), percent.alias("discount_percent"),
        )
        .withColumn("discount_price", discount_price(F.col("sale_price"), F.col("discount_percent")))
    )


# Old role words and the roles they became; any other word means Customer.
OLD_ROLES = {"customer": "Customer", "seller": "Seller", "admin": "Admin", "superadmin": "SuperAdmin"}


def role_ids(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the role's id instead of its old word."""
    named = rename_values(F.col("role"), OLD_ROLES, otherwise=F.lit("Customer"))
    ids = roles.select(F.col("id").alias("role_id"), F.col("name").alias("_role"))
    return users.withColumn("_role", named).join(ids, "_role").drop("_role", "role")
