"""Till reports: end of day (Z), mid shift (X), staff sales and cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.common import MONEY_SUM, count_where, day_literal, money_sum
from tillbook.operators.admission import admit_with_inflows
from tillbook.operators.ranking import latest_per_key
from tillbook.operators.running import running
from tillbook.sources.shop import Shop

def completed() -> Column:
    return F.col("status") == "completed"


def on_days(start: str, end: str, col: str = "created_at") -> Column:
    """Both days inclusive; Catalyst turns it into a pushed timestamp range."""
    return F.to_date(col).between(day_literal(start), day_literal(end))


def own_rows(df: DataFrame, staff_id: int | None, col: str = "staff_id") -> DataFrame:
    """Staff see their own rows, managers (no id) all of them."""
    return df if staff_id is None else df.where(F.col(col) == staff_id)


def _sale_figures() -> list[Column]:
    return [
        count_where(completed()).alias("transaction_count"),
        money_sum("total_amount", completed()).alias("total_sales"),
        money_sum("discount_amount", completed()).alias("total_discount"),
        money_sum("balance_due", completed()).alias("total_balance_due"),
        count_where(F.col("status") == "voided").alias("voided_count"),
        count_where(F.col("status") == "returned").alias("returned_count"),
    ]


def z_totals(shop: Shop, start: str, end: str, staff_id: int | None = None) -> DataFrame:
    """All figures of the range in one conditional aggregate over one scan."""
    return own_rows(shop.sales.where(on_days(start, end)), staff_id).agg(*_sale_figures())


def totals_and_days(shop: Shop, start: str, end: str, staff_id: int | None = None) -> DataFrame:
    """The range's figures (``day`` null) and every day's, from one scan."""
    sales = own_rows(shop.sales.where(on_days(start, end)), staff_id)
    return sales.withColumn("day", F.to_date("created_at")).rollup("day").agg(*_sale_figures())


def z_payments(shop: Shop, start: str, end: str, staff_id: int | None = None) -> DataFrame:
    """Payments received in the range, by method.

    Counts by the payment's date and any sale not voided, so it does not
    reconcile with the totals when a balance is paid on a later day. The staff
    filter is that of the sale. A sale is made before it is paid, so later ones
    are not read.
    """
    made = F.to_date("created_at") <= day_literal(end)
    sales = own_rows(shop.sales.where(made), staff_id).where("status <> 'voided'")
    return (
        shop.sale_payments.where(on_days(start, end))
        .join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
        .groupBy("method").agg(money_sum("amount").alias("total"))
    )


def date_spine(spark, start: str, end: str) -> DataFrame:
    """One row per calendar day, both ends included."""
    days = F.explode(F.sequence(day_literal(start), day_literal(end), F.expr("INTERVAL 1 DAY")))
    return spark.range(1).select(days.alias("day"))


def cash_out_by_day(shop: Shop, start: str, end: str, staff_id: int | None = None) -> DataFrame:
    return (
        own_rows(shop.cash_movements.where(on_days(start, end)), staff_id)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(money_sum("amount").alias("total_cash_out"))
    )


def z_days(
    shop: Shop, start: str, end: str, staff_id: int | None = None, mode: str = "sales_days"
) -> DataFrame:
    """Per-day figures with that day's cash-outs, newest first.

    ``sales_days`` lists days with sales only, so a day with nothing but a
    cash-out is missing; ``calendar`` lists every day of the range.
    """
    figures = (
        own_rows(shop.sales.where(on_days(start, end)), staff_id)
        .groupBy(F.to_date("created_at").alias("day")).agg(*_sale_figures())
    )
    if mode == "calendar":
        figures = date_spine(shop.spark, start, end).join(figures, "day", "left")
    elif mode != "sales_days":
        raise ValueError(f"unknown mode {mode!r}")
    cash = cash_out_by_day(shop, start, end, staff_id)
    days = figures.join(cash, "day", "left")
    filled = [F.coalesce(c, F.lit(0)).cast(days.schema[c].dataType).alias(c) for c in days.columns if c != "day"]
    return days.select("day", *filled).orderBy(F.col("day").desc())


def of_shifts(facts: DataFrame, shifts: DataFrame | None) -> DataFrame:
    """The facts of these shifts (id) only, before anything is aggregated or joined."""
    return facts if shifts is None else facts.join(shifts.select(F.col("id").alias("shift_id")), "shift_id", "left_semi")


def cash_out_per_shift(shop: Shop, shifts: DataFrame | None = None) -> DataFrame:
    return of_shifts(shop.cash_movements, shifts).groupBy("shift_id").agg(money_sum("amount").alias("cash_out_total"))


def with_staff(df: DataFrame, shop: Shop) -> DataFrame:
    staff = shop.users.select(F.col("id").alias("staff_id"), F.col("name").alias("staff_name"))
    return df.join(staff, "staff_id")


def z_shifts(shop: Shop, start: str, end: str, staff_id: int | None = None) -> DataFrame:
    """Shifts opened in the range with staff and cash-out total.

    The sum over these totals belongs to the shifts opened in the range; the
    days' ``total_cash_out`` goes by the movement's own date.
    """
    shifts = own_rows(shop.pos_shifts.where(on_days(start, end, "opened_at")), staff_id)
    out = cash_out_per_shift(shop, shifts).withColumnRenamed("shift_id", "id")
    return (
        with_staff(shifts, shop).join(out, "id", "left")
        .withColumn("cash_out_total", F.coalesce("cash_out_total", F.lit(0)).cast(MONEY_SUM))
        .orderBy(F.col("opened_at").desc(), "id")
    )


def staff_sales(shop: Shop, start: str, end: str) -> DataFrame:
    """Completed sales per day and staff, latest day and highest total first."""
    figures = (
        shop.sales.where(completed() & on_days(start, end))
        .groupBy(F.to_date("created_at").alias("day"), "staff_id")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money_sum("total_amount").alias("total_sales"),
            money_sum("discount_amount").alias("total_discount"),
        )
    )
    return with_staff(figures, shop).orderBy(F.col("day").desc(), F.col("total_sales").desc(), "staff_id")


def valid_payments(shop: Shop, shifts: DataFrame | None = None) -> DataFrame:
    """Payments, of all shifts or of these, on sales that were not voided.

    A plain join, as sales have one row per id: the few payments of a few shifts
    can then be the side that is broadcast.
    """
    kept = shop.sales.where("status <> 'voided'").select(F.col("id").alias("sale_id"))
    return of_shifts(shop.sale_payments, shifts).join(kept, "sale_id")


def payments_by_shift(shop: Shop, shifts: DataFrame | None = None) -> DataFrame:
    """Sum per shift and method, the payment's own shift."""
    return valid_payments(shop, shifts).groupBy("shift_id", "method").agg(money_sum("amount").alias("total"))


def _with_cash(shifts: DataFrame, shop: Shop, received: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Shifts with cash received (shift_id, cash_collected), cash taken out, and what should be there."""
    zero = F.lit(0).cast(MONEY_SUM)
    joined = (
        shifts.withColumnRenamed("id", "shift_id").drop("expected_cash")
        .join(received, "shift_id", "left").join(cash_out_per_shift(shop, wanted), "shift_id", "left")
        .withColumn("cash_collected", F.coalesce("cash_collected", zero))
        .withColumn("cash_out_total", F.coalesce("cash_out_total", zero))
    )
    expected = F.col("opening_cash") + F.col("cash_collected") - F.col("cash_out_total")
    return joined.withColumn("expected_cash", expected.cast(MONEY_SUM))


def expected_cash(shop: Shop, shifts: DataFrame | None = None) -> DataFrame:
    """Opening float plus cash received minus cash taken out, for every shift or for these."""
    received = (
        valid_payments(shop, shifts).where("method = 'cash'")
        .groupBy("shift_id").agg(money_sum("amount").alias("cash_collected"))
    )
    return _with_cash(shop.pos_shifts if shifts is None else shifts, shop, received, shifts).select(
        "shift_id", "staff_id", "status", "opening_cash", "opened_at", "closing_cash", "closed_at",
        "cash_collected", "cash_out_total", "expected_cash",
    )


def shift_variance(shop: Shop) -> DataFrame:
    """Counted against expected cash of closed shifts."""
    return (
        expected_cash(shop).where("status = 'closed'")
        .withColumn("variance", (F.col("closing_cash") - F.col("expected_cash")).cast(MONEY_SUM))
        .select("shift_id", "staff_id", "closing_cash", "expected_cash", "variance")
    )


def open_shifts(shop: Shop, staff_id: int | None = None) -> DataFrame:
    return own_rows(shop.pos_shifts.where("status = 'open'"), staff_id)


def open_shift_ids(shifts: DataFrame) -> DataFrame:
    """(staff_id, shift_id): the latest open shift of each staff member."""
    latest = latest_per_key(shifts.where("status = 'open'"), ["staff_id"], ["opened_at", "id"])
    return latest.select("staff_id", F.col("id").alias("shift_id"))


def current_shift(shop: Shop) -> DataFrame:
    """The latest open shift of each staff member."""
    return latest_per_key(open_shifts(shop), ["staff_id"], ["opened_at", "id"])


def double_open_shifts(shop: Shop) -> DataFrame:
    """Staff with more than one open shift, which the till must not allow."""
    return (
        open_shifts(shop).groupBy("staff_id")
        .agg(F.count(F.lit(1)).alias("open_shifts"), F.min("id").alias("first_shift"))
        .where("open_shifts > 1")
    )


def x_report(shop: Shop, staff_id: int | None = None) -> DataFrame:
    """A row per open shift: sales figures, payments by method, expected cash.

    Each fact table is reduced by shift once for all shifts together; the
    payments come as an array of (method, total), at most one per method.
    """
    shifts = open_shifts(shop, staff_id)
    live = shifts.select(F.col("id").alias("shift_id"))
    figures = (
        shop.sales.join(live, "shift_id", "left_semi").where(completed()).groupBy("shift_id")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money_sum("total_amount").alias("total_sales"),
            money_sum("discount_amount").alias("total_discount"),
            money_sum("balance_due").alias("total_balance_due"),
        )
    )
    paid = (
        payments_by_shift(shop, shifts).groupBy("shift_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("method", "total"))).alias("payments"),
            money_sum("total", F.col("method") == "cash").alias("cash_collected"),
        )
    )
    report = with_staff(_with_cash(shifts, shop, paid, shifts), shop).join(figures, "shift_id", "left")
    zero = F.lit(0).cast(MONEY_SUM)
    return report.select(
        "shift_id", "staff_id", "staff_name", "opened_at", "opening_cash",
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("total_sales", "total_discount", "total_balance_due")
        ],
        F.coalesce("payments", F.array().cast(paid.schema["payments"].dataType)).alias("payments"),
        "cash_collected", "cash_out_total", "expected_cash",
    ).orderBy(F.col("opened_at").desc(), "shift_id")


def cash_outs(shop: Shop) -> DataFrame:
    """Cash taken out with the staff's name, by shift, newest first."""
    return with_staff(shop.cash_movements, shop).orderBy(
        "shift_id", F.col("created_at").desc(), F.col("id").desc()
    )


def cash_events(shop: Shop) -> DataFrame:
    """Signed cash events of every shift: cash payments in, movements out."""
    into = valid_payments(shop).where("method = 'cash'").select(
        "shift_id", "created_at", F.lit("in").alias("kind"), "id", F.col("amount").alias("delta")
    )
    out = shop.cash_movements.select(
        "shift_id", "created_at", F.lit("out").alias("kind"), "id", (-F.col("amount")).alias("delta")
    )
    return into.unionByName(out)


def cash_balance(shop: Shop) -> DataFrame:
    """Till balance after each cash event, running within the shift."""
    events = running(
        cash_events(shop), ["shift_id"], ["created_at", "kind", "id"], F.col("delta"), "moved",
        bucket=F.date_trunc("hour", "created_at"), null_keys=False,
    )
    opening = shop.pos_shifts.select(F.col("id").alias("shift_id"), "opening_cash")
    return events.join(opening, "shift_id").select(
        "shift_id", "created_at", "kind", "id", F.col("delta").cast(MONEY_SUM).alias("delta"),
        (F.col("opening_cash") + F.col("moved")).cast(MONEY_SUM).alias("balance"),
    )


def overdrawn_cash_outs(shop: Shop) -> DataFrame:
    """Cash-outs that took more than the till held at that moment."""
    return cash_balance(shop).where("kind = 'out' and balance < 0").withColumn(
        "short_by", (-F.col("balance")).cast(MONEY_SUM)
    )


def settled_cash_events(shop: Shop) -> DataFrame:
    """Every cash event with ``admitted``: cash-outs the till could cover when they were asked for.

    A refused cash-out leaves the till as it was, so later ones may still fit.
    """
    opening = shop.pos_shifts.select(F.col("id").alias("shift_id"), F.col("opening_cash").alias("opening"))
    return admit_with_inflows(
        cash_events(shop), opening, "shift_id", ["created_at", "kind", "id"], "delta",
        bucket=F.date_trunc("hour", "created_at"),
    )
