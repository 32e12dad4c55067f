"""Live versions of the reports, as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.common import count_where, money_sum
from tillbook.sources import testbed
from tillbook.streaming.sources import with_event_time


SALE_COLUMNS = "status total_amount discount_amount balance_due amount_paid payment_method".split()


def x_report(sales: DataFrame, cash_outs: DataFrame | None = None) -> DataFrame:
    """Figures of each shift so far, with the cash its sales brought and what was taken out; run in update mode.

    Cash counts what was paid with a sale that is not voided. State has a row per
    shift.
    """
    rows = sales.select("shift_id", *SALE_COLUMNS, F.lit(None).cast("decimal(10,2)").alias("cash_out"))
    if cash_outs is not None:
        none = [F.lit(None).cast(sales.schema[c].dataType).alias(c) for c in SALE_COLUMNS]
        rows = rows.unionByName(cash_outs.select("shift_id", *none, F.col("amount").alias("cash_out")))
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    cash = F.coalesce((F.col("payment_method") == "cash") & (F.col("status") != "voided"), F.lit(False))
    return rows.groupBy("shift_id").agg(
        count_where(done).alias("transaction_count"),
        money_sum("total_amount", done).alias("total_sales"),
        money_sum("discount_amount", done).alias("total_discount"),
        money_sum("balance_due", done).alias("total_balance_due"),
        money_sum("amount_paid", cash).alias("cash_collected"),
        money_sum("cash_out").alias("cash_out_total"),
    )


def revenue_by_day(sales: DataFrame, delay: str = "1 day") -> DataFrame:
    """Completed revenue per calendar day; days older than the watermark are dropped from state."""
    timed = with_event_time(sales.where("status = 'completed'"), "created_at", delay)
    return (
        timed.groupBy(F.window("created_at", "1 day")).agg(money_sum("total_amount").alias("revenue"))
        .select(F.to_date("window.start").alias("day"), "revenue")
    )


def trailing_units(items: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Units per product over every ``days``-day window, moving by a day."""
    timed = with_event_time(items, "created_at", delay)
    return (
        timed.groupBy(F.window("created_at", f"{days} days", "1 day"), "product_id")
        .agg(F.sum("quantity").cast("bigint").alias("total_sold"))
        .select(F.to_date("window.end").alias("until"), "product_id", "total_sold")
    )


def hottest(units: DataFrame, k: int) -> DataFrame:
    """Top products of each window; Spark cuts every task's rows to ``k`` before the shuffle."""
    by_units = Window.partitionBy("until").orderBy(F.col("total_sold").desc(), "product_id")
    return units.withColumn("rank", F.row_number().over(by_units)).where(F.col("rank") <= k)


def unique_events(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First arrival of each key; repeats within the watermark are dropped."""
    return with_event_time(events, ts, delay).dropDuplicatesWithinWatermark(keys)


def stock(moves: DataFrame, products: DataFrame) -> DataFrame:
    """Net movement and balance per product so far; run in update mode. State has a row per product."""
    moved = moves.groupBy("product_id").agg(F.sum("delta").cast("bigint").alias("moved"))
    opening = products.select(F.col("id").alias("product_id"), "stock")
    return moved.join(opening, "product_id").select(
        "product_id", "moved", (F.col("stock") + F.col("moved")).cast("bigint").alias("balance")
    )


def working_sessions(events: DataFrame, gap: str = "4 hours", delay: str = "1 day") -> DataFrame:
    """Shifts inferred from activity: a pause longer than ``gap`` ends one."""
    timed = with_event_time(events, "ts", delay)
    return (
        timed.groupBy("staff_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            "staff_id",
            F.col("session_window.start").alias("opened_at"),
            F.col("session_window.end").alias("closed_at"),
            "events",
        )
    )


def event_moves(events: DataFrame) -> DataFrame:
    """Stock movements in the event stream: purchases take a unit per ten in ``k``, sign-ups bring five."""
    taken = -(F.floor(F.col("k") / 10) + 1)
    return events.where("event_type in ('purchase', 'signup')").select(
        F.col("user_id").alias("product_id"),
        F.when(F.col("event_type") == "purchase", taken).otherwise(F.lit(5)).cast("bigint").alias("delta"),
    )


def event_items(events: DataFrame) -> DataFrame:
    """Units in the event stream, by the buyer's favourite product."""
    return events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("product_id"), F.col("k").alias("quantity"), F.col("ts").alias("created_at")
    )


def event_sales(events: DataFrame) -> DataFrame:
    return testbed.book_sales(events)


def event_cash_outs(events: DataFrame) -> DataFrame:
    return testbed.book_cash_movements(events)
