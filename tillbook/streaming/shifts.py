"""Shifts and working sessions that are followed while they are open and handed over once when they are over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.common import MONEY_SUM, money_sum
from tillbook.streaming.runner import BUCKETS, run_closing
from tillbook.streaming.sources import with_event_time

# What a row of the merged table holds of one shift and, for payments, one method.
SUMS = "transaction_count total_sales total_discount total_balance_due paid cash_out_total".split()
_TYPES = {
    "method": "string", "transaction_count": "bigint", **{c: MONEY_SUM.simpleString() for c in SUMS[1:]},
    "opening_cash": MONEY_SUM.simpleString(), "closing_cash": MONEY_SUM.simpleString(), "closed_at": "timestamp",
}


def _entry(rows: DataFrame, shift: str, at: str, **figures: Column) -> DataFrame:
    known = {name: F.lit(None).cast(kind) for name, kind in _TYPES.items()}
    known |= {name: col.cast(_TYPES[name]) for name, col in figures.items()}
    return rows.select(F.col(shift).alias("shift_id"), F.col(at).cast("timestamp").alias("at"), *[c.alias(n) for n, c in known.items()])


def entries(
    openings: DataFrame, sales: DataFrame, payments: DataFrame, cash_outs: DataFrame, closings: DataFrame,
    delay: str = "1 day", reach: str = "90 days",
) -> DataFrame:
    """Everything that changes a shift's report, as one stream in append mode.

    ``openings``: id, opening_cash, opened_at; ``closings``: id, closing_cash,
    closed_at; the others as in the till's tables. A payment counts in the shift
    in which it is made, whichever shift the sale belongs to, unless the sale is
    voided. It waits for its sale, and sales wait for later payments, in the
    state of a join that is bounded in time: payments come within ``reach`` of
    their sale and rows are at most ``delay`` late. Payments of unknown sales or
    beyond ``reach`` don't count.
    """
    done = sales.where("status = 'completed'")
    kept = with_event_time(sales.where("status <> 'voided'"), "created_at", delay)
    owed = kept.select(F.col("id").alias("sale_id"), F.col("created_at").alias("sold_at"))
    paid = with_event_time(payments, "created_at", delay).withColumnRenamed("sale_id", "paid_sale")
    valid = paid.join(
        owed,
        (F.col("paid_sale") == F.col("sale_id")) & (F.col("created_at") >= F.col("sold_at"))
        & (F.col("created_at") <= F.col("sold_at") + F.expr(f"interval {reach}")),
    )
    parts = [
        _entry(openings, "id", "opened_at", opening_cash=F.col("opening_cash")),
        _entry(
            done, "shift_id", "created_at", transaction_count=F.lit(1), total_sales=F.col("total_amount"),
            total_discount=F.col("discount_amount"), total_balance_due=F.col("balance_due"),
        ),
        _entry(valid, "shift_id", "created_at", method=F.coalesce("method", F.lit("")), paid=F.col("amount")),
        _entry(cash_outs, "shift_id", "created_at", cash_out_total=F.col("amount")),
        _entry(closings, "id", "closed_at", closing_cash=F.col("closing_cash"), closed_at=F.col("closed_at")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entries summed, one row per shift and method; Spark adds up in each task before the shuffle."""
    sums = [F.sum(c).cast(_TYPES[c]).alias(c) for c in SUMS]
    last = [F.max(c).alias(c) for c in ("at", "opening_cash", "closing_cash", "closed_at")]
    return rows.groupBy(*keys, "shift_id", "method").agg(*sums, *last)


def follow(stream: DataFrame, delay: str = "1 day", folder: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Entries merged per shift: (shifts in the table, shifts handed over).

    A shift leaves the table ``delay`` after its closing by the newest event of
    its bucket; an entry without a shift in the table leaves when it is as old.
    The table so has the open shifts and those closed within ``delay``.
    """
    of_shift = Window.partitionBy("_bucket", "shift_id")
    clock = F.max("at").over(Window.partitionBy("_bucket")) - F.expr(f"interval {delay}")
    over = F.max("closed_at").over(of_shift) <= clock
    stray = F.max("opening_cash").over(of_shift).isNull() & (F.max("at").over(of_shift) <= clock)
    return run_closing(stream, ["shift_id"], lambda rows: _added(rows, ["_bucket"]), over | stray, folder, buckets)


def reports(kept: DataFrame, left: DataFrame) -> DataFrame:
    """The report of every shift, open or closed; those handed over include their late entries."""
    rows = _added(kept.unionByName(left), [])
    cash = F.col("method") == "cash"
    method = F.when(F.col("method").isNotNull(), F.struct("method", F.col("paid").alias("total")))
    report = rows.groupBy("shift_id").agg(
        F.max("opening_cash").alias("opening_cash"),
        F.when(F.max("closed_at").isNull(), "open").otherwise("closed").alias("status"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("transaction_count"),
        *[money_sum(c).alias(c) for c in SUMS[1:4]],
        F.sort_array(F.collect_list(method)).alias("payments"),  # one element per method
        money_sum("paid", cash).alias("cash_collected"),
        money_sum("cash_out_total").alias("cash_out_total"),
        F.max("closing_cash").alias("closing_cash"),
    ).where("opening_cash is not null")
    expected = (F.col("opening_cash") + F.col("cash_collected") - F.col("cash_out_total")).cast(MONEY_SUM)
    return report.withColumn("expected_cash", expected).withColumn("variance", (F.col("closing_cash") - expected).cast(MONEY_SUM))


def sessions(
    events: DataFrame, gap: str = "4 hours", delay: str = "1 day", folder: str | None = None, buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """Working sessions by a pause longer than ``gap``: (those still going on, those over, each once).

    A session is over ``delay`` after its end by the newest event of its bucket;
    an event that comes later than that makes a session of its own. Events of a
    micro-batch are first cut to one row per staff and stretch of ``gap``, which
    always lie in one session, so a busy key is short before it is put in order.
    """
    every = F.expr(f"interval {gap}")
    ts = F.col("ts").cast("timestamp")
    spans = events.select("staff_id", ts.alias("opened_at"), (ts + every).alias("closed_at"), F.lit(1).cast("bigint").alias("events"))

    def joined(rows: DataFrame) -> DataFrame:
        span = [F.min("opened_at").alias("opened_at"), F.max("closed_at").alias("closed_at"), F.sum("events").alias("events")]
        key = ["_bucket", "staff_id"]
        short = rows.where("_batch").groupBy(*key, F.window("opened_at", gap)).agg(*span).drop("window")
        both = short.unionByName(rows.where("not _batch").select(*short.columns))
        in_order = Window.partitionBy(*key).orderBy("opened_at", "closed_at")
        before = F.max("closed_at").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = both.withColumn("_fresh", F.coalesce(F.col("opened_at") > before, F.lit(True)).cast("int"))
        return fresh.withColumn("_session", F.sum("_fresh").over(in_order)).groupBy(*key, "_session").agg(*span)

    clock = F.max("closed_at").over(Window.partitionBy("_bucket")) - every - F.expr(f"interval {delay}")
    return run_closing(spans, ["staff_id"], joined, F.col("closed_at") <= clock, folder, buckets)
