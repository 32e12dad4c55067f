"""Splitting a whole into parts that add up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.common import MONEY, money_sum
from tillbook.functions.money import scaled


def scale_parts(
    parts: DataFrame, wholes: DataFrame, parent: str, part: str, amount: str, old: str, new: str
) -> DataFrame:
    """Parts scaled by new / old, the leftover cents on the largest part (first name on ties).

    Parts are first summed per (parent, name), so a parent has one row per
    name, of which there are as many as payment methods.
    """
    sums = parts.groupBy(parent, part).agg(money_sum(amount).alias("_amount"))
    joined = sums.join(wholes.select(parent, F.col(old).alias("_old"), F.col(new).alias("_new")), parent)
    cut = joined.withColumn("_cut", scaled(F.col("_amount"), F.col("_new"), F.col("_old")))
    everything = Window.partitionBy(parent)
    largest_first = Window.partitionBy(parent).orderBy(F.col("_cut").desc(), part)
    live = (F.col("_old") > 0) & (F.col("_new") > 0)
    residual = F.when(
        live & (F.row_number().over(largest_first) == 1), F.col("_new") - F.sum("_cut").over(everything)
    ).otherwise(F.lit(0))
    return cut.select(parent, part, (F.col("_cut") + residual).cast(MONEY).alias(amount))


def share_of_total(df: DataFrame, parent: str, value: Column, out: str) -> DataFrame:
    """Each row's part of its parent's total in basis points (truncated), null without a total.

    Totals come from an aggregate and a join, not a window, so a parent with a
    large share of the rows stays spread over tasks.
    """
    rows = df.withColumn("_value", value)
    totals = rows.groupBy(parent).agg(F.sum("_value").alias("_total"))
    share = F.when(
        F.col("_total") > 0,
        F.call_function("div", _whole(F.col("_value")) * 10000, _whole(F.col("_total"))),
    )
    return rows.join(totals, parent).withColumn(out, share.cast("bigint")).drop("_value", "_total")


def _whole(x: Column) -> Column:
    return (x * 100).cast("decimal(20,0)")
