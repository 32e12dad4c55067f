"""Top-k, fallback, latest-per-key and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``ORDER BY … LIMIT k``; the order must end in a unique column."""
    return df.orderBy(*order).limit(k)


def top_k_or_fallback(
    first: DataFrame, first_order: list[Column], other: DataFrame, other_order: list[Column], k: int
) -> DataFrame:
    """The first ranking, or the other one when the first is empty.

    Both are cut to ``k`` rows, so the check for emptiness sees at most ``2k``
    rows and the facts behind the first ranking are read once. Columns missing
    on one side are null.
    """
    def placed(df: DataFrame, order: list[Column], source: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(source)).orderBy(*order))
        return top_k(df, order, k).withColumn("_source", F.lit(source)).withColumn("_place", place)

    both = placed(first, first_order, 0).unionByName(
        placed(other, other_order, 1), allowMissingColumns=True
    )
    best = F.min("_source").over(Window.partitionBy(F.lit(0)))
    return (
        both.withColumn("_best", best).where("_source = _best")
        .orderBy("_place").drop("_source", "_best", "_place")
    )


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of a totally ordered list; an offset without a limit is ignored."""
    out = df.orderBy(*order)
    if limit:
        if offset:
            out = out.offset(int(offset))
        out = out.limit(int(limit))
    return out


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest order per key.

    An aggregate, not a window: partial aggregation leaves one candidate per
    key and task before the shuffle, so hot keys cost nothing extra.
    """
    return _pick(df, keys, order, F.max_by)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
