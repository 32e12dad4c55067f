"""Conventions shared by all reports: money, instants, stable output."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
MONEY_SUM = T.DecimalType(20, 2)
PERCENT = T.DecimalType(5, 2)


def instant(value: str | datetime) -> Column:
    """A timestamp literal without zone, the type the fact tables carry."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def day_literal(value: str | date) -> Column:
    return F.lit(str(value)).cast("date")


def money_sum(col: Column | str, where: Column | None = None) -> Column:
    """``COALESCE(SUM(x), 0)`` in decimal, optionally over the rows matching ``where``."""
    col = F.col(col) if isinstance(col, str) else col
    if where is not None:
        col = F.when(where, col)
    return F.coalesce(F.sum(col), F.lit(0)).cast(MONEY_SUM)


def count_where(where: Column) -> Column:
    return F.count(F.when(where, 1))


def limit_or(value: int | str | None, default: int) -> int:
    """Request limits: absent, zero or unreadable means the default."""
    try:
        return int(value) or default
    except (TypeError, ValueError):
        return default


def any_of(preds: list[Column]) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def all_of(preds: list[Column]) -> Column:
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral output: money in cents, flags as 0/1, instants and dates as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = (c * 100).cast("bigint") if f.dataType.scale else c.cast("bigint")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
