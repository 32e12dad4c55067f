"""Price and money expressions. Everything stays decimal and rounds half-up to cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.common import MONEY, PERCENT


def round2(x: Column) -> Column:
    return F.round(x, 2)


def percent_of(amount: Column, percent: Column) -> Column:
    """``amount * percent / 100`` without a division."""
    return amount * percent * F.expr("0.01")


def discount_price(sale_price: Column, percent: Column) -> Column:
    return round2(sale_price - percent_of(sale_price, percent)).cast(MONEY)


def implied_discount_percent(price: Column, discounted: Column) -> Column:
    """``(1 - discounted / price) * 100`` to two places; 0 without a price or a discount.

    One integer division of cents, half away from zero.
    """
    p, d = _cents(price), _cents(discounted)
    steps = F.call_function("div", F.abs(p - d) * 20000 + p, p * 2) * F.signum(p - d).cast("int")
    return F.when(discounted.isNotNull() & (price > 0), steps * F.expr("0.01")).otherwise(
        F.lit(0)
    ).cast(PERCENT)


def unit_price(mode: str) -> Column:
    """Price of one unit of a product row: ``retail``, ``till`` or ``cost``."""
    if mode == "cost":
        return F.coalesce(F.col("purchase_price"), F.lit(0)).cast(MONEY)
    if mode == "till":
        return F.when(F.col("discount_percent") > 0, F.col("discount_price")).otherwise(F.col("sale_price"))
    if mode == "retail":
        return F.coalesce(F.col("discount_price"), F.col("sale_price"))
    raise ValueError(f"unknown price mode {mode!r}")


def net_quantity(quantity: Column, returned: Column) -> Column:
    return F.greatest(F.lit(0), quantity - F.coalesce(returned, F.lit(0)))


def scaled(amount: Column, part: Column, whole: Column) -> Column:
    """``amount * part / whole`` to cents, 0 when the whole is not positive.

    Multiplies first and divides once, on integer cents and half-up, so the
    result does not depend on how an engine sizes decimal quotients.
    """
    a, p, w = (_cents(c) for c in (amount, part, whole))
    quotient = F.call_function("div", a * p * 2 + w, w * 2)
    return F.when(w > 0, quotient * F.expr("0.01")).otherwise(F.lit(0)).cast(MONEY)


def _cents(x: Column) -> Column:
    """Whole cents of amounts below a million million; products of two still fit a decimal."""
    return (x * 100).cast("decimal(14,0)")


def bill_ratio_bp(total: Column, subtotal: Column) -> Column:
    """Total per subtotal in basis points (truncated), 0 when the subtotal is not positive."""
    t, s = _cents(total), _cents(subtotal)
    return F.when(s > 0, F.call_function("div", t * 10000, s)).otherwise(F.lit(0)).cast("bigint")


def format_money(x: Column) -> Column:
    """``Rs. 1,234/=``."""
    return F.concat(F.lit("Rs. "), F.format_number(F.round(x, 0), 0), F.lit("/="))
