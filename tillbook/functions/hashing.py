"""Stable per-key numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a.
_OFFSET, _PRIME, _MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(key: Column, start: Column | None = None) -> Column:
    """FNV-1a of an ASCII key as an unsigned 32-bit number in a bigint; ``start`` is the hash of the text before the key."""
    letters = F.filter(F.split(key, ""), lambda ch: ch != "")
    codes = F.transform(letters, lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(_OFFSET).cast("bigint") if start is None else start,
        lambda h, c: (h.bitwiseXOR(c) * _PRIME).bitwiseAND(F.lit(_MASK).cast("bigint")),
    )


def fnv1a_text(start: Column | None, text: str) -> Column:
    """``fnv1a`` of a given text, behind the one that ``start`` is the hash of if there is one."""
    start = F.lit(_OFFSET).cast("bigint") if start is None else start
    for letter in text:
        start = _letter(start, F.lit(ord(letter)), F.lit(_PRIME))
    return start


def fnv1a_number(start: Column, number: Column, most: int) -> Column:
    """``fnv1a`` of a whole number from 0 to ``most`` behind the text that ``start`` is the hash of.

    Digits are reckoned, so that no text is made of the number and the whole expression is compiled.
    """
    number = number.cast("bigint")
    for place in reversed(range(len(str(most)))):
        one = F.lit(10**place).cast("bigint")
        code = F.call_function("div", number, one) % 10 + 48
        if not place:
            start = _letter(start, code, F.lit(_PRIME))
        else:  # a place that the number lacks changes nothing
            has = number >= one
            start = _letter(start, F.when(has, code).otherwise(0), F.when(has, _PRIME).otherwise(1))
    return start


def _letter(before: Column, code: Column, prime: Column) -> Column:
    return (before.bitwiseXOR(code.cast("bigint")) * prime.cast("bigint")).bitwiseAND(F.lit(_MASK).cast("bigint"))


def stable_unit(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return fnv1a(key) / F.lit(float(_MASK + 1))
