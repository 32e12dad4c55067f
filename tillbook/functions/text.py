"""Text, search, address and naming expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.common import any_of

# What counts as an address, a number, a link, and the bill's lines.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
DIGITS_PATTERN = "^[0-9]+$"
ABSOLUTE_URL_PATTERN = r"(?i)^https?://"
FOLDER_PATTERN = r"/folders/([a-zA-Z0-9_-]+)"


def _plain_letters() -> dict[str, str]:
    """Accented Latin letters and the letters they are without their accents, by canonical decomposition."""
    codes = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in codes}
    return {letter: base for letter, base in plain.items() if base.isascii()}


_PLAIN = _plain_letters()


def fold(x: Column) -> Column:
    """Text for comparing: case and accents, combined or as separate marks, do not matter."""
    bare = F.regexp_replace(x, r"\p{Mn}+", "")
    return F.lower(F.translate(bare, "".join(_PLAIN), "".join(_PLAIN.values())))


def key_of(x: Column) -> Column:
    """Comparison key of a name: case, accents and outer blanks do not matter."""
    return fold(F.trim(x))


def is_filled(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def valid_email(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(EMAIL_PATTERN), F.lit(False))


def slugify(x: Column) -> Column:
    dashed = F.regexp_replace(F.trim(F.lower(x)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def contains_pattern(needle: str, *cols: Column) -> Column:
    """True where any column holds ``needle``, whatever case and accents; ``%`` and ``_`` in it stay wildcards."""
    wanted = fold(F.lit(f"%{needle}%"))
    return any_of([F.coalesce(F.like(fold(c), wanted), F.lit(False)) for c in cols])


def item_label(code: Column, name: Column) -> Column:
    return F.when(is_filled(code), F.concat(F.lit("#"), code)).otherwise(name)


def numeric_code(code: Column) -> Column:
    """The code as a number where it is all digits."""
    return F.when(code.rlike(DIGITS_PATTERN), code.try_cast("bigint"))


def bill_datetime(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy, hh:mm a")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def query_parameter(text: Column, name: str) -> Column:
    """All decoded values of the parameter ``name`` in a text, in order, as an array.

    The name is taken as it is and stands at the start, or after ``?``, ``&`` or ``;``
    (as in ``&amp;``), a quote or a blank: ``ref`` isn't found in ``xref``.
    """
    begins = r"(?:^|[?&;\"'\s])"
    raw = F.regexp_extract_all(text, F.lit(f"{begins}{re.escape(name)}=([^&\"'\\s]+)"), F.lit(1))
    # a plus sign is part of the value here, so it is kept through the decoding
    return F.transform(raw, lambda v: F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))))


def family_name(param: Column) -> Column:
    """Readable name of a font parameter: the part before ``:`` with blanks for plus signs."""
    return F.trim(F.replace(F.element_at(F.split(param, ":"), 1), F.lit("+"), F.lit(" ")))


def font_families(snippet: Column) -> Column:
    """Fonts named in a pasted link: array of (name, family_param), first of a name wins."""
    params = query_parameter(snippet, "family")
    fonts = F.transform(
        params, lambda p: F.struct(family_name(p).alias("name"), p.alias("family_param"))
    )
    names = F.transform(fonts, lambda f: f["name"])
    return F.filter(
        fonts,
        lambda f, i: (f["name"] != "") & (F.array_position(names, f["name"]) == i + 1),
    )


def folder_id(text: Column) -> Column:
    value = F.trim(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(value, FOLDER_PATTERN, 1)
    return F.when(found != "", found).otherwise(value)


def absolute_url(path: Column, base: str) -> Column:
    base = base.removesuffix("/")
    return (
        F.when(~is_filled(path), F.lit(""))
        .when(path.rlike(ABSOLUTE_URL_PATTERN), path)
        .when(path.startswith("/"), F.concat(F.lit(base), path))
        .otherwise(F.concat(F.lit(base + "/"), path))
    )
