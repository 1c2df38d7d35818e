"""Numbers in text: parsing, listing, and the check that a number stands in a text verbatim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that group thousands, besides the plain one.
SPACES = "\u00a0\u202f\u2009\u2007"
#: A number with grouped thousands, or a plain one (fixed pattern).
NUMBER = rf"\d{{1,3}}(?:[ {SPACES}]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"


def plain_spaces(c: Column) -> Column:
    return F.translate(c, SPACES, " " * len(SPACES))


def parse_number(c: Column) -> Column:
    """A double from Russian, European or English notation; null if it is none.

    The later of comma and dot is the decimal sign; a comma alone is decimal; spaces group thousands.
    """
    s = F.replace(plain_spaces(F.trim(c)), F.lit(" "), F.lit(""))
    s = F.translate(s, "\u2212\u2013", "--")
    minus = F.startswith(s, F.lit("-"))
    s = F.regexp_replace(s, "^[+-]+", "")
    comma, dot = F.length(F.substring_index(s, ",", -1)), F.length(F.substring_index(s, ".", -1))
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    s = (
        F.when(both & (comma < dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(s, F.lit(","), F.lit("")))
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    v = s.try_cast("double")
    return F.when(minus, -v).otherwise(v)


def numbers_in(c: Column) -> Column:
    """All numbers of a text as doubles; 1,250 and 1.250 also as thousands."""
    found = F.regexp_extract_all(plain_spaces(c), F.lit(f"({NUMBER})"), 1)
    thousands = F.transform(F.filter(found, lambda x: x.rlike(r"^\d{1,3}[.,]\d{3}$")), lambda x: F.regexp_replace(x, "[.,]", "").cast("double"))
    return F.array_distinct(F.filter(F.concat(F.transform(found, parse_number), thousands), lambda x: x.isNotNull()))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def number_in_text(value: Column, text: Column) -> Column:
    """Whether a number stands in a text: as a number in any notation, or its digits as they are."""
    grouped = F.format_number(value, 0)
    whole = value == F.floor(value)
    shown = F.when(whole, F.contains(plain_spaces(text), F.translate(grouped, ",", " "))).otherwise(F.lit(False))
    return F.coalesce(F.exists(numbers_in(text), lambda x: close(x, value)) | shown, F.lit(False))


def raw_in_text(raw: Column, text: Column) -> Column:
    """As :func:`number_in_text`, for a number given as a string."""
    r = F.trim(plain_spaces(raw))
    v = parse_number(raw)
    return ((F.length(r) > 0) & F.contains(plain_spaces(text), r)) | F.coalesce(F.exists(numbers_in(text), lambda x: close(x, v)), F.lit(False))
