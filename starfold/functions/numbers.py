"""Rounding and parsing of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits, ties towards +infinity.

    SQL ``round`` differs: it goes through decimal text, so 1.005 becomes 1.01
    there and 1.0 here.
    """
    scale = 10.0 ** digits
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def tenths(value: Column) -> Column:
    """``value`` in whole tenths (bigint), so that later sums stay exact."""
    return F.floor(value * F.lit(10.0) + F.lit(0.5)).cast("bigint")


def star_bucket(stars: Column) -> Column:
    """Whole star, halves away from zero; NULL stays NULL."""
    return F.round(stars, 0).cast("int")


def leading_int(text: Column) -> Column:
    """Integer a text starts with, NULL when it does not start with one."""
    return F.nullif(F.regexp_extract(text, r"^[\s\p{Z}\uFEFF]*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def leading_number(text: Column) -> Column:
    """Decimal number a text starts with; a comma counts as the decimal point."""
    found = F.regexp_extract(
        F.replace(text, F.lit(","), F.lit(".")),
        r"^[\s\p{Z}\uFEFF]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)",
        1,
    )
    return F.nullif(found, F.lit("")).try_cast("double")


def first_number(text: Column) -> Column:
    """First unsigned number anywhere in a text; a comma counts as the decimal point."""
    found = F.regexp_extract(text, r"(\d+[.,]\d+|\d+)", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")
