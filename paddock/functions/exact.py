"""Exact arithmetic on whole numbers.

All sums here are ``bigint``.  A thousand billion lots at 75 dollars each fit; what is
beyond is null, it never wraps and never stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

E4 = 10_000


def int_div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` to the nearest whole number, halves up; null for zero ``den``.

    Both must be at least zero.  Null where a step is beyond whole numbers.
    """
    return int_div(F.try_add(_twice(num), den), F.nullif(_twice(den), F.lit(0)))


def signed_ratio(num: Column, den: Column) -> Column:
    """As ``ratio`` with ``num`` of either sign, halves away from zero."""
    return int_div(F.try_add(_twice(num), F.when(num < 0, -den).otherwise(den)), F.nullif(_twice(den), F.lit(0)))


def _twice(value: Column) -> Column:
    return F.try_multiply(value.cast("bigint"), F.lit(2).cast("bigint"))


def product(first: Column, *others: Column | int) -> Column:
    """Product of whole numbers; null beyond ``bigint``."""
    out = first.cast("bigint")
    for other in others:
        factor = F.lit(other) if isinstance(other, int) else other
        out = F.try_multiply(out, factor.cast("bigint"))
    return out


def total(first: Column, *others: Column) -> Column:
    """Sum of whole numbers; null beyond ``bigint``."""
    out = first.cast("bigint")
    for other in others:
        out = F.try_add(out, other.cast("bigint"))
    return out


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Round a double, halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def dollars(units_e4: Column) -> Column:
    """1e-4 dollars as a double."""
    return units_e4 / F.lit(E4)


def to_cents(units_e4: Column) -> Column:
    """1e-4 dollars rounded to whole cents."""
    return signed_ratio(units_e4, F.lit(100))


def money_text(cents: Column) -> Column:
    """Cents of at least zero as ``123.45``."""
    return F.concat(
        int_div(cents, F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
