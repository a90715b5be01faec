"""Report dates and weeks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: date spellings met in reports ---
# month/day/year, the same with hour:minute:second, and year-month-day
STAMP_SHAPE = (
    "^(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?: [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?"
    "|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$"
)
SLASHED = "^([0-9]+)/([0-9]+)/([0-9]+)(.*)$"


def parse_stamp(text: str) -> str:
    """SQL of report text as a timestamp without zone; null if no known spelling fits.

    The text is put in ISO order and cast: unlike parsing by pattern, that raises and
    catches nothing for text that is no date.
    """
    iso = f"regexp_replace(regexp_substr({text}, '{STAMP_SHAPE}'), '{SLASHED}', '$3-$1-$2$4')"
    return f"try_cast({iso} as timestamp_ntz)"


def parse_date(text: str) -> str:
    return f"cast({parse_stamp(text)} as date)"


def iso_date(day: Column) -> Column:
    return day.cast("string")


def iso_stamp(stamp: Column) -> Column:
    """Cast and not formatted, so that the session's time zone plays no part."""
    return F.replace(stamp.cast("string"), F.lit(" "), F.lit("T"))


def report_month(day: Column) -> Column:
    return F.substring(iso_date(day), 1, 7)


def week_label(day: Column) -> Column:
    """``YYYY-Wnn``: weeks start on Monday, days before the first Monday are week 00."""
    number = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.year(day), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def date_label(day: Column) -> Column:
    """``Feb 9, 2026``; empty for null."""
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit(""))
