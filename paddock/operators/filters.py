"""Lot predicates.  Every one is a plain column comparison that reaches the scan."""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.dates import week_label
from ..functions.exact import E4


def days_before(as_of: str, days: int) -> str:
    return (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()


Conditions = list[Column]


def keep(lots: DataFrame, conditions: Conditions) -> DataFrame:
    return lots.filter(reduce(Column.__and__, conditions)) if conditions else lots


def all_of(conditions: Conditions) -> Column:
    """The conditions as one flag that is never null."""
    return F.coalesce(reduce(Column.__and__, conditions, F.lit(True)), F.lit(False))


# --- conditions ---

def equals(**wanted) -> Conditions:
    """Column equals value, for every value given."""
    return [F.col(column) == value for column, value in wanted.items() if value]


def listed(**wanted: str | None) -> Conditions:
    """Column is one of a comma list; parts are taken as they are, spaces included."""
    return [F.col(column).isin(*text.split(",")) for column, text in wanted.items() if text]


def bounds(column: str, low=None, high=None) -> Conditions:
    """Inclusive bounds; a null value meets no bound."""
    out = []
    if low is not None:
        out.append(F.col(column) >= low)
    if high is not None:
        out.append(F.col(column) <= high)
    return out


def price_bounds(price_min: float | None = None, price_max: float | None = None) -> Conditions:
    """Inclusive bounds in dollars per pound."""
    return bounds(
        "price_per_lb_e4",
        None if price_min is None else math.ceil(price_min * E4 - 1e-6),
        None if price_max is None else math.floor(price_max * E4 + 1e-6),
    )


def dates(date_from: str | None, date_to: str | None, by_month: bool = False) -> Conditions:
    """Inclusive report dates, with the partition months they fall in."""
    days = [date.fromisoformat(day) if day else None for day in (date_from, date_to)]
    out = bounds("report_date", *days)
    if by_month:
        out += bounds("report_month", *[day[:7] if day else None for day in (date_from, date_to)])
    return out


def weight_bracket(bracket: str | None) -> Conditions:
    """Quoted for a weight bracket that lies within ``low-high``."""
    if not bracket:
        return []
    low, high = (int(part) for part in bracket.split("-"))
    return [F.col("weight_break_low") >= low, F.col("weight_break_high") <= high]


def lot_conditions(
    *,
    species: str | None = None,
    intent: str | None = None,
    commodity: str | None = None,
    animal_class: str | None = None,
    breed_type: str | None = None,
    grade: str | None = None,
    weight_min: int | None = None,
    weight_max: int | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    state: str | None = None,
    market: str | None = None,
    lot_desc: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    include_summary: bool = False,
    dressing: str | None = None,
    age: str | None = None,
    bracket: str | None = None,
    by_month: bool = False,
) -> Conditions:
    """All given conditions; an absent or empty one is no condition."""
    return [
        *equals(
            species=species,
            buyer_intent=intent,
            commodity=commodity,
            breed_type=breed_type,
            market_name=market,
            lot_desc=lot_desc,
        ),
        *listed(
            animal_class=animal_class,
            quality_grade=grade,
            market_state=state,
            dressing=dressing,
            age=age,
        ),
        *bounds("avg_weight", weight_min, weight_max),
        *price_bounds(price_min, price_max),
        *dates(date_from, date_to, by_month),
        *weight_bracket(bracket),
        *([] if include_summary else [~F.col("is_summary")]),
        F.col("avg_price_e4").isNotNull(),
    ]


def lot_filter(lots: DataFrame, **conditions) -> DataFrame:
    by_month = "report_month" in lots.columns
    return keep(lots, lot_conditions(by_month=by_month, **conditions))


# --- the same, applied ---

def date_range(lots: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    return keep(lots, dates(date_from, date_to, "report_month" in lots.columns))


def date_window(lots: DataFrame, as_of: str, days: int) -> DataFrame:
    """The ``days`` days up to and including ``as_of``."""
    return date_range(lots, days_before(as_of, days), as_of)


def auctions(lots: DataFrame) -> DataFrame:
    return lots.filter("not is_summary")


def priced_per_lb(lots: DataFrame) -> DataFrame:
    return lots.filter("not is_summary and price_per_lb_e4 is not null")


def weight_range(lots: DataFrame, weight_min=None, weight_max=None) -> DataFrame:
    return keep(lots, bounds("avg_weight", weight_min, weight_max))


def equal(lots: DataFrame, **wanted) -> DataFrame:
    return keep(lots, equals(**wanted))


def weight_sentinels(weight_min: int | None, weight_max: int | None):
    """The ends of the weight slider mean no bound."""
    low = weight_min if weight_min is not None and weight_min > 0 else None
    high = weight_max if weight_max is not None and weight_max < S.DEFAULT_MAX_WEIGHT else None
    return low, high


def target_weight_range(target: int, spread: int = S.WIDEN_LB) -> tuple[int, int]:
    return max(0, target - spread), target + spread


def week_drilldown(lots: DataFrame, week: str) -> DataFrame:
    """The lots behind one point of the weekly trend.

    The label is turned into its seven possible days first, so that the scan reads
    only that week's month.
    """
    year, number = week.split("-W")
    first = date(int(year), 1, 1)
    first_monday = first + timedelta(days=-first.weekday() % 7)
    monday = first_monday + timedelta(weeks=int(number) - 1)
    start = max(first, monday)
    end = min(date(int(year), 12, 31), monday + timedelta(days=6))
    rows = date_range(priced_per_lb(lots), start.isoformat(), end.isoformat())
    return rows.filter(week_label(F.col("report_date")) == week)
