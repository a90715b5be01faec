"""Aggregates weighted by head count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exact import ratio


def head_weight(head: str = "head_count") -> Column:
    """A lot with unknown head count weighs one; a lot with none weighs nothing."""
    return F.coalesce(F.col(head), F.lit(1))


def weighted(price: str) -> Column:
    """Price times head; null where that is beyond whole numbers, so that no lot stops a job."""
    return F.try_multiply(F.col(price), head_weight())


def weighted_sum(price: str, where: Column | None = None) -> Column:
    term = weighted(price)
    return F.try_sum(term if where is None else F.when(where, term))


def weight_sum(price: str, where: Column | None = None) -> Column:
    """Heads of the lots that ``weighted_sum`` adds up."""
    counted = weighted(price).isNotNull()
    return F.try_sum(F.when(counted if where is None else counted & where, head_weight()))


def head_weighted_avg(price: str = "price_per_lb_e4", where: Column | None = None) -> Column:
    """Mean of ``price`` weighted by head, in the price's own unit, rounded to it."""
    return ratio(weighted_sum(price, where), weight_sum(price, where))


def head_sum(where: Column | None = None) -> Column:
    term = F.coalesce(F.col("head_count"), F.lit(0))
    return F.coalesce(F.try_sum(term if where is None else F.when(where, term)), F.lit(0))


def change_pct(now: Column, before: Column) -> Column:
    """Change in per cent; null unless ``before`` is above zero."""
    return F.when(before > 0, (now - before) / F.nullif(before, F.lit(0.0)) * 100)


def direction_by_sign(change: Column) -> Column:
    return (
        F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")
    )


def trend_direction(change: Column, step: float) -> Column:
    return (
        F.when(change >= step, "up")
        .when(change <= -step, "down")
        .when(change.isNotNull(), "flat")
    )
