"""Distinct markets and states of any window, from days that are kept apart.

Two ways on one stored table with a row for each day: the exact one holds the day's markets
and states as a list of pairs; the sketch holds a HyperLogLog state of fixed size, which can
be merged for any days.  A sketch with 2**lg_k places errs by about 1.04 / 2**(lg_k / 2).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..operators.filters import auctions, date_range

LG_K = 12
#: Standard errors that an estimate is stated to lie within.
SPREAD = 3


def daily_markets(lots: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One row a day: lots of auctions, sketches of their markets and states.

    Names are counted once for each day and task before any sketch is fed, so a hot market is
    one value of a task.
    """
    month = ["report_month"] if "report_month" in lots.columns else []
    names = auctions(lots).groupBy("report_date", *month, "market_name", "market_state").agg(F.count("*").alias("lots"))
    return names.groupBy("report_date", *month).agg(
        F.sum("lots").alias("lots"),
        F.hll_sketch_agg("market_name", F.lit(lg_k)).alias("markets"),
        F.hll_sketch_agg("market_state", F.lit(lg_k)).alias("states"),
    )


def relative_error(lg_k: int = LG_K) -> float:
    """The bound on the relative error that ``sketched_volume`` states."""
    return SPREAD * 1.04 / math.sqrt(2**lg_k)


def sketched_volume(days: DataFrame, date_from: str | None, date_to: str | None, lg_k: int = LG_K) -> DataFrame:
    """``volume_summary`` of a window with estimated distinct counts and the bound on their error."""
    rows = date_range(days, date_from, date_to) if date_from or date_to else days

    def estimate(name: str):
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0))

    return rows.agg(
        F.coalesce(F.sum("lots"), F.lit(0)).alias("lots"),
        estimate("markets").alias("markets"),
        estimate("states").alias("states"),
        F.lit(relative_error(lg_k)).alias("relative_error"),
    )


def daily_market_names(lots: DataFrame) -> DataFrame:
    """The exact state: one row for each day, market and state with its lots."""
    month = ["report_month"] if "report_month" in lots.columns else []
    return auctions(lots).groupBy("report_date", *month, "market_name", "market_state").agg(F.count("*").alias("lots"))


def exact_volume(names: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """``volume_summary`` of a window from ``daily_market_names``, exact.

    Days are added up first, so the distinct counts run over one row for each market.
    """
    rows = date_range(names, date_from, date_to) if date_from or date_to else names
    places = rows.groupBy("market_name", "market_state").agg(F.sum("lots").alias("lots"))
    return places.agg(
        F.coalesce(F.sum("lots"), F.lit(0)).alias("lots"),
        F.countDistinct("market_name").alias("markets"),
        F.countDistinct("market_state").alias("states"),
    )
