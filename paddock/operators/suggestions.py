"""Wider searches to offer when one finds nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .filters import all_of, days_before, lot_conditions
from .listing import nearest_lots

NEARBY_STATES = 5


def widened_weights(weight_min: int | None, weight_max: int | None) -> tuple[int, int]:
    low = (weight_min or 0) - S.WIDEN_LB
    high = (weight_max or S.DEFAULT_MAX_WEIGHT) + S.WIDEN_LB
    return max(0, low), high


def _widened(**conditions) -> dict[str, dict]:
    """The wider searches that apply to the given conditions, by kind."""
    weights = (conditions.get("weight_min"), conditions.get("weight_max"))
    wider = {}
    if weights != (None, None):
        low, high = widened_weights(*weights)
        wider["weight_expanded"] = {**conditions, "weight_min": low, "weight_max": high}
    if conditions.get("state"):
        wider["states_nearby"] = {**conditions, "state": None}
    if conditions.get("date_from"):
        wider["time_expanded"] = {**conditions, "date_from": None}
    return wider


def _count_matching(lots: DataFrame, conditions: dict) -> DataFrame:
    flag = all_of(lot_conditions(**conditions))
    return lots.filter(flag).agg(F.count("*").alias("count")).filter("count > 0")


def suggest_weight(lots: DataFrame, **conditions) -> DataFrame:
    """Matches with the weight bounds moved apart by 20 lb each."""
    low, high = widened_weights(conditions.get("weight_min"), conditions.get("weight_max"))
    found = _count_matching(lots, {**conditions, "weight_min": low, "weight_max": high})
    return found.select(F.lit(low).alias("low"), F.lit(high).alias("high"), "count")


def suggest_states(lots: DataFrame, **conditions) -> DataFrame:
    """The five states with most matches when the state is left open."""
    flag = all_of(lot_conditions(**{**conditions, "state": None}))
    return (
        lots.filter(flag)
        .groupBy(F.col("market_state").alias("state"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "state")
        .limit(NEARBY_STATES)
    )


def suggest_dates(lots: DataFrame, **conditions) -> DataFrame:
    """Matches with no earliest date."""
    found = _count_matching(lots, {**conditions, "date_from": None})
    return found.select(F.lit("all").alias("days"), "count")


def suggest_30_days(lots: DataFrame, as_of: str, **conditions) -> DataFrame:
    """Matches in the last 30 days."""
    wider = {**conditions, "date_from": days_before(as_of, S.MARKET_DAYS), "date_to": as_of}
    found = _count_matching(lots, wider)
    return found.select(F.lit(S.MARKET_DAYS).alias("days"), "count")


def _searches(as_of: str | None = None, **conditions) -> dict[str, Column]:
    """The search itself and every wider one, each as a flag."""
    searches = {"found": conditions, **_widened(**conditions)}
    if as_of and conditions.get("date_from"):
        searches["last_30_days"] = {
            **conditions, "date_from": days_before(as_of, S.MARKET_DAYS), "date_to": as_of
        }
    return {kind: all_of(lot_conditions(**search)) for kind, search in searches.items()}


def suggest_nearest(lots: DataFrame, as_of: str | None = None, k: int = 5, **conditions) -> DataFrame:
    """The ``k`` lots closest in weight, if neither the search nor any wider one finds a lot.

    Closest to the middle of the weights asked for, or to the one bound given; bounds of
    weight, state and date are left out.  Without weight bounds there is nothing to be near to.
    """
    bounds = [w for w in (conditions.get("weight_min"), conditions.get("weight_max")) if w is not None]
    target = sum(bounds) / len(bounds) if bounds else 0
    rest = {**conditions, **dict.fromkeys(("weight_min", "weight_max", "state", "date_from", "date_to", "bracket"))}
    matched = reduce(Column.__or__, _searches(as_of, **conditions).values())
    any_found = lots.filter(matched).limit(1).agg(F.count("*")).scalar()
    near = nearest_lots(lots if bounds else lots.limit(0), target, k, **rest)
    return near.where(any_found == 0)


def suggestions(lots: DataFrame, as_of: str | None = None, **conditions) -> DataFrame:
    """Every wider search that finds lots, if the given one finds none.

    Rows are ``kind, state, low, high, count``.  All searches are counted by state in one
    scan, which keeps only rows some search matches; a second aggregate makes one row of
    the short list of states.  With ``as_of`` the last thirty days are a search too.
    """
    flags = _searches(as_of, **conditions)
    matched = reduce(Column.__or__, flags.values())
    counts = [F.count(F.when(flag, 1)).alias(kind) for kind, flag in flags.items()]
    cells = lots.filter(matched).groupBy("market_state").agg(*counts)

    low, high = widened_weights(conditions.get("weight_min"), conditions.get("weight_max"))
    sums = [F.coalesce(F.sum(kind), F.lit(0)).alias(kind) for kind in flags]
    nearby = F.lit(None)
    if "states_nearby" in flags:
        named = F.when(
            F.col("states_nearby") > 0,
            F.struct((-F.col("states_nearby")).alias("less"), F.col("market_state").alias("state")),
        )
        nearby = F.slice(F.array_sort(F.collect_list(named)), 1, NEARBY_STATES)
    # One row, whatever the number of lots; there is one even if no search finds any.
    row = cells.agg(*sums, nearby.alias("nearby") if "states_nearby" in flags else F.count("*").alias("nearby"))
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def entry(kind: str, count: Column, state: Column = no_text, low=no_number, high=no_number) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), state.alias("state"), low.alias("low"), high.alias("high"), count.alias("count")
        )

    entries = F.array(entry("", F.lit(0).cast("bigint")))
    if "weight_expanded" in flags:
        wider = entry("weight_expanded", F.col("weight_expanded"), low=F.lit(low), high=F.lit(high))
        entries = F.concat(entries, F.array(wider))
    for kind in ("time_expanded", "last_30_days"):
        if kind in flags:
            entries = F.concat(entries, F.array(entry(kind, F.col(kind))))
    if "states_nearby" in flags:
        states = F.transform("nearby", lambda x: entry("states_nearby", -x["less"], state=x["state"]))
        entries = F.concat(entries, states)
    return row.where("found = 0").select(F.inline(entries)).where("count > 0")
