"""Filtered listing, lookup, scatter points and nearest lots."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.dates import iso_date
from ..functions.exact import dollars
from ..functions.public import public_lots
from ..plans.band_join import band_sums, banded
from ..session import store
from ..sources.months import in_months
from .filters import date_range, equal, lot_filter, priced_per_lb

#: Lots on a page at most; so few ids may come to the driver.
MOST_OF_A_PAGE = 200


def _stored_name(column: str) -> str:
    return f"{column}_e4" if column in S.PRICE_COLUMNS else column


def _sort_column(sort_by: str) -> str:
    """One of six columns; unknown ones mean the report date."""
    return _stored_name(sort_by if sort_by in S.SORT_COLUMNS else "report_date")


def _sort_keys(sort_by: str, sort_dir: str) -> list[Column]:
    column = _sort_column(sort_by)
    if sort_dir.lower() == "asc":
        return [F.asc_nulls_first(column), F.asc("id")]
    return [F.desc_nulls_last(column), F.asc("id")]


def list_lots(
    lots: DataFrame,
    sort_by: str = "report_date",
    sort_dir: str = "desc",
    page: int = 1,
    limit: int = 50,
    **conditions,
) -> DataFrame:
    """One page of the lots that meet the conditions.

    Each task keeps only the rows up to the page's end; for pages far down use
    ``list_lots_after``, whose cost does not grow with depth.
    """
    _check_page(page, limit)
    return _page(lots, lot_filter(lots, **conditions), sort_by, sort_dir, limit, (page - 1) * limit)


def _page(lots: DataFrame, rows: DataFrame, sort_by: str, sort_dir: str, limit: int, skipped: int = 0) -> DataFrame:
    """The whole lots of one page of ``rows``, in order.

    The page is found on sort column, id and month alone; whole lots are then fetched for
    its ids, from its months.  A page has few ids (``_check_page``): as a filter they reach
    the source of the lots, below its joins, which a join with them does not.
    """
    order = _sort_keys(sort_by, sort_dir)
    month = [name for name in ("report_month",) if name in lots.columns]
    narrow = rows.select(_sort_column(sort_by), "id", *month)
    found = narrow.orderBy(*order).offset(skipped).limit(limit).where(F.col("id").isNotNull()).collect()
    of_page = F.col("id").isin([row["id"] for row in found])
    narrow, lots = narrow.filter(of_page), lots.filter(of_page)
    if month:
        lots = in_months(lots, list({row["report_month"] for row in found}))
    # True of every id: months are pruned by a list only if it is filtered by a comparison.
    keys = narrow.orderBy(*order).limit(limit).where(F.col("id") >= "")
    keys = keys.select(*[F.col(name).alias(f"__{name}") for name in ("id", *month)])
    same = F.col("id") == F.col("__id")
    for name in month:
        same = same & (F.coalesce(name, F.lit("")) == F.coalesce(f"__{name}", F.lit("")))
    return public_lots(lots.join(keys, same, "left_semi").orderBy(*order).limit(limit))


def list_lots_after(
    lots: DataFrame,
    last_value,
    last_id: str,
    sort_by: str = "report_date",
    sort_dir: str = "desc",
    limit: int = 50,
    **conditions,
) -> DataFrame:
    """The page after the lot with ``last_value`` of the sort column and ``last_id``.

    ``last_value`` is the stored value: 1e-4 dollars for prices, a date for dates.
    """
    _check_page(1, limit)
    column = F.col(_sort_column(sort_by))
    same_value = column.eqNullSafe(last_value) & (F.col("id") > last_id)
    if sort_dir.lower() == "asc":
        beyond = column.isNotNull() if last_value is None else column > last_value
    elif last_value is None:
        beyond = F.lit(False)
    else:
        beyond = (column < last_value) | column.isNull()
    rows = lot_filter(lots, **conditions).filter(F.coalesce(beyond, F.lit(False)) | same_value)
    return _page(lots, rows, sort_by, sort_dir, limit)


def _check_page(page: int, limit: int) -> None:
    if page < 1 or not 1 <= limit <= MOST_OF_A_PAGE:
        raise ValueError("page starts at 1 and limit lies between 1 and 200")


def page_info(lots: DataFrame, page: int = 1, limit: int = 50, **conditions) -> DataFrame:
    """Count of matching lots and of pages."""
    _check_page(page, limit)
    count = F.count("*")
    return lot_filter(lots, **conditions).agg(
        count.alias("count"),
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        F.greatest(F.ceil(count / limit), F.lit(1)).alias("total_pages"),
    )


def lot_count(lots: DataFrame) -> DataFrame:
    return lots.agg(F.count("*").alias("lot_count"))


def get_lot(lots: DataFrame, key: str, report_date: str | None = None) -> DataFrame:
    """The lot of one id; no row if there is none.

    With the report date (an ISO date) only the table's month of that date is read.
    """
    if report_date is not None:
        lots = lots.filter(F.col("report_month") == report_date[:7])
    return public_lots(lots.filter(F.col("id") == key))


def get_lots(lots: DataFrame, keys: DataFrame) -> DataFrame:
    """The lots whose ids are listed in the ``id`` column of ``keys``."""
    return public_lots(lots.join(keys.select("id"), "id", "left_semi"))


def price_weight_scatter(
    lots: DataFrame,
    species: str | None = None,
    commodity: str | None = None,
    date_from: str | None = None,
    limit: int = 500,
) -> DataFrame:
    """Price and weight of the newest lots."""
    if not 10 <= limit <= 2000:
        raise ValueError("limit lies between 10 and 2000")
    rows = equal(priced_per_lb(lots), species=species, commodity=commodity)
    rows = date_range(rows.filter(F.col("avg_weight") > 0), date_from)
    return (
        rows.orderBy(F.desc("report_date"), "id")
        .limit(limit)
        .select(
            "id",
            "avg_weight",
            dollars(F.col("price_per_lb_e4")).alias("price_per_lb"),
            F.coalesce("head_count", F.lit(1)).alias("head_count"),
            *[
                F.coalesce(name, F.lit("")).alias(name)
                for name in ("commodity", "species", "animal_class")
            ],
            "market_name",
            iso_date(F.col("report_date")).alias("report_date"),
        )
    )


def nearest_lots(lots: DataFrame, target_weight: float, k: int = 5, **conditions) -> DataFrame:
    """The ``k`` lots closest in weight.

    Found on weight and id alone, as a page is; whole lots are then read for few ids only.
    """
    distance = F.abs(F.col("avg_weight") - F.lit(target_weight))
    rows = lot_filter(lots, **conditions).filter(F.col("avg_weight").isNotNull())
    if k <= MOST_OF_A_PAGE:
        ids = [row["id"] for row in rows.select("avg_weight", "id").orderBy(distance, "id").limit(k).collect()]
        of_these = F.col("id").isin([key for key in ids if key is not None])
        rows = rows.filter(of_these | F.col("id").isNull() if None in ids else of_these)
    return public_lots(rows.orderBy(distance, "id").limit(k))


def nearest_lots_many(
    lots: DataFrame,
    targets: DataFrame,
    k: int = 5,
    keys: Sequence[str] = ("species",),
    target: str = "target_weight",
    columns: Sequence[str] = (),
    **conditions,
) -> DataFrame:
    """For every row of ``targets`` the ``k`` lots closest in weight among those with its ``keys``.

    Rows of ``targets`` with ``place`` (from 1), ``id``, ``avg_weight``, ``distance`` and the
    lots' ``columns``; equally close lots go by id.  Targets without weight or key, or without
    lots, give no rows; with fewer than ``k`` lots all are given.

    A weight never adds more than its ``k`` first lots, which each task finds for itself
    before any are shuffled.  Different targets are matched with different weights by
    buckets; where a ring around a target holds too few lots it is made twice as wide.
    """
    keys, columns = list(keys), list(columns)
    first = Window.partitionBy(*keys, "avg_weight").orderBy("id")
    heads = lot_filter(lots, **conditions).filter(F.col("avg_weight").isNotNull())
    heads = heads.select(*keys, "avg_weight", "id", *columns).withColumn("__nth", F.row_number().over(first))
    heads = store(heads.where(F.col("__nth") <= k).drop("__nth"), "heads")
    weights = store(heads.groupBy(*keys, "avg_weight").agg(F.count("*").alias("__lots")), "weights")
    open_ = store(targets.select(*keys, target).where(F.col(target).isNotNull()).distinct(), "targets")

    ends = [weights.agg(F.min("avg_weight"), F.max("avg_weight")), open_.agg(F.min(target), F.max(target))]
    (low, high), (least, most) = (tuple(end.first()) for end in ends)
    reach = 0 if None in (low, least) else math.ceil(max(high - least, most - low, 0)) + 1
    ring, rings = S.MARKET_BAND_LB, []
    while ring < reach:
        counted = band_sums(open_, weights, keys, target, "avg_weight", ring, ["__lots"])
        full = store(counted.where(F.col("__lots") >= k).select(*keys, target), "ring")
        rings.append((full, ring))
        open_ = store(open_.join(full, [*keys, target], "left_anti"), "targets")
        if open_.isEmpty():
            break
        ring *= 2
    else:
        rings.append((open_, max(reach, 1)))
    near = [banded(wanted, heads, keys, target, "avg_weight", width) for wanted, width in rings]
    distance = F.abs(F.col("avg_weight") - F.col(target))
    closest = Window.partitionBy(*keys, target).orderBy("distance", "id")
    ranked = reduce(DataFrame.unionByName, near).withColumn("distance", distance)
    ranked = ranked.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= k)
    return targets.join(ranked, [*keys, target]).select(
        *targets.columns, F.col("place").cast("long").alias("place"), "id", "avg_weight", "distance", *columns
    )
