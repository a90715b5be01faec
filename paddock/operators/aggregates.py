"""Grouped reports over lots.

Every operator is one scan with map-side partial aggregation; a hot market or
class shrinks to one row per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import labels
from ..functions.dates import iso_date, iso_stamp, report_month, week_label
from ..functions.exact import dollars, product, ratio, round_half_up
from ..functions.measures import (
    change_pct,
    direction_by_sign,
    head_sum,
    head_weighted_avg,
    trend_direction,
    weight_sum,
    weighted_sum,
)
from .filters import (
    auctions,
    date_range,
    date_window,
    days_before,
    equal,
    priced_per_lb,
    weight_range,
)


def species_avg(lots: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Slaughter average per pound of each species; no row where there is none."""
    rows = date_range(auctions(lots), date_from, date_to).filter(F.col("buyer_intent") == "meat")
    return (
        rows.filter(F.col("species").isin("Goats", "Sheep"))
        .groupBy("species")
        .agg(head_weighted_avg().alias("avg_e4"), F.count("*").alias("lot_count"))
        .filter("avg_e4 is not null")
        .select("species", dollars(F.col("avg_e4")).alias("avg_price_per_lb"), "lot_count")
    )


def volume_summary(lots: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Lots, distinct markets and distinct states.

    Lots are first counted by market and state, so the distinct counts run over
    that short list.
    """
    places = (
        date_range(auctions(lots), date_from, date_to)
        .groupBy("market_name", "market_state")
        .agg(F.count("*").alias("lots"))
    )
    return places.agg(
        F.coalesce(F.sum("lots"), F.lit(0)).alias("lots"),
        F.countDistinct("market_name").alias("markets"),
        F.countDistinct("market_state").alias("states"),
    )


def data_freshness(lots: DataFrame) -> DataFrame:
    """The newest publication, summaries included."""
    return lots.agg(iso_stamp(F.max("published_date")).alias("data_freshness"))


def compare_markets(
    lots: DataFrame,
    as_of: str,
    species: str,
    animal_class: str | None = None,
    weight_min: int | None = None,
    weight_max: int | None = None,
    period: int = S.MARKET_DAYS,
    group_by: Sequence[str] = ("market_name", "market_state"),
) -> DataFrame:
    """Average prices by market, best paying first."""
    rows = equal(priced_per_lb(lots), species=species, animal_class=animal_class)
    rows = date_window(weight_range(rows, weight_min, weight_max), as_of, period)
    return (
        rows.groupBy(*group_by)
        .agg(
            head_weighted_avg("price_per_lb_e4").alias("lb_e4"),
            ratio(weighted_sum("price_per_head_e4"), product(weight_sum("price_per_head_e4"), 100)).alias("head_cents"),
            F.count("*").alias("lot_count"),
            head_sum().alias("head_count"),
        )
        .filter(F.col("lot_count") >= S.COMPARE_MIN_LOTS)
        .select(
            *group_by,
            dollars(F.col("lb_e4")).alias("avg_price_per_lb"),
            (F.col("head_cents") / 100).alias("avg_price_per_head"),
            "lot_count",
            "head_count",
        )
        .orderBy(F.desc("avg_price_per_lb"), *group_by)
    )


def compare_trend(
    lots: DataFrame,
    as_of: str,
    species: str,
    period: int = S.MARKET_DAYS,
    animal_class: str | None = None,
    weight_min: int | None = None,
    weight_max: int | None = None,
) -> DataFrame:
    """Market comparison with its change against the period before, in one scan."""
    start = days_before(as_of, period)
    rows = equal(priced_per_lb(lots), species=species, animal_class=animal_class)
    rows = weight_range(rows, weight_min, weight_max)
    rows = date_range(rows, days_before(start, period), as_of)
    now = F.col("report_date") >= F.lit(start).cast("date")
    current, previous = _two_averages(now)
    change = change_pct(F.col("now_avg"), F.col("before_avg"))
    return (
        rows.groupBy("market_name", "market_state")
        .agg(
            head_weighted_avg(where=now).alias("lb_e4"),
            current.alias("now_avg"),
            previous.alias("before_avg"),
            ratio(
                weighted_sum("price_per_head_e4", now), product(weight_sum("price_per_head_e4", now), 100)
            ).alias("head_cents"),
            F.count(F.when(now, 1)).alias("lot_count"),
            head_sum(now).alias("head_count"),
        )
        .filter(F.col("lot_count") >= S.COMPARE_MIN_LOTS)
        .withColumn("change", change)
        .select(
            "market_name",
            "market_state",
            dollars(F.col("lb_e4")).alias("avg_price_per_lb"),
            (F.col("head_cents") / 100).alias("avg_price_per_head"),
            "lot_count",
            "head_count",
            round_half_up(F.col("change"), 1).alias("trend_pct"),
            trend_direction(F.col("change"), S.TREND_STEP_PCT).alias("trend_direction"),
        )
    )


def _two_averages(now: Column) -> tuple[Column, Column]:
    """Unrounded averages of the rows in the current window and of the others."""
    return tuple(
        weighted_sum("price_per_lb_e4", where)
        / F.nullif(weight_sum("price_per_lb_e4", where), F.lit(0))
        for where in (now, ~now)
    )


def compare_by_region(lots: DataFrame, as_of: str, species: str, period: int = S.MARKET_DAYS) -> DataFrame:
    """Averages by market, state and region with their subtotals."""
    rows = date_window(equal(priced_per_lb(lots), species=species), as_of, period)
    return (
        rows.withColumnRenamed("market_city", "region")
        .rollup("region", "market_state", "market_name")
        .agg(
            F.grouping_id().alias("level"),
            head_weighted_avg().alias("lb_e4"),
            F.count("*").alias("lot_count"),
            head_sum().alias("head_count"),
        )
        .filter(F.col("lot_count") >= S.COMPARE_MIN_LOTS)
        .select(
            "region", "market_state", "market_name", "level",
            dollars(F.col("lb_e4")).alias("avg_price_per_lb"), "lot_count", "head_count",
        )
    )


def trend_rows(
    lots: DataFrame,
    as_of: str,
    species: str | None = None,
    commodity: str | None = None,
    animal_class: str | None = None,
    weight_min: int | None = None,
    weight_max: int | None = None,
    period: int = 90,
    market: str | None = None,
) -> DataFrame:
    rows = equal(
        priced_per_lb(lots),
        species=species,
        commodity=commodity,
        animal_class=animal_class,
        market_name=market,
    )
    return date_window(weight_range(rows, weight_min, weight_max), as_of, period)


def by_week(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(week_label(F.col("report_date")).alias("week_label"))
        .agg(
            iso_date(F.min("report_date")).alias("week_start"),
            dollars(head_weighted_avg()).alias("avg_price_per_lb"),
            dollars(F.min("price_per_lb_e4")).alias("price_min"),
            dollars(F.max("price_per_lb_e4")).alias("price_max"),
            F.count("*").alias("lot_count"),
            head_sum().alias("head_count"),
        )
        .orderBy("week_label")
    )


def weekly_trend(lots: DataFrame, as_of: str, **conditions) -> DataFrame:
    """Weekly head-weighted price per pound, oldest first."""
    return by_week(trend_rows(lots, as_of, **conditions))


def lot_trend(lots: DataFrame, lot_key: str, weeks: int = 5, report_date: str | None = None) -> DataFrame:
    """Weekly trend of one lot's class and weight bracket at its market.

    The lot is found first, in the month of ``report_date`` if that is given, and joined
    with the months of its window, at most one row for each, so that a table partitioned
    by month is read there only.
    """
    same = ["market_name", "commodity", "animal_class", "weight_break_low", "weight_break_high"]
    found = lots if report_date is None else lots.filter(F.col("report_month") == report_date[:7])
    first = F.date_sub(F.col("lot_date"), weeks * 7)
    months = F.sequence(F.trunc(first, "MM"), F.trunc("lot_date", "MM"), F.expr("interval 1 month"))
    one = (
        found.filter(F.col("id") == lot_key)
        .limit(1)
        .select(*same, F.col("report_date").alias("lot_date"))
        .withColumn("report_month", F.explode(F.transform(months, report_month)))
    )
    rows = priced_per_lb(lots).join(F.broadcast(one), [*same, "report_month"])
    return by_week(
        rows.filter((F.col("report_date") <= F.col("lot_date")) & (F.col("report_date") > first))
    )


def feeder_vs_slaughter(lots: DataFrame, as_of: str, period: int = 90) -> DataFrame:
    """Weekly feeder and slaughter averages side by side, with their spread."""
    rows = date_window(priced_per_lb(lots), as_of, period)
    intent = F.col("buyer_intent")
    return (
        rows.filter(intent.isin("feeder", "meat"))
        .groupBy(week_label(F.col("report_date")).alias("week_label"))
        .agg(
            head_weighted_avg(where=intent == "feeder").alias("feeder"),
            head_weighted_avg(where=intent == "meat").alias("meat"),
        )
        .select(
            "week_label",
            dollars(F.col("feeder")).alias("feeder_avg"),
            dollars(F.col("meat")).alias("slaughter_avg"),
            dollars(F.col("feeder") - F.col("meat")).alias("spread"),
        )
        .orderBy("week_label")
    )


def facet_classes(lots: DataFrame, species: str | None = None, intent: str | None = None) -> DataFrame:
    return _facet(equal(lots, species=species, buyer_intent=intent), "animal_class", "name")


def facet_grades(lots: DataFrame) -> DataFrame:
    return _facet(lots, "quality_grade", "name")


def facet_states(lots: DataFrame) -> DataFrame:
    return _facet(lots, "market_state", "code", keep_null=True)


def _facet(lots: DataFrame, column: str, name: str, keep_null: bool = False) -> DataFrame:
    rows = auctions(lots)
    if not keep_null:
        rows = rows.filter(F.col(column).isNotNull())
    return (
        rows.groupBy(F.col(column).alias(name))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), name)
    )


def facet_markets(lots: DataFrame) -> DataFrame:
    """Counts by market name; of several places of one name the least is shown.

    Lots are counted by place first: choosing a place then sorts places, not lots.
    """
    places = auctions(lots).groupBy("market_name", "market_state", "market_city").agg(
        F.count("*").alias("lots")
    )
    return (
        places.groupBy(F.col("market_name").alias("name"))
        .agg(F.min(F.struct("market_state", "market_city")).alias("place"), F.sum("lots").alias("count"))
        .select("name", F.expr("place.market_state as state"), F.expr("place.market_city as city"), "count")
        .orderBy(F.desc("count"), "name")
    )


def facets(lots: DataFrame) -> DataFrame:
    """Class, state and grade counts together, from one scan.

    Rows are counted by the three columns first; only those counts are expanded
    into the grouping sets.
    """
    cells = (
        auctions(lots)
        .groupBy("animal_class", "market_state", "quality_grade")
        .agg(F.count("*").alias("lots"))
    )
    sets = [[F.col("animal_class")], [F.col("market_state")], [F.col("quality_grade")]]
    grouped = cells.groupingSets(sets, "animal_class", "market_state", "quality_grade").agg(
        F.grouping_id("animal_class", "market_state", "quality_grade").alias("gid"),
        F.sum("lots").alias("count"),
    )
    facet = F.when(F.col("gid") == 3, "class").when(F.col("gid") == 5, "state").otherwise("grade")
    return (
        grouped.select(
            facet.alias("facet"),
            F.coalesce("animal_class", "market_state", "quality_grade").alias("value"),
            "count",
        )
        .filter((F.col("facet") == "state") | F.col("value").isNotNull())
    )


def facet_topk(facet: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of a facet list."""
    return facet.orderBy(F.desc("count"), facet.columns[0]).limit(k)


def class_by_intent(lots: DataFrame) -> DataFrame:
    """Classes met under each species and intent."""
    return (
        auctions(lots)
        .filter(F.col("animal_class").isNotNull())
        .groupBy("species", "buyer_intent", "animal_class")
        .agg(F.count("*").alias("count"))
    )


def class_taxonomy(lots: DataFrame) -> DataFrame:
    """Lots by class and intent; the total also counts lots of unknown intent."""
    label = labels.intent_label(F.col("buyer_intent"))
    return lots.groupBy("species", "animal_class").agg(
        *[
            F.nullif(F.count_if(label == name), F.lit(0)).alias(name.lower())
            for name in ("Slaughter", "Feeder", "Replacement")
        ],
        F.count("*").alias("total"),
    )


def grade_distribution(lots: DataFrame) -> DataFrame:
    """Count and whole per cent of graded lots."""
    return with_share(
        lots.filter(F.col("quality_grade").isNotNull())
        .groupBy("quality_grade")
        .agg(F.count("*").alias("count")),
        digits=0,
    )


def with_share(counts: DataFrame, digits: int = 1) -> DataFrame:
    """Add each row's share of all counts, in per cent.

    The total is a one-row aggregate of the counted groups.
    """
    total = counts.agg(F.sum("count")).scalar()
    share = round_half_up(F.col("count") * 100.0 / total, digits)
    return counts.withColumn("share_pct", share)


def top_movers(
    lots: DataFrame,
    date_from: str,
    date_to: str,
    keys: Sequence[str] = ("species", "animal_class"),
) -> DataFrame:
    """Classes by change of their average against the 14 days before ``date_from``.

    Both windows are summed in one scan.  A class needs five lots in each.
    """
    rows = date_range(priced_per_lb(lots), days_before(date_from, S.SUMMARY_DAYS), date_to)
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    now = F.col("report_date") >= F.lit(date_from).cast("date")
    current, previous = _two_averages(now)
    return (
        rows.groupBy(*keys)
        .agg(
            current.alias("now_avg"),
            previous.alias("before_avg"),
            F.count(F.when(now, 1)).alias("now_lots"),
            F.count(F.when(~now, 1)).alias("before_lots"),
        )
        .filter((F.col("now_lots") >= S.MOVER_MIN_LOTS) & (F.col("before_lots") >= S.MOVER_MIN_LOTS))
        .withColumn("change", change_pct(F.col("now_avg"), F.col("before_avg")))
        .filter("change is not null")
        .select(
            *keys,
            "now_lots",
            "before_lots",
            "change",
            round_half_up(F.col("change"), 1).alias("change_pct"),
            direction_by_sign(F.col("change")).alias("direction"),
        )
    )


def top_mover(lots: DataFrame, date_from: str, date_to: str, keys=("species", "animal_class")) -> DataFrame:
    """The largest change of all, up or down."""
    return (
        top_movers(lots, date_from, date_to, keys)
        .orderBy(F.desc("change"), *keys)
        .limit(1)
        .drop("change")
    )


def species_avg_trend(lots: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Slaughter averages of the species with their change over two weeks."""
    rows = date_range(priced_per_lb(lots), days_before(date_from, S.SUMMARY_DAYS), date_to)
    rows = rows.filter((F.col("buyer_intent") == "meat") & F.col("species").isin("Goats", "Sheep"))
    now = F.col("report_date") >= F.lit(date_from).cast("date")
    current, previous = _two_averages(now)
    return (
        rows.groupBy("species")
        .agg(
            dollars(head_weighted_avg(where=now)).alias("avg_price_per_lb"),
            current.alias("now_avg"),
            previous.alias("before_avg"),
        )
        .withColumn("change", change_pct(F.col("now_avg"), F.col("before_avg")))
        .select(
            "species",
            "avg_price_per_lb",
            round_half_up(F.col("change"), 1).alias("trend_pct"),
            trend_direction(F.col("change"), S.TREND_STEP_PCT).alias("trend_direction"),
        )
    )
