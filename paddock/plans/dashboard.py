"""The dashboard's figures in one pass over its window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.dates import iso_stamp
from ..functions.exact import money_text, ratio, round_half_up
from ..functions.measures import change_pct, direction_by_sign, weight_sum, weighted_sum
from ..operators.filters import auctions, date_range, days_before

CELL = ("species", "animal_class", "market_name", "market_state")


def dashboard_summary(lots: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Totals, species averages, top mover and freshness as one row.

    Lots of both windows are summed by class and place; that short table is then
    grouped three ways and folded into one row.  Freshness concerns every lot ever
    stored and is a one-column aggregate of its own, so that the main scan can skip
    older months.
    """
    rows = date_range(auctions(lots), days_before(date_from, S.SUMMARY_DAYS), date_to)
    now = F.col("report_date") >= F.lit(date_from).cast("date")
    meat_now = now & F.col("buyer_intent").eqNullSafe("meat")
    price = "price_per_lb_e4"
    priced = F.col(price).isNotNull()
    cells = rows.groupBy(*CELL).agg(
        F.count(F.when(now, 1)).alias("lots"),
        weighted_sum(price, meat_now).alias("meat_num"),
        weight_sum(price, meat_now).alias("meat_den"),
        weighted_sum(price, now).alias("now_num"),
        weight_sum(price, now).alias("now_den"),
        weighted_sum(price, ~now).alias("before_num"),
        weight_sum(price, ~now).alias("before_den"),
        F.count(F.when(now & priced, 1)).alias("now_lots"),
        F.count(F.when(~now & priced, 1)).alias("before_lots"),
    )
    return _of_cells(cells, lots)


def mart_dashboard_summary(mart: DataFrame, lots: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """``dashboard_summary`` from the daily mart; of the lots only the newest publication is read."""
    rows = date_range(auctions(mart), days_before(date_from, S.SUMMARY_DAYS), date_to)
    now = F.col("report_date") >= F.lit(date_from).cast("date")
    meat_now = now & F.col("buyer_intent").eqNullSafe("meat")

    def added(name: str, where: Column) -> Column:
        return F.try_sum(F.when(where, F.col(name)))

    def counted(name: str, where: Column) -> Column:
        return F.coalesce(added(name, where), F.lit(0))

    cells = rows.groupBy(*CELL).agg(
        counted("lots_all", now).alias("lots"),
        added("lb_num", meat_now).alias("meat_num"),
        added("lb_den", meat_now).alias("meat_den"),
        added("lb_num", now).alias("now_num"),
        added("lb_den", now).alias("now_den"),
        added("lb_num", ~now).alias("before_num"),
        added("lb_den", ~now).alias("before_den"),
        counted("lots", now).alias("now_lots"),
        counted("lots", ~now).alias("before_lots"),
    )
    return _of_cells(cells, lots)


def _of_cells(cells: DataFrame, lots: DataFrame) -> DataFrame:
    """The row of figures from both windows' sums by class and place."""
    keys = list(CELL)
    sets = [
        [F.col("species"), F.col("animal_class")],
        [F.col("market_name")],
        [F.col("market_state")],
    ]
    sums = [name for name in cells.columns if name not in keys]
    grouped = cells.groupingSets(sets, *keys).agg(
        F.grouping_id(*keys).alias("gid"), *[F.try_sum(name).alias(name) for name in sums]
    )
    by_class, by_market, by_state = (F.col("gid") == gid for gid in (3, 13, 14))

    enough = (F.col("now_lots") >= S.MOVER_MIN_LOTS) & (F.col("before_lots") >= S.MOVER_MIN_LOTS)
    known = F.col("species").isNotNull() & F.col("animal_class").isNotNull()
    change = change_pct(
        F.col("now_num") / F.nullif(F.col("now_den"), F.lit(0)),
        F.col("before_num") / F.nullif(F.col("before_den"), F.lit(0)),
    )
    grouped = grouped.withColumn("change", F.when(by_class & enough & known, change))
    # The largest change, and of equal ones the first class by name.
    mover = F.min(
        F.when(
            F.col("change").isNotNull(),
            F.struct((-F.col("change")).alias("drop"), "species", "animal_class"),
        )
    )

    def species_cents(species: str) -> Column:
        mine = by_class & (F.col("species") == species)
        num = F.try_sum(F.when(mine, F.col("meat_num")))
        den = F.try_sum(F.when(mine, F.col("meat_den")))
        return ratio(num, den * 100)

    def distinct(where: Column, column: str) -> Column:
        return F.count(F.when(where & (F.col("lots") > 0), F.col(column)))

    one = grouped.agg(
        F.coalesce(F.try_sum(F.when(by_class, F.col("lots"))), F.lit(0)).alias("total_lots"),
        distinct(by_market, "market_name").alias("total_markets"),
        distinct(by_state, "market_state").alias("total_states"),
        species_cents("Goats").alias("goats_cents"),
        species_cents("Sheep").alias("sheep_cents"),
        mover.alias("mover"),
    )
    moved = -F.col("mover.drop")
    return one.select(
        "total_lots",
        "total_markets",
        "total_states",
        (F.col("goats_cents") / 100).alias("goats_avg"),
        (F.col("sheep_cents") / 100).alias("sheep_avg"),
        F.col("mover.species").alias("mover_species"),
        F.col("mover.animal_class").alias("mover_class"),
        round_half_up(moved, 1).alias("mover_pct"),
        direction_by_sign(moved).alias("mover_direction"),
        iso_stamp(lots.agg(F.max("published_date")).scalar()).alias("data_freshness"),
    )


def dashboard_widgets(summary: DataFrame) -> DataFrame:
    """The summary as the dashboard's labelled widgets, in order."""
    def widget(place, label, value, sub_label, pct=None, direction=None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(place).alias("place"),
            F.lit(label).alias("label"),
            value.alias("value"),
            sub_label.alias("sub_label"),
            (none.cast("double") if pct is None else pct).alias("trend_pct"),
            (none.cast("string") if direction is None else direction).alias("trend_direction"),
        )

    def price(column: str) -> Column:
        cents = F.floor(F.col(column) * 100 + 0.5)
        return F.concat(F.lit("$"), money_text(cents), F.lit("/lb"))

    volume = F.concat(F.format_number("total_lots", 0), F.lit(" lots"))
    places = F.concat(
        F.col("total_markets"), F.lit(" markets · "), F.col("total_states"), F.lit(" states")
    )
    widgets = F.array(
        widget(1, "🐐 Goats", price("goats_avg"), F.lit("Slaughter Avg")),
        widget(2, "🐑 Sheep", price("sheep_avg"), F.lit("Slaughter Avg")),
        widget(3, "📊 Volume", volume, places),
        widget(
            4, "🔥 Top Mover", F.col("mover_class"), F.col("mover_species"),
            F.col("mover_pct"), F.col("mover_direction"),
        ),
    )
    return (
        summary.select(F.inline(widgets))
        .filter("value is not null")
        .orderBy("place")
    )
