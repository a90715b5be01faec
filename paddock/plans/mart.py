"""Daily mart: additive sums per market, day and class, and the reports it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.dates import iso_date, week_label
from ..functions.exact import dollars, ratio, round_half_up
from ..functions.measures import change_pct, direction_by_sign, head_sum, weight_sum, weighted, weighted_sum
from ..operators.filters import auctions, date_range, date_window, days_before, equal
from ..sources.months import read_table, write_months

GRAIN = (
    "report_date", "species", "commodity", "buyer_intent", "animal_class",
    "market_state", "market_city", "market_name", "is_summary",
)
SUMS = ("lb_num", "lb_den", "head_num", "head_den", "lots", "heads", "lots_all", "lb_terms", "head_terms")
TERMS = ("lb_terms", "head_terms")
MART_SCHEMA = ", ".join(
    [
        "report_date date",
        *(f"{name} string" for name in GRAIN if name not in ("report_date", "is_summary")),
        "is_summary boolean",
        *(f"{name} bigint" for name in (*SUMS, "lb_min", "lb_max")),
        "report_month string",
    ]
)


def daily_mart(lots: DataFrame) -> DataFrame:
    """One row per day, class and market.

    Sums cover lots with a price per pound, ``lots_all`` covers every lot.  Days are
    kept because report windows are exact to the day; weights are not, so reports
    with weight bounds read the lots.
    """
    return mart_state(lots).drop(*TERMS)


def mart_state(lots: DataFrame) -> DataFrame:
    """The mart as it is stored: ``daily_mart`` and how many lots each average is made of.

    With these, lots can be taken out of a row again and it is known when nothing is left.
    """
    priced = F.col("price_per_lb_e4").isNotNull()
    grain = [*GRAIN, *(["report_month"] if "report_month" in lots.columns else [])]
    return lots.groupBy(*grain).agg(
        weighted_sum("price_per_lb_e4").alias("lb_num"),
        weight_sum("price_per_lb_e4").alias("lb_den"),
        weighted_sum("price_per_head_e4", priced).alias("head_num"),
        weight_sum("price_per_head_e4", priced).alias("head_den"),
        F.min("price_per_lb_e4").alias("lb_min"),
        F.max("price_per_lb_e4").alias("lb_max"),
        F.count(F.when(priced, 1)).alias("lots"),
        head_sum(priced).alias("heads"),
        F.count("*").alias("lots_all"),
        F.count(weighted("price_per_lb_e4")).alias("lb_terms"),
        F.count(F.when(priced, weighted("price_per_head_e4"))).alias("head_terms"),
    )


def write_mart(lots: DataFrame, path: str) -> None:
    """Replace the mart's months that ``lots`` holds; these must be whole."""
    write_months(mart_state(lots), path)


def read_mart(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored mart, or nothing if it was never written."""
    return read_table(spark, path, MART_SCHEMA)


def _priced(mart: DataFrame) -> DataFrame:
    return auctions(mart).filter("lots > 0")


def _avg(num: str, den: str, scale: int = 1):
    return ratio(F.try_sum(num), F.try_sum(den) * scale)


def mart_weekly_trend(
    mart: DataFrame,
    as_of: str,
    species: str | None = None,
    commodity: str | None = None,
    animal_class: str | None = None,
    period: int = 90,
    market: str | None = None,
) -> DataFrame:
    """``weekly_trend`` without weight bounds."""
    rows = equal(
        _priced(mart), species=species, commodity=commodity, animal_class=animal_class, market_name=market
    )
    return (
        date_window(rows, as_of, period)
        .groupBy(week_label(F.col("report_date")).alias("week_label"))
        .agg(
            iso_date(F.min("report_date")).alias("week_start"),
            dollars(_avg("lb_num", "lb_den")).alias("avg_price_per_lb"),
            dollars(F.min("lb_min")).alias("price_min"),
            dollars(F.max("lb_max")).alias("price_max"),
            F.try_sum("lots").alias("lot_count"),
            F.try_sum("heads").alias("head_count"),
        )
        .orderBy("week_label")
    )


def mart_compare_markets(
    mart: DataFrame, as_of: str, species: str, animal_class: str | None = None, period: int = S.MARKET_DAYS
) -> DataFrame:
    """``compare_markets`` without weight bounds."""
    rows = equal(_priced(mart), species=species, animal_class=animal_class)
    keys = ["market_name", "market_state"]
    return (
        date_window(rows, as_of, period)
        .groupBy(*keys)
        .agg(
            dollars(_avg("lb_num", "lb_den")).alias("avg_price_per_lb"),
            (_avg("head_num", "head_den", 100) / 100).alias("avg_price_per_head"),
            F.try_sum("lots").alias("lot_count"),
            F.try_sum("heads").alias("head_count"),
        )
        .filter(F.col("lot_count") >= S.COMPARE_MIN_LOTS)
        .orderBy(F.desc("avg_price_per_lb"), *keys)
    )


def mart_top_mover(mart: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """``top_mover``."""
    keys = ["species", "animal_class"]
    rows = date_range(_priced(mart), days_before(date_from, S.SUMMARY_DAYS), date_to)
    rows = rows.filter("species is not null and animal_class is not null")
    now = F.col("report_date") >= F.lit(date_from).cast("date")

    def average(where):
        return F.try_sum(F.when(where, F.col("lb_num"))) / F.nullif(
            F.try_sum(F.when(where, F.col("lb_den"))), F.lit(0)
        )

    return (
        rows.groupBy(*keys)
        .agg(
            average(now).alias("now_avg"),
            average(~now).alias("before_avg"),
            F.coalesce(F.try_sum(F.when(now, F.col("lots"))), F.lit(0)).alias("now_lots"),
            F.coalesce(F.try_sum(F.when(~now, F.col("lots"))), F.lit(0)).alias("before_lots"),
        )
        .filter((F.col("now_lots") >= S.MOVER_MIN_LOTS) & (F.col("before_lots") >= S.MOVER_MIN_LOTS))
        .withColumn("change", change_pct(F.col("now_avg"), F.col("before_avg")))
        .filter("change is not null")
        .orderBy(F.desc("change"), *keys)
        .limit(1)
        .select(
            *keys,
            "now_lots",
            "before_lots",
            round_half_up(F.col("change"), 1).alias("change_pct"),
            direction_by_sign(F.col("change")).alias("direction"),
        )
    )


def mart_volume(mart: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """``volume_summary``."""
    places = (
        date_range(auctions(mart), date_from, date_to)
        .groupBy("market_name", "market_state")
        .agg(F.try_sum("lots_all").alias("lots"))
    )
    return places.agg(
        F.coalesce(F.try_sum("lots"), F.lit(0)).alias("lots"),
        F.countDistinct("market_name").alias("markets"),
        F.countDistinct("market_state").alias("states"),
    )


def mart_facet(mart: DataFrame, column: str, name: str) -> DataFrame:
    """Counts behind the class and state facets; nulls only among states."""
    rows = auctions(mart)
    if column != "market_state":
        rows = rows.filter(F.col(column).isNotNull())
    return (
        rows.groupBy(F.col(column).alias(name))
        .agg(F.try_sum("lots_all").alias("count"))
        .orderBy(F.desc("count"), name)
    )


def mart_markets(mart: DataFrame) -> DataFrame:
    """``facet_markets``."""
    places = auctions(mart).groupBy("market_name", "market_state", "market_city").agg(F.try_sum("lots_all").alias("lots"))
    return (
        places.groupBy(F.col("market_name").alias("name"))
        .agg(F.min(F.struct("market_state", "market_city")).alias("place"), F.try_sum("lots").alias("count"))
        .select("name", F.expr("place.market_state as state"), F.expr("place.market_city as city"), "count")
        .orderBy(F.desc("count"), "name")
    )
