"""Break-even of feeding a lot's animals, margin at the market, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.exact import E4, dollars, product, ratio, signed_ratio
from ..functions.measures import weight_sum, weighted_sum
from ..functions.prices import (
    break_even,
    carcass_yield_pct,
    cents_of_e8,
    derive_prices,
    margin_cents,
    margin_pct_e2,
)
from ..plans.band_join import band_sums
from .filters import date_window, priced_per_lb


def profit_defaults(lots: DataFrame) -> DataFrame:
    """Add purchase price and weight per head; 200 dollars and 60 lb where unknown or zero."""
    price = F.nullif(F.col("price_per_head_e4"), F.lit(0))
    weight = F.nullif(F.col("avg_weight"), F.lit(0))
    return lots.withColumns(
        {
            "purchase_price_e4": F.coalesce(price, F.lit(S.DEFAULT_PURCHASE_PRICE * E4)),
            "purchase_weight_e2": product(F.coalesce(weight, F.lit(S.DEFAULT_PURCHASE_WEIGHT)), 100),
        }
    )


def as_e2(weight: Column) -> Column:
    """Pounds, whole or double, as whole 1e-2 lb."""
    return F.floor(weight * 100 + 0.5)


def with_break_even(
    rows: DataFrame,
    target_weight: Column | float = S.DEFAULT_TARGET_WEIGHT,
    feed_cost_per_lb_gain: Column | float = S.DEFAULT_FEED_COST,
    mortality_pct: Column | float = S.DEFAULT_MORTALITY_PCT,
) -> DataFrame:
    """Add the exact break-even sums to rows that have ``profit_defaults`` columns."""
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    rows = rows.withColumn("target_weight_e2", as_e2(column(target_weight)))
    sums = break_even(
        F.col("purchase_price_e4"),
        F.col("purchase_weight_e2"),
        F.col("target_weight_e2"),
        F.floor(column(feed_cost_per_lb_gain) * E4 + 0.5),
        F.floor(column(mortality_pct) * 100 + 0.5),
    )
    return rows.withColumns(sums._asdict())


def break_even_columns() -> list[Column]:
    """The break-even as callers see it: cents, and 1e-4 dollars per pound."""
    return [
        (F.col("weight_gain_e2") / 100).alias("weight_gain"),
        *[
            (cents_of_e8(F.col(f"{name}_e8")) / 100).alias(name)
            for name in ("feed_cost_total", "shrink_loss", "total_investment")
        ],
        dollars(F.col("break_even_per_lb_e4")).alias("break_even_per_lb"),
        (F.col("break_even_per_lb_e4") / 100).alias("break_even_per_cwt"),
        (cents_of_e8(F.col("total_investment_e8")) / 100).alias("break_even_per_head"),
    ]


def with_class_key(rows: DataFrame) -> DataFrame:
    """Add the class to look the market up by; empty means the species as a whole."""
    return rows.withColumn("class_key", F.coalesce("animal_class", F.lit("")))


def market_sums(lots: DataFrame, as_of: str) -> DataFrame:
    """Sums behind the meat-market average, by species, class and whole pound.

    Rows with an empty class key cover every class.  The size does not grow with
    the lots.
    """
    rows = date_window(priced_per_lb(lots), as_of, S.MARKET_DAYS).filter(
        (F.col("buyer_intent") == "meat") & F.col("avg_weight").isNotNull()
    )
    by_class = rows.groupBy("species", "animal_class", "avg_weight").agg(
        weighted_sum("price_per_lb_e4").alias("num"), weight_sum("price_per_lb_e4").alias("den")
    )
    by_both = by_class.groupingSets(
        [["species", "animal_class", "avg_weight"], ["species", "avg_weight"]],
        "species", "animal_class", "avg_weight",
    ).agg(
        F.grouping("animal_class").alias("all_classes"),
        F.try_sum("num").alias("num"),
        F.try_sum("den").alias("den"),
    )
    return with_class_key(
        by_both.filter((F.col("all_classes") == 1) | F.col("animal_class").isNotNull())
    ).select("species", "class_key", product(F.col("avg_weight"), 100).alias("weight_e2"), "num", "den")


def market_at_weight(
    lots: DataFrame,
    as_of: str,
    target_weight: float = S.DEFAULT_TARGET_WEIGHT,
    by_class: bool = True,
) -> DataFrame:
    """Meat-market average within 15 lb of one weight, by species and, if asked, class."""
    low, high = target_weight - S.MARKET_BAND_LB, target_weight + S.MARKET_BAND_LB
    near = market_sums(lots.filter(F.col("avg_weight").between(low, high)), as_of)
    if not by_class:
        near = near.filter("class_key = ''")
    return near.groupBy("species", "class_key").agg(
        ratio(F.try_sum("num"), F.try_sum("den")).alias("market_avg_e4")
    )


def with_market(rows: DataFrame, market: DataFrame, keys: list[str]) -> DataFrame:
    """Attach market averages to every row.

    The join is left to the planner, which learns the size of ``market`` while the query
    runs and broadcasts it only below the broadcast threshold; beyond, a hot key of the
    rows is split.
    """
    return rows.join(market, keys, "left")


def with_margin(rows: DataFrame) -> DataFrame:
    """Add margin per head, in cents and in 1e-2 per cent of the investment."""
    total = F.col("total_investment_e8")
    return rows.withColumn(
        "margin_cents",
        margin_cents(F.nullif(F.col("market_avg_e4"), F.lit(0)), F.col("target_weight_e2"), total),
    ).withColumn("margin_pct_e2", margin_pct_e2(F.col("margin_cents"), total))


def margin_columns() -> list[Column]:
    return [
        dollars(F.nullif(F.col("market_avg_e4"), F.lit(0))).alias("current_market_avg_per_lb"),
        (F.col("margin_cents") / 100).alias("margin_per_head"),
        (F.col("margin_pct_e2") / 100).alias("margin_pct"),
    ]


def profitability(
    lots: DataFrame,
    as_of: str,
    target_weight: float = S.DEFAULT_TARGET_WEIGHT,
    feed_cost_per_lb_gain: float = S.DEFAULT_FEED_COST,
    mortality_pct: float = S.DEFAULT_MORTALITY_PCT,
    by_class: bool = True,
) -> DataFrame:
    """Break-even and margin of every lot, grown to one target weight."""
    market = market_at_weight(lots, as_of, target_weight, by_class)
    rows = with_break_even(
        profit_defaults(lots), target_weight, feed_cost_per_lb_gain, mortality_pct
    )
    rows = with_class_key(rows) if by_class else rows.withColumn("class_key", F.lit(""))
    return with_margin(with_market(rows, market, ["species", "class_key"])).select(
        "id", *break_even_columns(), *margin_columns()
    )


def with_market_at_target(rows: DataFrame, lots: DataFrame, as_of: str) -> DataFrame:
    """Add the market average near each row's own target weight, and the margin.

    The market is looked up by weight band: the distinct species, class and target are
    joined with the market's sums by weight, and only that short list is joined back.
    """
    rows = with_class_key(rows)
    keys = ["species", "class_key"]
    market = band_sums(
        rows.select(*keys, "target_weight_e2").distinct(),
        market_sums(lots, as_of),
        keys,
        "target_weight_e2",
        "weight_e2",
        S.MARKET_BAND_LB * 100,
        ["num", "den"],
    ).select(*keys, "target_weight_e2", ratio(F.col("num"), F.col("den")).alias("market_avg_e4"))
    return with_margin(with_market(rows, market, [*keys, "target_weight_e2"]))


def profitability_at_gain(lots: DataFrame, as_of: str, gain: float) -> DataFrame:
    """Break-even and margin of every lot, each grown by ``gain`` pounds."""
    target = F.col("purchase_weight_e2") / 100 + gain
    rows = with_break_even(profit_defaults(lots), target)
    return with_market_at_target(rows, lots, as_of).select(
        "id",
        (F.col("target_weight_e2") / 100).alias("target_weight"),
        *break_even_columns(),
        *margin_columns(),
    )


def profitability_requests(requests: DataFrame, lots: DataFrame, as_of: str) -> DataFrame:
    """Answer calculator requests, one per row.

    A request has ``purchase_price_per_head`` and ``purchase_weight``, may have
    ``target_sell_weight``, ``feed_cost_per_lb_gain`` and ``mortality_pct``, and is
    compared with the market if it names a ``species`` (and ``animal_class``).  Its
    other columns are kept.
    """
    given = set(requests.columns)

    def value(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in given else F.lit(default)

    inputs = {"purchase_price_per_head", "purchase_weight", "target_sell_weight",
              "feed_cost_per_lb_gain", "mortality_pct", "species", "animal_class"}
    kept = [name for name in requests.columns if name not in inputs]
    rows = requests.withColumns(
        {
            "purchase_price_e4": F.floor(F.col("purchase_price_per_head") * E4 + 0.5),
            "purchase_weight_e2": as_e2(F.col("purchase_weight")),
            **{
                name: F.lit(None).cast("string")
                for name in ("species", "animal_class") if name not in given
            },
        }
    )
    rows = with_break_even(
        rows,
        value("target_sell_weight", S.DEFAULT_TARGET_WEIGHT),
        value("feed_cost_per_lb_gain", S.DEFAULT_FEED_COST),
        value("mortality_pct", S.DEFAULT_MORTALITY_PCT),
    )
    return with_market_at_target(rows, lots, as_of).select(
        *kept, *break_even_columns(), *margin_columns()
    )


def convert_units(lots: DataFrame) -> DataFrame:
    """Every lot's price per hundredweight, pound and head."""
    prices = derive_prices("avg_price_e4", "price_unit", f"avg_weight * {E4}")
    return lots.select(
        "id",
        "price_unit",
        dollars(F.col("avg_price_e4")).alias("avg_price"),
        *[dollars(F.expr(price)).alias(name.removesuffix("_e4")) for name, price in prices.items()],
    )


def carcass_value(lots: DataFrame) -> DataFrame:
    """Carcass weight by dressing, and price per pound hanging weight."""
    yield_pct = carcass_yield_pct(F.col("dressing"))
    weight_e2 = F.col("avg_weight") * yield_pct
    per_lb_e4 = signed_ratio(product(F.col("price_per_head_e4"), 100), F.when(weight_e2 > 0, weight_e2))
    return lots.select(
        "id",
        yield_pct.alias("yield_pct"),
        (weight_e2 / 100).alias("carcass_weight"),
        dollars(per_lb_e4).alias("price_per_lb_carcass"),
    )
