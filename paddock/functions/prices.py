"""Prices per pound, head and hundredweight; carcass value; break-even sums."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from .. import schema as S
from .exact import E4, money_text, product, ratio, signed_ratio, to_cents, total


def derive_prices(price_e4: str, unit: str, weight_e4: str) -> dict[str, str]:
    """SQL of the three comparable prices of a lot, all in 1e-4 dollars.

    Per pound is rounded to 1e-4 dollars first; per head and per hundredweight come
    from that rounded value, to whole cents.  ``weight_e4`` is the weight before
    truncation, in 1e-4 lb; without a weight above zero the prices needing it are
    null.
    """
    weight = f"if({weight_e4} > 0, {weight_e4}, null)"
    lb_from_cwt = _nearest(price_e4, "100")
    lb_from_head = _nearest(f"try_multiply({price_e4}, {E4}L)", weight)
    head_from_cwt = _nearest(f"try_multiply({lb_from_cwt}, {weight})", str(100 * E4))

    def by_unit(if_cwt: str, if_head: str) -> str:
        return f"case {unit} when '{S.PER_CWT}' then {if_cwt} when '{S.PER_UNIT}' then {if_head} end"

    return {
        "price_per_lb_e4": by_unit(lb_from_cwt, lb_from_head),
        "price_per_head_e4": by_unit(f"try_multiply({head_from_cwt}, 100L)", price_e4),
        "price_per_cwt_e4": by_unit(price_e4, f"try_multiply({lb_from_head}, 100L)"),
    }


def _nearest(num: str, den: str) -> str:
    """SQL of the nearest whole quotient, halves away from zero; ``den`` above zero.

    Null where a step is beyond whole numbers, so that no row stops a job.
    """
    twice = f"try_multiply(2L, {num})"
    return f"(try_add({twice}, if(({num}) < 0, -1L, 1L) * ({den})) div try_multiply(2L, {den}))"


def display_price(shown: str) -> Column:
    """Price text of a lot in the unit ``lb``, ``head`` or ``cwt``; a dash if unknown."""
    lb, head, cwt = (F.col(f"price_per_{u}_e4") for u in ("lb", "head", "cwt"))
    if shown == "lb":
        text = money_text(to_cents(lb))
    elif shown == "head":
        text = ratio(head, F.lit(E4)).cast("string")
    else:
        text = money_text(to_cents(F.coalesce(cwt, F.col("avg_price_e4"))))
    return F.coalesce(F.concat(F.lit("$"), text), F.lit("—"))


def display_unit(shown: str) -> Column:
    return F.lit({"lb": "/lb", "head": "/hd"}.get(shown, "/cwt"))


def carcass_yield_pct(dressing: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, pct in S.CARCASS_YIELD_PCT.items():
        out = F.when(dressing == name, pct).otherwise(out)
    return out


class BreakEven(NamedTuple):
    weight_gain_e2: Column
    feed_cost_total_e8: Column
    shrink_loss_e8: Column
    total_investment_e8: Column
    break_even_per_lb_e4: Column


def break_even(
    purchase_price_e4: Column,
    purchase_weight_e2: Column,
    target_weight_e2: Column,
    feed_cost_e4: Column,
    mortality_bp: Column,
) -> BreakEven:
    """Cost of growing one head to the target weight.

    Weights are in 1e-2 lb, mortality in 1e-2 per cent, so the sums of money are
    exact counts of 1e-8 dollars.  Only the price per pound is rounded; the same
    number read as cents is the price per hundredweight.
    """
    gain = F.try_subtract(target_weight_e2.cast("bigint"), purchase_weight_e2.cast("bigint"))
    feed = product(gain, feed_cost_e4, 100)
    shrink = product(purchase_price_e4, mortality_bp)
    invested = total(product(purchase_price_e4, E4), feed, shrink)
    target = F.when(target_weight_e2 > 0, target_weight_e2)
    per_lb = F.coalesce(signed_ratio(invested, product(target, 100)), F.lit(0))
    return BreakEven(gain, feed, shrink, invested, per_lb)


def margin_cents(market_avg_e4: Column, target_weight_e2: Column, total_e8: Column) -> Column:
    """Profit per head in cents at the market average, itself rounded to 1e-4."""
    return cents_of_e8(F.try_subtract(product(market_avg_e4, target_weight_e2, 100), total_e8))


def margin_pct_e2(margin: Column, total_e8: Column) -> Column:
    """Profit as a share of the investment, in 1e-2 per cent.

    In decimals: the product is beyond ``bigint`` from a margin of nine million dollars up.
    """
    wide = "decimal(38,0)"
    scaled = margin.cast("decimal(19,0)") * F.lit(10_000_000_000).cast("decimal(11,0)")
    whole = F.when(total_e8 > 0, total_e8).cast("decimal(19,0)")
    half = F.when(margin < 0, -whole).otherwise(whole)
    return F.call_function("div", (scaled * 2 + half).cast(wide), (whole * 2).cast(wide))


def cents_of_e8(units_e8: Column) -> Column:
    return signed_ratio(units_e8, F.lit(1_000_000))
