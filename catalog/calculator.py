"""Calculator queries (P rows, J2, and the unit and carcass conversions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.exact import dollars
from paddock.operators import calculator as calc
from paddock.sources.star import star_lots

from . import AS_OF, query
from .expected import lots, public, ratio

NEEDS = (
    "id species animal_class avg_weight price_per_head_e4 price_per_lb_e4 head_count report_date "
    "buyer_intent is_summary"
)
MEAT = (
    "NOT is_summary AND ppl IS NOT NULL AND buyer_intent = 'meat' "
    "AND report_date BETWEEN DATE '2001-07-31' - 30 AND DATE '2001-07-31'"
)
BUY = """
    SELECT *, coalesce(nullif(pph, 0), 20000) AS buy_cents, coalesce(nullif(avg_weight, 0), 60) AS buy_weight FROM lots"""


def signed(num: str, den: str) -> str:
    """Nearest whole quotient, halves away from zero."""
    return f"CASE WHEN ({num}) < 0 THEN -({ratio(f'-({num})', den)}) ELSE {ratio(num, den)} END"


def costs(target: str) -> str:
    """Sums in 1e-4 cents, for feed at 45 cents and 3 per cent loss."""
    return f"""
    SELECT *, {target} AS target, ({target}) - buy_weight AS gain, (({target}) - buy_weight) * 45 * 10000 AS feed,
      buy_cents * 300 AS shrink,
      buy_cents * 10000 + (({target}) - buy_weight) * 45 * 10000 + buy_cents * 300 AS total
    FROM ({BUY})"""


BREAK_EVEN = f"""id, gain / 1 AS weight_gain, ({signed('feed', '10000')}) / 100 AS feed_cost_total,
      ({signed('shrink', '10000')}) / 100 AS shrink_loss, ({signed('total', '10000')}) / 100 AS total_investment,
      ({signed('total', 'target * 100')}) / 10000 AS break_even_per_lb,
      ({signed('total', 'target * 100')}) / 100 AS break_even_per_cwt,
      ({signed('total', '10000')}) / 100 AS break_even_per_head"""
MARGIN_CENTS = signed("market * target * 100 - total", "10000")
MARGIN = f"""nullif(market, 0) / 10000 AS current_market_avg_per_lb, margin / 100 AS margin_per_head,
      ({signed('margin * 100000000', 'total')}) / 100 AS margin_pct"""


def margins(cost: str, market: str, on: str) -> str:
    return lots(f"""
    SELECT {BREAK_EVEN}, {MARGIN}
    FROM (SELECT *, CASE WHEN market <> 0 THEN {MARGIN_CENTS} END AS margin
      FROM (SELECT c.*, m.market FROM ({cost}) c LEFT JOIN ({market}) m ON {on}))""")


@query("break_even", lots(f"SELECT {BREAK_EVEN} FROM ({costs('120')})"))
def break_even(spark, sf_dir):
    rows = calc.with_break_even(calc.profit_defaults(star_lots(spark, sf_dir, NEEDS)))
    return rows.select("id", *calc.break_even_columns())


NEAR_120 = f"""
    SELECT species, animal_class, {ratio('CAST(sum(ppl * hw) AS BIGINT)', 'CAST(sum(hw) AS BIGINT)')} AS market
    FROM lots WHERE {MEAT} AND avg_weight BETWEEN 105 AND 135 GROUP BY ALL"""


@query("break_even_market", lots(f"""
    SELECT species, animal_class, market / 10000 AS current_market_avg_per_lb FROM ({NEAR_120})"""))
def break_even_market(spark, sf_dir):
    market = calc.market_at_weight(star_lots(spark, sf_dir, NEEDS), AS_OF).filter("class_key <> ''")
    return market.select(
        "species",
        F.col("class_key").alias("animal_class"),
        dollars(F.col("market_avg_e4")).alias("current_market_avg_per_lb"),
    )


@query("margin", margins(
    costs("120"), NEAR_120, "c.species = m.species AND c.animal_class = m.animal_class"))
def margin(spark, sf_dir):
    """Every lot fed to 120 lb, against its own class."""
    return calc.profitability(star_lots(spark, sf_dir, NEEDS), AS_OF)


NEAR_120_SPECIES = NEAR_120.replace("species, animal_class,", "species,")


@query("margin_by_species", margins(costs("120"), NEAR_120_SPECIES, "c.species = m.species"))
def margin_by_species(spark, sf_dir):
    return calc.profitability(star_lots(spark, sf_dir, NEEDS), AS_OF, by_class=False)


# Market by whole target weight: the sums of all weights within 15 lb.
BY_WEIGHT = f"""
    SELECT species, animal_class, avg_weight, CAST(sum(ppl * hw) AS BIGINT) AS num, CAST(sum(hw) AS BIGINT) AS den
    FROM lots WHERE {MEAT} AND avg_weight IS NOT NULL GROUP BY ALL"""
NEAR_TARGET = f"""
    SELECT t.species, t.animal_class, t.target,
      {ratio('CAST(sum(num) AS BIGINT)', 'CAST(sum(den) AS BIGINT)')} AS market
    FROM (SELECT DISTINCT species, animal_class, buy_weight + 40 AS target FROM ({BUY})) t
    JOIN ({BY_WEIGHT}) w ON t.species = w.species AND t.animal_class = w.animal_class
      AND w.avg_weight BETWEEN t.target - 15 AND t.target + 15
    GROUP BY ALL"""


@query("break_even_market_per_lot", margins(
    costs("buy_weight + 40"), NEAR_TARGET,
    "c.species = m.species AND c.animal_class = m.animal_class AND c.target = m.target"))
def per_lot_target(spark, sf_dir):
    """Every lot fed by 40 lb, against lots near the weight it reaches."""
    return calc.profitability_at_gain(star_lots(spark, sf_dir, NEEDS), AS_OF, 40).drop("target_weight")


# Feed at 45.67 cents, 2.35 per cent loss, to 97 lb, in 1e-8 dollars: few sums are whole cents.
ODD_COSTS = f"""
    SELECT *, 97 - buy_weight AS gain, (97 - buy_weight) * 4567 * 10000 AS feed, buy_cents * 235 * 100 AS shrink,
      buy_cents * 1000000 + (97 - buy_weight) * 4567 * 10000 + buy_cents * 235 * 100 AS total FROM ({BUY})"""


@query("output_rounding", lots(f"""
    SELECT id, gain / 1 AS weight_gain, ({signed('feed', '1000000')}) / 100 AS feed_cost_total,
      ({signed('shrink', '1000000')}) / 100 AS shrink_loss, ({signed('total', '1000000')}) / 100 AS total_investment,
      ({signed('total', '970000')}) / 10000 AS break_even_per_lb, ({signed('total', '970000')}) / 100 AS break_even_per_cwt,
      ({signed('total', '1000000')}) / 100 AS break_even_per_head
    FROM ({ODD_COSTS})"""))
def output_rounding(spark, sf_dir):
    """Every figure of the calculator: money to cents, prices per pound to 1e-4 dollars, halves away from zero."""
    rows = calc.profit_defaults(star_lots(spark, sf_dir, NEEDS))
    return calc.with_break_even(rows, 97, 0.4567, 2.35).select("id", *calc.break_even_columns())


@query("profit_defaults", lots(f"""
    SELECT id, buy_cents / 100 AS purchase_price, buy_weight AS purchase_weight FROM ({BUY})"""))
def profit_defaults(spark, sf_dir):
    rows = calc.profit_defaults(star_lots(spark, sf_dir, "id price_per_head_e4 avg_weight"))
    return rows.select(
        "id",
        dollars(F.col("purchase_price_e4")).alias("purchase_price"),
        (F.col("purchase_weight_e2") / 100).cast("bigint").alias("purchase_weight"),
    )


@query("convert_units", lots(f"""
    SELECT {public(('id', 'price_unit', 'avg_price', 'price_per_cwt', 'price_per_lb', 'price_per_head'))} FROM lots"""))
def convert_units(spark, sf_dir):
    return calc.convert_units(star_lots(spark, sf_dir, "id price_unit avg_price_e4 avg_weight"))


@query("carcass_value", lots(f"""
    SELECT id, pct AS yield_pct, avg_weight * pct / 100 AS carcass_weight,
      ({signed('pph * 10000', 'avg_weight * pct')}) / 10000 AS price_per_lb_carcass
    FROM (SELECT *, CASE dressing WHEN 'High' THEN 54 WHEN 'Average' THEN 50 WHEN 'Low' THEN 46 END AS pct FROM lots)"""))
def carcass_value(spark, sf_dir):
    return calc.carcass_value(star_lots(spark, sf_dir, "id dressing avg_weight price_per_head_e4"))


REQUESTS = f"""
    SELECT *, target - buy_weight AS gain, (target - buy_weight) * feed_e2 * 10000 AS feed, buy_cents * loss_bp AS shrink,
      buy_cents * 10000 + (target - buy_weight) * feed_e2 * 10000 + buy_cents * loss_bp AS total
    FROM (SELECT *, 90 + CAST(slug_id % 7 AS BIGINT) * 10 AS target, CASE WHEN slug_id % 2 = 0 THEN 40 ELSE 55 END AS feed_e2,
      CASE WHEN slug_id % 3 = 0 THEN 250 ELSE 300 END AS loss_bp FROM ({BUY}))"""
AT_REQUEST = NEAR_TARGET.replace(
    "buy_weight + 40 AS target", "90 + CAST(slug_id % 7 AS BIGINT) * 10 AS target")


@query("profitability_requests", margins(
    REQUESTS, AT_REQUEST, "c.species = m.species AND c.animal_class = m.animal_class AND c.target = m.target"))
def requests(spark, sf_dir):
    """A calculator request for every lot, each with its own target, feed cost and loss."""
    rows = star_lots(spark, sf_dir, NEEDS + " slug_id")
    asked = calc.profit_defaults(rows).select(
        "id", "species", "animal_class",
        dollars(F.col("purchase_price_e4")).alias("purchase_price_per_head"),
        (F.col("purchase_weight_e2") / 100).alias("purchase_weight"),
        F.expr("90.0D + slug_id % 7 * 10").alias("target_sell_weight"),
        F.expr("if(slug_id % 2 = 0, 0.40D, 0.55D)").alias("feed_cost_per_lb_gain"),
        F.expr("if(slug_id % 3 = 0, 2.5D, 3.0D)").alias("mortality_pct"),
    )
    return calc.profitability_requests(asked, rows, AS_OF)
