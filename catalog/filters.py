"""Filter queries (F rows of the survey, and the filters specified in documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.public import public_lots
from paddock.operators import filters
from paddock.operators.normalise import retention
from paddock.sources.star import star_lots

from . import AS_OF, query
from .expected import lots, public

SHOWN = ("id", "report_date", "species", "animal_class", "market_state", "price_per_lb", "avg_weight")
NEEDS = (
    "id report_date species animal_class market_state price_per_lb_e4 avg_weight avg_price_e4 is_summary "
)


def register(name: str, where: str, extra: str = "", **conditions):
    """A query that lists the lots meeting ``conditions``."""

    @query(name, lots(f"SELECT {public(SHOWN)} FROM lots WHERE {where}"))
    def run(spark, sf_dir):
        rows = star_lots(spark, sf_dir, NEEDS + extra)
        return public_lots(filters.lot_filter(rows, **conditions), SHOWN)


register(
    "filter_equality",
    "species = 'Goats' AND buyer_intent = 'meat' AND commodity = 'Slaughter Goats' "
    "AND market_name = 'Supplier#000000007' AND NOT is_summary",
    "buyer_intent commodity market_name",
    species="Goats", intent="meat", commodity="Slaughter Goats", market="Supplier#000000007",
)
register(
    "filter_breed_and_lot_desc",
    "breed_type = 'Hair' AND lot_desc = 'red' AND NOT is_summary",
    "breed_type lot_desc",
    breed_type="Hair", lot_desc="red", species="",
)
register(
    "filter_membership",
    "animal_class IN ('Kids', 'Wethers', ' Ewes') AND quality_grade IN ('Brand#2', 'Brand#17') "
    "AND market_state IN ('NATION_1', 'NATION_2', 'NATION_3') AND NOT is_summary",
    "quality_grade",
    animal_class="Kids,Wethers, Ewes", grade="Brand#2,Brand#17", state="NATION_1,NATION_2,NATION_3",
)
register(
    "filter_weight_range", "avg_weight BETWEEN 100 AND 160 AND NOT is_summary",
    weight_min=100, weight_max=160,
)
register(
    "filter_price_range", "ppl BETWEEN 22500 AND 31250 AND NOT is_summary",
    price_min=2.25, price_max=3.125,
)
register(
    "filter_date_range",
    "report_date BETWEEN DATE '2000-03-01' AND DATE '2000-04-15' AND NOT is_summary",
    "report_month",
    date_from="2000-03-01", date_to="2000-04-15",
)
register("filter_summaries_kept", "animal_class = 'Kids'", include_summary=True, animal_class="Kids")
register("filter_summaries_excluded", "animal_class = 'Kids' AND NOT is_summary", animal_class="Kids")
register(
    "dressing_age_filter",
    "dressing IN ('High', 'Low') AND age IN ('Young (2-4 yrs)') AND NOT is_summary",
    "dressing age",
    dressing="High,Low", age="Young (2-4 yrs)",
)
register(
    "weight_bracket", "weight_break_low >= 100 AND weight_break_high <= 200 AND NOT is_summary",
    "weight_break_low weight_break_high",
    bracket="100-200",
)


def _listed(name: str, where: str, keep):
    @query(name, lots(f"SELECT {public(SHOWN)} FROM lots WHERE {where}"))
    def run(spark, sf_dir):
        return public_lots(keep(star_lots(spark, sf_dir, NEEDS)), SHOWN)


_listed("filter_price_present", "cents IS NOT NULL", lambda rows: rows.filter(F.col("avg_price_e4").isNotNull()))
_listed(
    "filter_relative_window",
    "report_date BETWEEN DATE '2001-07-31' - 30 AND DATE '2001-07-31'",
    lambda rows: filters.date_window(rows, AS_OF, 30),
)
_listed(
    "retention",
    "report_date BETWEEN DATE '2001-07-31' - 100 AND DATE '2001-07-31'",
    lambda rows: retention(rows, AS_OF),
)
_listed(
    "filter_positive_weight",
    "NOT is_summary AND ppl IS NOT NULL AND avg_weight > 0",
    lambda rows: filters.priced_per_lb(rows).filter("avg_weight > 0"),
)
_listed(
    "filter_sentinel_bounds",
    "avg_weight >= 200",
    lambda rows: filters.weight_range(rows, *filters.weight_sentinels(200, 350)),
)
_listed(
    "filter_target_weight",
    "avg_weight BETWEEN 40 AND 80",
    lambda rows: filters.weight_range(rows, *filters.target_weight_range(60)),
)
_listed(
    "week_drilldown",
    "NOT is_summary AND ppl IS NOT NULL AND strftime(report_date, '%Y-W%W') = '2001-W28'",
    lambda rows: filters.week_drilldown(rows, "2001-W28"),
)
