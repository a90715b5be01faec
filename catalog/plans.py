"""Queries served by the daily mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.api import LotReports
from paddock.plans import market_sketches, mart as m, price_mart
from paddock.session import scratch_path
from paddock.sources.star import star_lots

from . import aggregates, distributions  # noqa: F401  (register the expected results reused here)
from . import AS_OF, DATE_FROM, EXPECTED, query
from .expected import heads, lots

NEEDS = (
    "report_date species commodity buyer_intent animal_class market_state market_city market_name "
    "is_summary price_per_lb_e4 price_per_head_e4 head_count"
)


def mart_of(spark, sf_dir):
    return m.daily_mart(star_lots(spark, sf_dir, NEEDS))


DAILY_MART = f"""
    SELECT day AS report_date, species, commodity, buyer_intent, animal_class, market_state, market_city,
      market_name, is_summary,
      CAST(sum(ppl * hw) AS BIGINT) AS lb_num, CAST(sum(hw) FILTER (ppl IS NOT NULL) AS BIGINT) AS lb_den,
      CAST(sum(pph * 100 * hw) FILTER (ppl IS NOT NULL) AS BIGINT) AS head_num,
      CAST(sum(hw) FILTER (ppl IS NOT NULL AND pph IS NOT NULL) AS BIGINT) AS head_den,
      min(ppl) AS lb_min, max(ppl) AS lb_max, count(ppl) AS lots, {heads('ppl IS NOT NULL')} AS heads,
      count(*) AS lots_all
    FROM lots GROUP BY ALL"""


@query("daily_mart", lots(DAILY_MART))
def daily_mart(spark, sf_dir):
    return mart_of(spark, sf_dir).withColumn("report_date", F.col("report_date").cast("string"))


@query("mart_weekly_trend", EXPECTED["weekly_trend"])
def mart_weekly_trend(spark, sf_dir):
    return m.mart_weekly_trend(mart_of(spark, sf_dir), AS_OF)


@query("mart_compare_markets", EXPECTED["compare_markets"])
def mart_compare_markets(spark, sf_dir):
    return m.mart_compare_markets(mart_of(spark, sf_dir), AS_OF, "Goats")


@query("mart_top_mover", EXPECTED["top_mover"])
def mart_top_mover(spark, sf_dir):
    return m.mart_top_mover(mart_of(spark, sf_dir), DATE_FROM, AS_OF)


@query("mart_volume_summary", EXPECTED["volume_summary"])
def mart_volume_summary(spark, sf_dir):
    return m.mart_volume(mart_of(spark, sf_dir), DATE_FROM, AS_OF)


@query("mart_facet_states", EXPECTED["facet_states"])
def mart_facet_states(spark, sf_dir):
    return m.mart_facet(mart_of(spark, sf_dir), "market_state", "code")


@query("mart_facet_classes", EXPECTED["facet_classes"])
def mart_facet_classes(spark, sf_dir):
    return LotReports(star_lots(spark, sf_dir, NEEDS), AS_OF, mart_of(spark, sf_dir)).classes("Goats", "meat")


@query("mart_facet_markets", EXPECTED["facet_markets"])
def mart_facet_markets(spark, sf_dir):
    return m.mart_markets(mart_of(spark, sf_dir))


@query("mart_dashboard_summary", EXPECTED["dashboard_summary"])
def mart_dashboard_summary(spark, sf_dir):
    """The facade's summary, from the mart."""
    lots_with_dates = star_lots(spark, sf_dir, "published_date")
    return LotReports(lots_with_dates, AS_OF, mart_of(spark, sf_dir)).summary(DATE_FROM)


# --- price distributions from counts by day ---

def stored_prices(spark, sf_dir, rows=None):
    """Counts by day, stored in three goes: wrong rows among the first, which the last takes off again."""
    rows = distributions.priced_rows(spark, sf_dir, "report_date", "species", "commodity", "slug_id")
    path = scratch_path(spark, "prices")
    wrong = rows.where("slug_id % 5 = 0").withColumn("avg_price_e4", F.col("avg_price_e4") * 3 + 700)
    price_mart.change_prices(spark, path, rows.where("slug_id % 2 = 0"))
    price_mart.change_prices(spark, path, wrong)
    price_mart.change_prices(spark, path, rows.where("slug_id % 2 = 1"), wrong)
    return price_mart.read_prices(spark, path)


@query("mart_price_box", EXPECTED["price_box"])
def mart_price_box(spark, sf_dir):
    return price_mart.mart_price_box(stored_prices(spark, sf_dir))


@query("mart_price_outliers", EXPECTED["price_box_outliers"])
def mart_price_outliers(spark, sf_dir):
    return price_mart.mart_price_outliers(stored_prices(spark, sf_dir))


@query("mart_price_histogram", EXPECTED["price_histogram"])
def mart_price_histogram(spark, sf_dir):
    return price_mart.mart_price_histogram(stored_prices(spark, sf_dir))


WINDOW = f"report_date BETWEEN DATE '{DATE_FROM}' AND DATE '{AS_OF}' AND price_unit = 'Per Cwt' AND cents IS NOT NULL"


@query("mart_price_box_window", EXPECTED["price_box"].replace("price_unit = 'Per Cwt' AND cents IS NOT NULL", WINDOW))
def mart_price_box_window(spark, sf_dir):
    """A fortnight's box plot: only its months are read."""
    return price_mart.mart_price_box(stored_prices(spark, sf_dir), DATE_FROM, AS_OF)


# --- distinct markets of a window ---

PLACES = "report_date market_name market_state is_summary report_month"


@query("mart_distinct_markets", EXPECTED["volume_summary"])
def mart_distinct_markets(spark, sf_dir):
    names = market_sketches.daily_market_names(star_lots(spark, sf_dir, PLACES))
    return market_sketches.exact_volume(names, DATE_FROM, AS_OF)


@query("mart_market_sketches", f"""
    SELECT lots, true AS markets_within, true AS states_within FROM ({EXPECTED["volume_summary"]})""")
def mart_market_sketches(spark, sf_dir):
    """The merged sketches' counts lie within the stated error of the exact ones."""
    rows = star_lots(spark, sf_dir, PLACES)
    about = market_sketches.sketched_volume(market_sketches.daily_markets(rows), DATE_FROM, AS_OF)
    exact = market_sketches.exact_volume(market_sketches.daily_market_names(rows), DATE_FROM, AS_OF)
    exact = exact.select("lots", *[F.col(name).alias(f"exact_{name}") for name in ("markets", "states")])

    def within(name):
        return F.abs(F.col(name) - F.col(f"exact_{name}")) <= F.col("relative_error") * F.col(f"exact_{name}")

    # Both are one row; the number of lots is exact on either side.
    both = about.join(exact, "lots")
    return both.select("lots", within("markets").alias("markets_within"), within("states").alias("states_within"))
