"""All reports on one lot table, under one roof.

Each method gives a DataFrame and starts no job.  With a daily mart the reports that need
no weights are read from it.
"""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import schema as S
from .operators import aggregates, calculator, distributions, listing
from .operators.filters import date_range, equal
from .operators.suggestions import suggest_nearest, suggestions
from .plans import mart as marts, price_mart
from .plans.dashboard import dashboard_summary, dashboard_widgets, mart_dashboard_summary
from .streaming.sync import freshness_status


class Entries(NamedTuple):
    results: DataFrame
    page: DataFrame


class LotReports:
    """Reports on ``lots`` as of one day, today by default.

    ``mart`` is the daily mart of the same lots and ``prices`` their price counts by day, if
    there are any.
    """

    def __init__(
        self,
        lots: DataFrame,
        as_of: str | None = None,
        mart: DataFrame | None = None,
        prices: DataFrame | None = None,
    ):
        self.lots = lots
        self.as_of = as_of or date.today().isoformat()
        self.mart, self.prices = mart, prices

    def entries(self, sort_by="report_date", sort_dir="desc", page=1, limit=50, **conditions) -> Entries:
        """One page of matching lots, and the count of lots and pages."""
        return Entries(
            listing.list_lots(self.lots, sort_by, sort_dir, page, limit, **conditions),
            listing.page_info(self.lots, page, limit, **conditions),
        )

    def entries_after(self, last_value, last_id: str, limit=50, **options) -> DataFrame:
        """The page after a lot; the cost does not grow with the depth of the page."""
        return listing.list_lots_after(self.lots, last_value, last_id, limit=limit, **options)

    def suggestions(self, **conditions) -> DataFrame:
        """What to search instead when ``entries`` finds nothing."""
        return suggestions(self.lots, as_of=self.as_of, **conditions)

    def nearest(self, target_weight: float, k: int = 5, **conditions) -> DataFrame:
        """The last resort when no wider search helps: the lots closest in weight."""
        return listing.nearest_lots(self.lots, target_weight, k, **conditions)

    def nearest_if_none(self, k: int = 5, **conditions) -> DataFrame:
        """The lots closest in weight, if neither the search nor a wider one finds any."""
        return suggest_nearest(self.lots, self.as_of, k, **conditions)

    def nearest_many(self, targets: DataFrame, k: int = 5, **options) -> DataFrame:
        """For every row of ``targets`` (species, target_weight) the lots closest in weight."""
        return listing.nearest_lots_many(self.lots, targets, k, **options)

    def entry(self, key: str, report_date: str | None = None) -> DataFrame:
        return listing.get_lot(self.lots, key, report_date)

    def entry_trend(self, key: str, weeks: int = 5, report_date: str | None = None) -> DataFrame:
        return aggregates.lot_trend(self.lots, key, weeks, report_date)

    def summary(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The dashboard's figures, by default of the last two weeks."""
        window = self._fortnight(date_from, date_to)
        if self.mart is not None:
            return mart_dashboard_summary(self.mart, self.lots, *window)
        return dashboard_summary(self.lots, *window)

    def _fortnight(self, date_from: str | None, date_to: str | None) -> tuple[str, str]:
        start = date.fromisoformat(self.as_of) - timedelta(days=S.SUMMARY_DAYS)
        return date_from or start.isoformat(), date_to or self.as_of

    def mover(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The class whose average changed most against the two weeks before."""
        window = self._fortnight(date_from, date_to)
        if self.mart is not None:
            return marts.mart_top_mover(self.mart, *window)
        return aggregates.top_mover(self.lots, *window)

    def volume(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """Lots, markets and states of a window."""
        window = self._fortnight(date_from, date_to)
        if self.mart is not None:
            return marts.mart_volume(self.mart, *window)
        return aggregates.volume_summary(self.lots, *window)

    def price_box(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """Box plot figures of each commodity's prices per hundredweight."""
        if self.prices is not None:
            return price_mart.mart_price_box(self.prices, date_from, date_to)
        rows = date_range(self.lots, date_from, date_to) if date_from or date_to else self.lots
        return distributions.price_box(rows)

    def widgets(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        return dashboard_widgets(self.summary(date_from, date_to))

    def compare(self, species: str, period: int = S.MARKET_DAYS, **conditions) -> DataFrame:
        """Markets, best paying first."""
        _check(period, 7)
        if self.mart is not None and set(conditions) <= {"animal_class"}:
            return marts.mart_compare_markets(self.mart, self.as_of, species, period=period, **conditions)
        return aggregates.compare_markets(self.lots, self.as_of, species, period=period, **conditions)

    def compare_trend(self, species: str, period: int = S.MARKET_DAYS, **conditions) -> DataFrame:
        """As ``compare``, with the change against the period before."""
        _check(period, 7)
        return aggregates.compare_trend(self.lots, self.as_of, species, period=period, **conditions)

    def trends(self, period: int = 90, bracket: tuple[int, int] | None = None, **conditions) -> DataFrame:
        """Weekly averages; ``bracket`` is a range of weights in place of two bounds."""
        _check(period, 14)
        if bracket is not None:
            conditions |= {"weight_min": bracket[0], "weight_max": bracket[1]}
        if self.mart is not None and not {"weight_min", "weight_max"} & set(conditions):
            return marts.mart_weekly_trend(self.mart, self.as_of, period=period, **conditions)
        return aggregates.weekly_trend(self.lots, self.as_of, period=period, **conditions)

    def freshness(self, last_sync: str) -> DataFrame:
        """Newest publication, last and next sync, and the window of active lots."""
        return freshness_status(self.lots, last_sync)

    def scatter(self, **conditions) -> DataFrame:
        return listing.price_weight_scatter(self.lots, **conditions)

    def classes(self, species: str | None = None, intent: str | None = None) -> DataFrame:
        if self.mart is not None:
            return marts.mart_facet(equal(self.mart, species=species, buyer_intent=intent), "animal_class", "name")
        return aggregates.facet_classes(self.lots, species, intent)

    def markets(self) -> DataFrame:
        if self.mart is not None:
            return marts.mart_markets(self.mart)
        return aggregates.facet_markets(self.lots)

    def states(self) -> DataFrame:
        if self.mart is not None:
            return marts.mart_facet(self.mart, "market_state", "code")
        return aggregates.facet_states(self.lots)

    def grades(self) -> DataFrame:
        return aggregates.facet_grades(self.lots)

    def profitability(self, requests: DataFrame) -> DataFrame:
        return calculator.profitability_requests(requests, self.lots, self.as_of)

    def count(self) -> DataFrame:
        return listing.lot_count(self.lots)


def _check(period: int, least: int) -> None:
    if not least <= period <= 365:
        raise ValueError(f"period lies between {least} and 365 days")
