"""The reports under one roof, and calculator requests."""

import pytest
from helpers import lot_frame

from paddock.api import LotReports
from paddock.operators.normalise import normalise
from paddock.sources.payloads import flatten_sections


@pytest.fixture(scope="module")
def reports(spark):
    lots = lot_frame(
        spark,
        {"avg_weight": 80, "price_per_lb_e4": 28_000},
        {"avg_weight": 95, "price_per_lb_e4": 28_000, "animal_class": "Wethers"},
        {"avg_weight": 60, "species": "Sheep", "animal_class": "Ewes", "head_count": 0},
    )
    return LotReports(lots, "2026-02-15")


def test_every_report_runs(reports):
    found = reports.entries(species="Goats", limit=1)
    assert found.results.count() == 1
    assert tuple(found.page.first()) == (2, 1, 1, 2)
    assert reports.entry("0000").count() == 1 and reports.entry("none").count() == 0
    assert reports.entry_trend("0001").count() == 0  # no weight bracket is quoted
    assert reports.summary().first().total_lots == 3
    assert reports.widgets().count() == 2  # goats and volume: no sheep counts, no mover
    assert reports.compare("Goats").first().lot_count == 2
    assert reports.trends().first().lot_count == 3
    assert reports.scatter(limit=10).count() == 3
    assert reports.classes("Goats").count() == 2
    assert reports.markets().count() == reports.states().count() == 1
    assert reports.grades().count() == 0
    assert reports.count().first()[0] == 3
    assert reports.suggestions(species="Goats", state="CO").first().state == "TX"
    with pytest.raises(ValueError):
        reports.trends(period=7)


def test_calculator_requests(spark, reports):
    asked = spark.createDataFrame(
        [
            ("a", 187.0, 60.0, 80.0, None, "Goats", "Kids"),
            ("b", 187.0, 60.5, 80.0, 0.5, "Goats", None),
            ("c", 187.0, 60.0, None, None, None, None),
            ("d", 187.0, 60.0, 0.0, None, "Goats", "Kids"),
        ],
        "name string, purchase_price_per_head double, purchase_weight double, target_sell_weight double, "
        "feed_cost_per_lb_gain double, species string, animal_class string",
    )
    got = {r.name: r for r in reports.profitability(asked).collect()}
    assert (got["a"].total_investment, got["a"].margin_per_head, got["a"].margin_pct) == (201.61, 22.39, 11.11)
    assert (got["b"].weight_gain, got["b"].feed_cost_total) == (19.5, 9.75)
    assert got["b"].current_market_avg_per_lb == 2.8
    assert got["c"].weight_gain == 60.0 and got["c"].margin_per_head is None
    assert got["d"].break_even_per_lb == 0 and got["d"].current_market_avg_per_lb is None


def test_payloads_straight_to_lots(spark):
    text = (
        '[{"reportSection": "Report Details", "results": [{"slug_id": 7, "report_date": "02/09/2026", '
        '"class": "Kids", "category": "Goats", "price_unit": "Per Cwt", "wtd_Avg_Price": 250.5, "wtd_avg_wt": 60}]}]'
    )
    payloads = spark.createDataFrame([(text,)], "value string")
    lot = normalise(flatten_sections(payloads)).first()
    assert (lot.id, lot.price_per_lb_e4, lot.avg_weight) == ("7-02-09-2026-0000", 25_050, 60)
