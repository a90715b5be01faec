"""Operators against brute force on small or skewed inputs."""

import datetime
import random

import numpy as np
import pytest
from helpers import lot_frame
from pyspark.sql import functions as F

from paddock.operators import aggregates, calculator as calc, distributions as dist, filters, listing
from paddock.operators.normalise import keep_final, retention
from paddock.operators.suggestions import suggestions
from paddock.plans import mart
from paddock.plans.band_join import band_sums
from paddock.plans.dashboard import dashboard_summary, dashboard_widgets
from paddock.plans.row_index import dense_positions, with_ordered_seq


def random_lots(spark, n=400, seed=1):
    """Lots of which a third share one class, market and price."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rnd.random() < 0.33
        rows.append(
            {
                "species": "Goats" if hot else rnd.choice(["Goats", "Sheep", None]),
                "animal_class": "Kids" if hot else rnd.choice(["Kids", "Ewes", None]),
                "market_name": "HOT" if hot else rnd.choice(["A", "B", None]),
                "market_state": rnd.choice(["TX", "PA", None]),
                "buyer_intent": rnd.choice(["meat", "feeder", None]),
                "price_per_lb_e4": rnd.choice([None, rnd.randint(5_000, 60_000)]),
                "price_per_head_e4": rnd.choice([None, rnd.randint(100, 400) * 10_000]),
                "head_count": rnd.choice([None, 0, rnd.randint(1, 30)]),
                "avg_weight": rnd.choice([None, rnd.randint(20, 330)]),
                "is_summary": rnd.random() < 0.1,
                "report_date": (datetime.date(2026, 1, 1) + datetime.timedelta(rnd.randint(0, 60))).isoformat(),
            }
        )
    return lot_frame(spark, *rows)


@pytest.fixture(scope="module")
def lots(spark):
    return random_lots(spark).cache()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_mart_gives_the_same_as_the_lots(lots):
    daily = mart.daily_mart(lots)
    day = "2026-02-20"
    assert rows_of(mart.mart_weekly_trend(daily, day)) == rows_of(aggregates.weekly_trend(lots, day))
    assert rows_of(mart.mart_weekly_trend(daily, day, species="Goats", market="HOT")) == rows_of(
        aggregates.weekly_trend(lots, day, species="Goats", market="HOT")
    )
    assert rows_of(mart.mart_compare_markets(daily, day, "Goats")) == rows_of(
        aggregates.compare_markets(lots, day, "Goats")
    )
    assert rows_of(mart.mart_top_mover(daily, "2026-02-06", day)) == rows_of(
        aggregates.top_mover(lots, "2026-02-06", day)
    )
    assert rows_of(mart.mart_volume(daily, "2026-02-06", day)) == rows_of(
        aggregates.volume_summary(lots, "2026-02-06", day)
    )
    assert rows_of(mart.mart_facet(daily, "market_state", "code")) == rows_of(aggregates.facet_states(lots))
    assert rows_of(mart.mart_facet(daily, "animal_class", "name")) == rows_of(aggregates.facet_classes(lots))


def test_dashboard_agrees_with_single_reports(lots):
    one = dashboard_summary(lots, "2026-02-06", "2026-02-20").first()
    volume = aggregates.volume_summary(lots, "2026-02-06", "2026-02-20").first()
    assert (one.total_lots, one.total_markets, one.total_states) == tuple(volume)
    mover = aggregates.top_mover(lots, "2026-02-06", "2026-02-20").first()
    assert (one.mover_species, one.mover_class, one.mover_pct) == (
        mover.species, mover.animal_class, mover.change_pct,
    )
    for row in aggregates.species_avg(lots, "2026-02-06", "2026-02-20").collect():
        assert abs(getattr(one, f"{row.species.lower()}_avg") - row.avg_price_per_lb) <= 0.005 + 1e-9


def test_dashboard_of_no_lots(lots):
    empty = dashboard_summary(lots, "2030-01-01", "2030-01-14")
    assert empty.first().total_lots == 0
    assert [r.label for r in dashboard_widgets(empty).collect()] == ["📊 Volume"]


def test_band_sums_by_brute_force(spark):
    rnd = random.Random(3)
    points = [(rnd.choice("ab"), rnd.randint(0, 200), rnd.randint(1, 9)) for _ in range(300)]
    targets = sorted({(rnd.choice("abc"), rnd.randint(-20, 230)) for _ in range(120)})
    got = band_sums(
        spark.createDataFrame(targets, "k string, t long"),
        spark.createDataFrame(points, "k string, p long, v long"),
        ["k"], "t", "p", 15, ["v"],
    )
    want = {}
    for key, target in targets:
        near = [v for k, p, v in points if k == key and abs(p - target) <= 15]
        if near:
            want[(key, target)] = sum(near)
    assert {(r.k, r.t): r.v for r in got.collect()} == want


def test_margin_per_lot_by_brute_force(lots):
    day, got = "2026-02-20", {}
    for row in calc.profitability_at_gain(lots, day, 40).collect():
        got[row.id] = row.current_market_avg_per_lb
    rows = lots.collect()
    start = datetime.date(2026, 1, 21)
    market = [
        r for r in rows
        if not r.is_summary and r.price_per_lb_e4 is not None and r.buyer_intent == "meat"
        and start <= r.report_date <= datetime.date(2026, 2, 20) and r.avg_weight is not None
    ]
    for r in rows:
        target = (r.avg_weight or 60) + 40
        near = [
            m for m in market
            if r.species is not None and m.species == r.species
            and (r.animal_class is None or m.animal_class == r.animal_class)
            and abs(m.avg_weight - target) <= 15
        ]
        num = sum(m.price_per_lb_e4 * (1 if m.head_count is None else m.head_count) for m in near)
        den = sum(1 if m.head_count is None else m.head_count for m in near)
        want = (2 * num + den) // (2 * den) / 10_000 if den else None
        assert got[r.id] == want, r


def test_dense_positions_with_a_hot_unit(spark):
    """One report holds most rows and spans several blocks."""
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 3)).alias("unit"),
        F.hash("id").alias("k"), "id",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = with_ordered_seq(rows.repartition(8), ["unit", "k", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered.select("block").distinct().count() > 1
    numbered = dense_positions(ordered, ["unit"], "block", "seq", "place").toPandas()
    numbered = numbered.sort_values(["unit", "k", "id"])
    assert (numbered.groupby("unit").cumcount() == numbered["place"]).all()


def raw_prices(spark, data):
    return spark.createDataFrame(data, "species string, commodity string, price_unit string, avg_price_e4 long")


def test_box_and_histogram_by_numpy(spark):
    rnd = np.random.default_rng(5)
    hot = [20_000] * 300
    prices = [int(p) for p in rnd.integers(5_000, 60_000, 301)] + hot + [900_000, 100]
    frame = raw_prices(spark, [("Goats", "Slaughter Goats", "Per Cwt", p * 100) for p in prices])
    box = dist.price_box(frame).first()
    dollars = np.array(prices) / 100
    q1, q2, q3 = np.percentile(dollars, [25, 50, 75])
    inside = dollars[(dollars >= q1 - 1.5 * (q3 - q1)) & (dollars <= q3 + 1.5 * (q3 - q1))]
    assert (box.q1, box.median, box.q3) == pytest.approx((q1, q2, q3))
    assert (box.whisker_low, box.whisker_high) == pytest.approx((inside.min(), inside.max()))
    assert box.outliers == len(dollars) - len(inside) and box.n == len(prices)
    assert dist.price_box_outliers(frame).agg(F.sum("count")).first()[0] == box.outliers
    counts = [r["count"] for r in dist.price_histogram(frame).orderBy("bin").collect()]
    assert counts == np.histogram(dollars, bins=40)[0].tolist()


def test_histogram_of_one_price(spark):
    frame = raw_prices(spark, [("Sheep", "c", "Per Cwt", 2_000_000)] * 3 + [("Pigs", "c", "Per Cwt", 1)])
    rows = dist.price_histogram(frame).filter("count > 0").collect()
    assert [(r.species, r.bin, r["count"]) for r in rows] == [("Sheep", 20, 3)]


def test_keep_final(spark):
    lots = lot_frame(
        spark,
        {"final_ind": "Preliminary", "slug_id": 1}, {"final_ind": "Final", "slug_id": 1},
        {"final_ind": "Preliminary", "slug_id": 2}, {"final_ind": None, "slug_id": 1},
        {"final_ind": "Preliminary", "slug_id": 1, "report_date": "2026-02-01"},
    )
    assert [r.id for r in keep_final(lots).orderBy("id").collect()] == ["0001", "0002", "0004"]


def test_empty_conditions_do_not_filter(lots):
    everything = filters.lot_filter(lots, species="", state=None, animal_class="", include_summary=True)
    assert everything.count() == lots.count()


def test_membership_parts_are_not_trimmed(spark):
    lots = lot_frame(spark, {"market_state": "TX"}, {"market_state": "OK"})
    assert filters.lot_filter(lots, state="TX, OK").count() == 1


def test_price_bounds_are_inclusive(spark):
    lots = lot_frame(spark, {"price_per_lb_e4": 20_000}, {"price_per_lb_e4": 20_001}, {"price_per_lb_e4": None})
    assert filters.lot_filter(lots, price_min=2.0, price_max=2.0).count() == 1
    assert filters.lot_filter(lots, price_min=2.00005).count() == 1


def test_drilldown_adds_up_to_the_trend(lots):
    for point in aggregates.weekly_trend(lots, "2026-03-10", period=365).collect():
        assert filters.week_drilldown(lots, point.week_label).count() == point.lot_count


def test_retention_is_to_the_day(spark):
    lots = lot_frame(spark, {"report_date": "2026-01-01"}, {"report_date": "2026-01-02"}, {"report_date": None})
    assert [r.id for r in retention(lots, "2026-04-12").collect()] == ["0001"]


def test_paging_covers_every_lot_once(lots):
    seen = []
    for page in range(1, 10):
        seen += [r.id for r in listing.list_lots(lots, "avg_weight", "asc", page, 50).collect()]
    want = [r.id for r in filters.lot_filter(lots).orderBy(F.asc_nulls_first("avg_weight"), "id").collect()]
    assert seen == want[:450]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_keyset_paging_equals_paging(lots, direction):
    seen, last = [], None
    while True:
        if last is None:
            page = listing.list_lots(lots, "head_count", direction, 1, 100).collect()
        else:
            page = listing.list_lots_after(
                lots, last.head_count, last.id, "head_count", direction, limit=100
            ).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = page[-1]
    assert len(seen) == len(set(seen)) == filters.lot_filter(lots).count()


def test_unknown_sort_means_report_date(lots):
    assert rows_of(listing.list_lots(lots, "narrative")) == rows_of(listing.list_lots(lots))


def test_page_bounds(lots):
    for page, limit in ((0, 50), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            listing.list_lots(lots, page=page, limit=limit)
    assert listing.page_info(lots, species="Pigs").first().total_pages == 1


def test_no_suggestions_when_lots_are_found(spark):
    lots = lot_frame(spark, {"avg_weight": 60}, {"avg_weight": 90})
    assert suggestions(lots, weight_min=55, weight_max=65).count() == 0
    found = suggestions(lots, weight_min=100, weight_max=110).collect()
    assert [tuple(r) for r in found] == [("weight_expanded", None, 80, 130, 1)]
    assert suggestions(lots, species="Pigs").count() == 0


def test_mover_needs_five_lots_on_each_side(spark):
    now, before = "2026-02-10", "2026-01-30"
    four = [{"report_date": now}] * 4 + [{"report_date": before}] * 5
    assert aggregates.top_mover(lot_frame(spark, *four), "2026-02-06", "2026-02-20").count() == 0
    five = four + [{"report_date": now, "price_per_lb_e4": 10_000}]
    row = aggregates.top_mover(lot_frame(spark, *five), "2026-02-06", "2026-02-20").first()
    assert (row.change_pct, row.direction) == (-10.0, "down")
