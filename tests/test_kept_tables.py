"""Price counts, market sketches, the streamed trend, profile states and many-target nearest lots."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import lot_frame

from paddock import schema as S
from paddock.api import LotReports
from paddock.operators import aggregates, distributions, listing
from paddock.plans import market_sketches, mart, price_mart
from paddock.sources import profile, reports, tables
from paddock.sources.profile import profile_of, schema_profile, stored_state, update_profile
from paddock.streaming.trend import compact_trend, read_trend, stream_weekly_trend, streamed_trend


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


# --- nearest lots for many targets ---

@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 50)])
def test_nearest_lots_many_against_brute_force(spark, seed, k):
    draw = random.Random(seed)
    lots = [
        {"avg_weight": draw.choice([None, 10, 11, 400, 5000, draw.randrange(30, 90)]), "species": draw.choice(["Goats", "Sheep", None])}
        for _ in range(80)
    ]
    wanted = [(i, draw.choice(["Goats", "Sheep", "Llamas", None]), draw.choice([None, 0.5, 62.0, -900.0, 9e4, 35.0])) for i in range(30)]
    frame = lot_frame(spark, *lots)
    targets = spark.createDataFrame(wanted, "name long, species string, target_weight double")
    got = listing.nearest_lots_many(frame, targets, k, columns=["market_name"])
    assert got.columns == ["name", "species", "target_weight", "place", "id", "avg_weight", "distance", "market_name"]
    want = []
    for name, species, target in wanted:
        if species is None or target is None:
            continue
        near = sorted(
            (abs(lot["avg_weight"] - target), f"{i:04d}", lot["avg_weight"])
            for i, lot in enumerate(lots) if lot["species"] == species and lot["avg_weight"] is not None
        )[:k]
        want += [(name, place, key, weight, float(d)) for place, (d, key, weight) in enumerate(near, 1)]
    assert sorted((r.name, r.place, r.id, r.avg_weight, r.distance) for r in got.collect()) == sorted(want)


def test_nearest_lots_many_without_rows(spark):
    targets = spark.createDataFrame([], "species string, target_weight long")
    some = lot_frame(spark, {"avg_weight": 5})
    assert listing.nearest_lots_many(some, targets).count() == 0
    one = spark.createDataFrame([("Goats", 5)], "species string, target_weight long")
    assert listing.nearest_lots_many(some.limit(0), one).count() == 0
    text = plan(listing.nearest_lots_many(some, one))
    assert "NestedLoop" not in text and "Cartesian" not in text


# --- pages ---

@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "lots")
    lots = [{"report_date": f"2026-{1 + i % 6:02d}-05", "price_per_lb_e4": i % 7 or None, "avg_weight": i} for i in range(60)]
    tables.write_lots(lot_frame(spark, *lots), path)
    return tables.read_lots(spark, path)


def test_a_page_sorts_three_columns_and_prunes_the_rest(stored):
    page = listing.list_lots(stored, sort_by="price_per_lb", page=2, limit=5)
    text = plan(page)
    sorts = [line for line in text.splitlines() if "TakeOrderedAndProject" in line]
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text and "NestedLoop" not in text
    inner = sorts[-1].split("output=[")[1].split("]")[0].split(", ")
    assert len(inner) <= 3 and "narrative" not in sorts[-1]
    assert "dynamicpruning" in text
    want = sorted(stored.collect(), key=lambda r: (-(r.price_per_lb_e4 or -1), r.id))[5:10]
    assert [r.id for r in page.collect()] == [r.id for r in want]


def test_pages_cover_all_lots_once(stored):
    ids = [r.id for page in range(1, 8) for r in listing.list_lots(stored, "head_count", "asc", page, 10).collect()]
    assert ids == sorted(r.id for r in stored.collect())


# --- prices by day ---

def test_prices_of_any_window_merge(spark, tmp_path):
    draw = random.Random(4)
    lots = [
        {"report_date": draw.choice(["2026-01-31", "2026-02-01", "2026-02-09", None]), "avg_price_e4": draw.choice([None, 100, 200, 70_000, 10**6]),
         "commodity": draw.choice(["Feeder Goats", "Slaughter Sheep/Lambs", None]), "price_unit": draw.choice(["Per Cwt", "Per Cwt", "Per Unit"]),
         "species": draw.choice(["Goats", "Sheep", None])}
        for _ in range(150)
    ]
    path = str(tmp_path / "prices")
    assert price_mart.read_prices(spark, path) is None
    for some in (lots[:50], lots[50:100]):
        price_mart.change_prices(spark, path, lot_frame(spark, *some))
    months = price_mart.change_prices(spark, path, lot_frame(spark, *lots[100:]), lot_frame(spark, *lots[:50]))
    assert set(months) == {"2026-01", "2026-02", None}
    left, counts = lot_frame(spark, *lots[50:]), price_mart.read_prices(spark, path)
    assert rows_of(price_mart.mart_price_box(counts)) == rows_of(distributions.price_box(left))
    assert rows_of(price_mart.mart_price_outliers(counts)) == rows_of(distributions.price_box_outliers(left))
    assert rows_of(price_mart.mart_price_histogram(counts)) == rows_of(distributions.price_histogram(left))
    window = left.where("report_date between date '2026-02-01' and date '2026-02-09'")
    assert rows_of(price_mart.mart_price_box(counts, "2026-02-01", "2026-02-09")) == rows_of(distributions.price_box(window))
    text = plan(price_mart.mart_price_box(counts, "2026-02-01", "2026-02-09"))
    assert "2026-02" in text.split("PartitionFilters: [")[1].split("]")[0]
    price_mart.change_prices(spark, path, left.limit(0), left)
    assert price_mart.read_prices(spark, path).count() == 0


# --- sketches ---

def test_sketches_lie_within_the_stated_error(spark):
    rows = spark.range(40_000).selectExpr(
        "cast(concat('market ', id % 9000) as string) as market_name", "concat('state ', id % 70) as market_state",
        "date_add(date '2026-01-01', cast(id % 50 as int)) as report_date", "false as is_summary",
    )
    days = market_sketches.daily_markets(rows)
    assert days.count() == 50
    for first, last in ((None, None), ("2026-01-03", "2026-01-20")):
        about = market_sketches.sketched_volume(days, first, last).first()
        exact = market_sketches.exact_volume(market_sketches.daily_market_names(rows), first, last).first()
        assert about.lots == exact.lots and 0 < about.relative_error < 0.05
        assert abs(about.markets - exact.markets) <= about.relative_error * exact.markets
        assert abs(about.states - exact.states) <= max(1, about.relative_error * exact.states)
    none = market_sketches.sketched_volume(days, "2030-01-01", "2030-01-02").first()
    assert (none.lots, none.markets, none.states) == (0, 0, 0)


# --- the trend as a stream ---

def test_late_lots_reopen_a_week_until_the_watermark(spark, tmp_path):
    drops, trend, progress = (str(tmp_path / name) for name in ("drops", "trend", "progress"))

    def run(*lots):
        lot_frame(spark, *lots).write.mode("append").parquet(drops)
        stream_weekly_trend(spark, drops, trend, progress, "10 days").awaitTermination()
        return {r.week_label: r.lot_count for r in streamed_trend(read_trend(spark, trend), "2026-03-31").collect()}

    first = [{"report_date": day, "head_count": i} for i, day in enumerate(("2026-01-06", "2026-01-08", "2026-02-02"))]
    assert run(*first) == {"2026-W01": 2, "2026-W05": 1}
    late = [{"report_date": "2026-01-29", "price_per_lb_e4": 5}, {"report_date": "2026-02-02"}, {"report_date": None}]
    assert run(*late) == {"2026-W01": 2, "2026-W04": 1, "2026-W05": 2}
    # Its week ended before the watermark: too late.
    assert run({"report_date": "2026-01-07"}, {"report_date": "2026-02-20"})["2026-W01"] == 2
    kept = lot_frame(spark, *first, *late, {"report_date": "2026-02-20"})
    want = rows_of(aggregates.weekly_trend(kept, "2026-03-31"))
    assert rows_of(streamed_trend(read_trend(spark, trend), "2026-03-31")) == want
    compact_trend(spark, trend)
    assert rows_of(streamed_trend(read_trend(spark, trend), "2026-03-31")) == want
    assert run({"report_date": "2026-02-19", "species": "Sheep"})["2026-W07"] == 2
    assert streamed_trend(read_trend(spark, trend), "2026-03-31", species="Sheep").first().lot_count == 1


# --- profile ---

def test_profile_states_add_up(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("slug_id,class,avg_price\n7,Kids,1\n7,N/A,2\n7,Does,\n7,Kids,4\n7,Bucks,05\n")
    (tmp_path / "a" / "2.csv").write_text('slug_id,class,wtd_Avg_Price\n8,"Aged\nDoes",x\n8, ,1\n')
    path, folder = str(tmp_path / "profile"), str(tmp_path / "a")
    assert stored_state(spark, path) is None
    for name in ("1.csv", "2.csv", "1.csv"):
        update_profile(spark, path, reports.scan_by_header(spark, f"{folder}/{name}"))
    whole = schema_profile(reports.scan_by_header(spark, folder))
    assert rows_of(profile_of(stored_state(spark, path))) == rows_of(whole)
    found = {r.column_name: r for r in whole.collect()}
    assert found["class"].sample_values == "  | Aged\nDoes | Bucks" and found["class"].files == 2
    assert (found["avg_price"].dtype, found["avg_price"].sample_values) == ("float64", "05 | 1 | 2")
    assert (found["wtd_Avg_Price"].dtype, found["slug_id"].slug_ids) == ("object", "7, 8")
    assert "SortAggregate" not in plan(whole)


# --- the facade on the mart ---

def test_reports_from_the_mart_equal_those_from_lots(spark):
    draw = random.Random(9)
    lots = lot_frame(
        spark,
        *[
            {"report_date": draw.choice(["2026-01-20", "2026-01-30", "2026-02-03", "2026-02-14", None]), "price_per_lb_e4": draw.choice([None, 100, 350, 900]),
             "species": draw.choice(["Goats", "Sheep", None]), "animal_class": draw.choice(["Kids", "Ewes", None]), "market_name": draw.choice(["A", "B", None]),
             "market_state": draw.choice(["TX", None]), "head_count": draw.choice([None, 0, 7]), "is_summary": draw.random() < 0.2,
             "buyer_intent": draw.choice(["meat", "feeder"])}
            for _ in range(300)
        ],
    )
    plain = LotReports(lots, "2026-02-15")
    fast = LotReports(lots, "2026-02-15", mart.daily_mart(lots), price_mart.price_counts(lots))
    for ask in (
        lambda r: r.summary(), lambda r: r.widgets(), lambda r: r.mover(), lambda r: r.volume(), lambda r: r.states(), lambda r: r.markets(),
        lambda r: r.classes(), lambda r: r.classes("Goats"), lambda r: r.classes("Sheep", "meat"), lambda r: r.trends(),
        lambda r: r.compare("Goats"), lambda r: r.price_box(), lambda r: r.price_box("2026-02-01", "2026-02-14"),
    ):
        assert rows_of(ask(fast)) == rows_of(ask(plain))
    assert fast.nearest_if_none(species="Goats", weight_min=900).count() == 5
    assert fast.nearest_if_none(species="Goats", weight_min=50).count() == 0  # there are such lots
    assert fast.nearest_if_none(species="Llamas").count() == 0  # without a weight nothing is near


def test_profile_of_many_files(spark):
    """Rows of 3,000 files in any order; a batch's column is read once for all of its files."""
    draw = random.Random(4)
    rows = [(str(draw.randrange(3000)), draw.choice(["N/A", "", None, "é", "z", " 7 ", "+1.5e3\n", "12", "x1"])) for _ in range(9000)]
    runs, least = profile._batch_least(pa.array([v for _, v in rows], pa.string()), np.arange(9000), 3)
    held = [i for i, (_, v) in enumerate(rows) if v is not None and v not in S.NULL_TOKENS]
    assert runs.tolist() == held and least.to_pylist() == [rows[i][1] for i in held]
    rows += [("hot", str(i)) for i in range(25_000)] + [("none", None)]
    frame = spark.createDataFrame(rows, "source_file string, class string")
    got = {r.file: r for r in profile.profile_state([frame.repartition(3)], slug="class").collect()}
    by_file = {}
    for file, value in rows:
        by_file.setdefault(file, []).append(value)
    assert set(got) == set(by_file)
    for file, values in by_file.items():
        seen = [v for v in values if v is not None and v not in S.NULL_TOKENS]
        whole = sum(v.strip().isdigit() for v in seen)
        row = got[file]
        counts = (len(values), len(seen), whole + seen.count("+1.5e3\n"), whole)
        assert (row.rows, row.filled, row.numeric, row.whole) == counts
        assert (row.least or []) == sorted(set(seen), key=str.encode)[:3]


def test_nearest_lots_are_found_before_whole_lots_are_read(spark):
    rows = [{"avg_weight": weight, "species": "Goats" if i % 3 else "Sheep"} for i, weight in enumerate((60, 64, 56, 64, None, 61, 99))]
    frame = lot_frame(spark, *rows, {"id": None, "avg_weight": 59, "species": "Goats"})
    for k in (1, 3, 5, 300):
        got = [row.avg_weight for row in listing.nearest_lots(frame, 60, k, species="Goats").collect()]
        # Equally close lots go by id, a null id first.
        assert got == [59, 61, 64, 56][:k]
    assert "0005" in plan(listing.nearest_lots(frame.where("id is not null"), 61, 1, species="Goats"))
