"""Worked values: prices, dates, cleaning, calculator, averages."""

import pytest
from helpers import lot_frame, raw_frame, raw_row
from pyspark.sql import functions as F

from paddock.functions import dates, labels, text
from paddock.functions.public import public_lots
from paddock.operators import aggregates, calculator as calc
from paddock.operators.normalise import dropped_rows, normalise, resolve_aliases


def lot(spark, **given):
    rows = public_lots(normalise(raw_frame(spark, raw_row(**given)))).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize(
    "unit, price, weight, expected",
    [
        ("Per Cwt", "264.58", "118", (2.6458, 312.20, 264.58)),
        ("Per Unit", "187", "60", (3.1167, 187.0, 311.67)),
        ("Per Unit", "187", None, (None, 187.0, None)),
        ("Per Unit", "187", "0", (None, 187.0, None)),
        ("Per Cwt", "264.58", None, (2.6458, None, 264.58)),
        ("Per Bag", "264.58", "118", (None, None, None)),
        (" Per Cwt\t", "264.58", "118.5", (2.6458, 313.53, 264.58)),
    ],
)
def test_derived_prices(spark, unit, price, weight, expected):
    row = lot(spark, price_unit=unit, avg_price=price, avg_weight=weight)
    assert (row.price_per_lb, row.price_per_head, row.price_per_cwt) == expected


def test_whole_lot(spark):
    row = lot(spark)
    assert row.report_date == "2026-02-09" and row.published_date == "2026-02-09T18:47:05"
    assert (row.breed_type, row.buyer_intent, row.is_summary) == ("Wooled", "meat", False)
    assert (row.avg_price, row.price_min, row.price_max) == (264.58, 255.0, 275.0)
    assert (row.slug_id, row.head_count, row.weight_min) == (1772, 4, None)


@pytest.mark.parametrize(
    "given",
    [
        {"class": "Hogs"}, {"class": " Sheep "}, {"_section": "Report Header"},
        {"avg_price": "N/A"}, {"avg_price": "1.5d"}, {"avg_price": "inf"}, {"avg_price": "1e400"},
    ],
)
def test_rows_that_are_no_lots(spark, given):
    assert lot(spark, **given) is None
    assert dropped_rows(raw_frame(spark, raw_row(**given))).count() == 1


def test_summary_by_category_or_report(spark):
    assert lot(spark, market_type_category="Summary ").is_summary is True
    assert lot(spark, market_type_category="absent").is_summary is False
    rows = normalise(raw_frame(spark, raw_row(slug_id="2907", market_type_category="absent")), [2907])
    assert rows.first().is_summary is True


@pytest.mark.parametrize(
    "raw, number, whole",
    [
        ("4", 4.0, 4), (" 4.9 ", 4.9, 4), ("-3.7", -3.7, -3), ("1e2", 100.0, 100), (".5", 0.5, 0),
        ("5.", 5.0, 5), ("abc", None, None), ("1.5d", None, None), ("1,5", None, None),
        ("", None, None), ("inf", None, None), ("0x1A", None, None), (None, None, None),
        ("1e30", 1e30, None),
    ],
)
def test_numbers(spark, raw, number, whole):
    frame = spark.createDataFrame([(raw,)], "x string")
    got = frame.selectExpr(text.coerce_numeric("x"), text.to_int_trunc(text.coerce_numeric("x"))).first()
    assert tuple(got) == (number, whole)


@pytest.mark.parametrize(
    "raw, clean",
    [("  a b\t\n", "a b"), (" x　", "x"), (" \t ", None), ("", None), (None, None), ("N/A", "N/A")],
)
def test_clean_string(spark, raw, clean):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.selectExpr(text.clean_string("x")).first()[0] == clean


def test_null_tokens(spark):
    frame = spark.createDataFrame([("NA",), ("#N/A",), ("nan",), ("",), (None,), ("na",), (" NA",)], "x string")
    got = [row[0] for row in frame.selectExpr(text.null_tokens("x")).collect()]
    assert got == [None] * 5 + ["na", " NA"]


@pytest.mark.parametrize(
    "raw, stamp",
    [
        ("02/09/2026 18:47:05", "2026-02-09T18:47:05"), ("2/9/2026", "2026-02-09T00:00:00"),
        ("2026-2-9", "2026-02-09T00:00:00"), ("02/30/2026", None), ("2026", None),
        ("2026-02-09T10:00:00", None), ("13/01/2026", None), ("02/09/2026 25:00:00", None),
        ("soon", None), (None, None),
    ],
)
def test_dates(spark, raw, stamp):
    frame = spark.createDataFrame([(raw,)], "x string").withColumn("t", F.expr(dates.parse_stamp("x")))
    assert frame.select(dates.iso_stamp(F.col("t"))).first()[0] == stamp


def test_unparsed_date_is_kept_as_text(spark):
    row = normalise(raw_frame(spark, raw_row(report_date="next week"))).first()
    assert row.report_date is None and row.report_date_raw == "next week"


@pytest.mark.parametrize(
    "day, week",
    [("2026-01-01", "2026-W00"), ("2026-01-05", "2026-W01"), ("2026-12-31", "2026-W52"),
     ("2024-01-01", "2024-W01"), ("2023-01-01", "2023-W00"), ("2000-02-29", "2000-W09")],
)
def test_week_label(spark, day, week):
    frame = spark.sql(f"select date '{day}' as d")
    assert frame.select(dates.week_label(F.col("d"))).first()[0] == week


def test_week_label_over_eleven_years(spark):
    days = spark.sql("select explode(sequence(date '2015-01-01', date '2025-12-31')) as d")
    for row in days.select("d", dates.week_label(F.col("d")).alias("w")).collect():
        assert row.w == row.d.strftime("%Y-W%W")


def test_receipts_change(spark):
    frame = spark.createDataFrame([(343, 1301), (343, 0), (0, 5), (None, 5), (5, None), (9, 8)], "a int, b int")
    got = [r[0] for r in frame.select(labels.receipts_change_pct(F.col("a"), F.col("b"))).collect()]
    assert got == [-74, None, None, None, None, 13]


def test_labels(spark):
    frame = spark.createDataFrame([("Slaughter Goats",), ("Stocker Goats",), (None,)], "c string")
    rows = frame.select(
        labels.intent_label(labels.buyer_intent(F.col("c"))), labels.commodity_series(F.col("c")),
        labels.commodity_short(F.col("c")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("Slaughter", "Slaughter", "Slaughter G"), ("Other", None, "Stocker G"), ("Other", None, None),
    ]


def test_head_weights(spark):
    """Unknown head count weighs one, none weighs nothing."""
    lots = lot_frame(
        spark,
        {"price_per_lb_e4": 20_000, "head_count": None},
        {"price_per_lb_e4": 40_000, "head_count": 3},
        {"price_per_lb_e4": 90_000, "head_count": 0},
    )
    row = aggregates.compare_markets(lots, "2026-02-10", "Goats").first()
    assert (row.avg_price_per_lb, row.lot_count, row.head_count) == (3.5, 3, 3)


def test_only_weightless_lots_have_no_average(spark):
    lots = lot_frame(spark, {"head_count": 0}, {"head_count": 0})
    assert aggregates.compare_markets(lots, "2026-02-10", "Goats").first().avg_price_per_lb is None


def test_break_even_and_margin(spark):
    """187 dollars at 60 lb, grown to 80 lb; the market pays 2.80."""
    lots = lot_frame(
        spark,
        {"price_per_head_e4": 1_870_000, "avg_weight": 60, "price_per_lb_e4": 31_167},
        {"price_per_lb_e4": 28_000, "avg_weight": 80},
        {"price_per_lb_e4": 28_000, "avg_weight": 95},
    )
    row = calc.profitability(lots, "2026-02-10", 80).filter("id = '0000'").first()
    assert (row.weight_gain, row.feed_cost_total, row.shrink_loss) == (20.0, 9.0, 5.61)
    assert (row.total_investment, row.break_even_per_lb, row.break_even_per_cwt) == (201.61, 2.5201, 252.01)
    assert (row.current_market_avg_per_lb, row.margin_per_head, row.margin_pct) == (2.8, 22.39, 11.11)


def test_break_even_without_target(spark):
    rows = calc.with_break_even(calc.profit_defaults(lot_frame(spark, {})), 0)
    row = rows.select(*calc.break_even_columns()).first()
    assert row.break_even_per_lb == 0 and row.break_even_per_cwt == 0


def test_defaults(spark):
    lots = lot_frame(spark, {"price_per_head_e4": 0, "avg_weight": None})
    row = calc.profit_defaults(lots).first()
    assert (row.purchase_price_e4, row.purchase_weight_e2) == (2_000_000, 6_000)


def test_carcass(spark):
    lots = lot_frame(spark, {"dressing": "Average", "avg_weight": 80, "price_per_head_e4": 2_000_000}, {"dressing": None})
    rows = calc.carcass_value(lots).orderBy("id").collect()
    assert (rows[0].carcass_weight, rows[0].price_per_lb_carcass) == (40.0, 5.0)
    assert rows[1].price_per_lb_carcass is None


def test_class_missing_falls_back_to_species(spark):
    lots = lot_frame(
        spark,
        {"avg_weight": 120, "price_per_lb_e4": 30_000}, {"avg_weight": 120, "animal_class": "Wethers", "price_per_lb_e4": 10_000},
        {"animal_class": None, "avg_weight": 10, "price_per_lb_e4": None},
    )
    got = {r.id: r.current_market_avg_per_lb for r in calc.profitability(lots, "2026-02-10").collect()}
    assert got == {"0000": 3.0, "0001": 1.0, "0002": 2.0}


def test_aliases_and_case_variants(spark):
    frame = spark.createDataFrame(
        [("1", None, "7", "8")], "avg_price string, wtd_avg_wt string, price_min string, avg_price_min string"
    )
    row = resolve_aliases(frame).first().asDict()
    assert row == {"avg_price": "1", "avg_weight": None, "avg_price_min": "8"}
    clash = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string").toDF(
        "weight_Break_Low", "weight_break_low"
    )
    assert [r.weight_break_low for r in resolve_aliases(clash).collect()] == ["a", "b"]
