"""Fixed values and schemas shared by the whole package.

Money is held as whole numbers of 1e-4 dollars (columns ending ``_e4``), so that
sums do not depend on row order and every rounding is exact.  Doubles appear only
in the public views (``functions.public``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column spellings met in report files -> canonical name ---
ALIASES = {
    "wtd_Avg_Price": "avg_price",
    "wtd_avg_wt": "avg_weight",
    "published_Date": "published_date",
    "weight_Break_Low": "weight_break_low",
    "weight_Break_High": "weight_break_high",
    "weight_Collect": "weight_collect",
    "muscle_Grade": "muscle_grade",
    "price_min": "avg_price_min",
    "price_max": "avg_price_max",
    "weight_min": "avg_weight_min",
    "weight_max": "avg_weight_max",
    "previous_Report_Date": "previous_report_date",
    "pO_Pct": "po_pct",
    "pO_pct_previous": "po_pct_previous",
}

# --- fixed values: commodity -> buyer intent ---
INTENT_BY_COMMODITY = {
    "Slaughter Goats": "meat",
    "Slaughter Sheep/Lambs": "meat",
    "Feeder Goats": "feeder",
    "Feeder Sheep/Lambs": "feeder",
    "Replacement Goats": "breeding",
    "Replacement Sheep/Lambs": "breeding",
}

# --- fixed values: buyer intent -> label ---
LABEL_BY_INTENT = {"meat": "Slaughter", "feeder": "Feeder", "breeding": "Replacement"}
OTHER_INTENT_LABEL = "Other"

# --- fixed values: class -> breed type ---
HAIR_CLASSES = ("Hair Breeds", "Hair Ewes", "Hair Bucks", "Hair Lambs")
WOOLED_CLASSES = ("Wooled & Shorn", "Wooled", "Shorn")

# --- fixed values: rows that are not lots ---
HEADER_SECTION = "Report Header"
EXCLUDED_CLASSES = ("Hogs", "Sheep")
UNKNOWN_SECTION = "UNKNOWN"
SUMMARY_CATEGORY = "Summary"

# --- fixed values: price units ---
PER_CWT = "Per Cwt"
PER_UNIT = "Per Unit"

# --- fixed values: spellings a CSV reader takes as null ---
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# From here up a number of 1e-4 units is beyond ``bigint``; the lot stays, without them.
UNITS_LIMIT = 9.0e14

# --- fixed values: carcass yield per cent by dressing ---
CARCASS_YIELD_PCT = {"High": 54, "Average": 50, "Low": 46}

# --- fixed values: plausible price per lb, 1e-4 dollars ---
OUTLIER_LOW_E4 = 1_000
OUTLIER_HIGH_E4 = 80_000

# --- fixed values: calculator defaults ---
DEFAULT_TARGET_WEIGHT = 120
DEFAULT_FEED_COST = 0.45
DEFAULT_MORTALITY_PCT = 3.0
DEFAULT_PURCHASE_PRICE = 200
DEFAULT_PURCHASE_WEIGHT = 60
MARKET_BAND_LB = 15

# --- fixed values: windows and list sizes ---
FETCH_DAYS = 100
SUMMARY_DAYS = 14
MARKET_DAYS = 30
SYNC_HOURS = 6
MOVER_MIN_LOTS = 5
COMPARE_MIN_LOTS = 2
TREND_STEP_PCT = 2.0
HISTOGRAM_BINS = 40
WIDEN_LB = 20
DEFAULT_MAX_WEIGHT = 350
SORT_COLUMNS = (
    "price_per_lb", "price_per_head", "avg_weight",
    "head_count", "report_date", "avg_price",
)

# --- fixed values: every column name known to occur in report files ---
KNOWN_RAW_COLUMNS = (
    "% breakdown", "_section", "age", "avg_price", "avg_price_max",
    "avg_price_min", "avg_weight", "avg_weight_max", "avg_weight_min",
    "category", "class", "comments_commodity", "commodity", "current",
    "delivery_month", "dressing", "final_ind", "frame", "freight",
    "geographical_indicator", "geographical_location", "group", "grp",
    "head_count", "lot_desc", "market_location_city", "market_location_name",
    "market_location_state", "market_type", "market_type_category",
    "muscle_Grade", "muscle_grade", "offered", "offered_previous",
    "office_city", "office_code", "office_name", "office_state",
    "offspring_weight_est", "pO_Pct", "pO_pct_previous", "pregnancy",
    "pregnancy_stage", "previous_Report_Date", "price_max", "price_min",
    "price_unit", "published_Date", "published_date", "quality_grade_name",
    "receipts", "receipts_week_ago", "receipts_year_ago", "region_name",
    "report_begin_date", "report_date", "report_end_date", "report_narrative",
    "report_title", "reported", "reported_previous", "slug_id", "slug_name",
    "special_notes", "state_code", "sub_title", "weight_Break_High",
    "weight_Break_Low", "weight_Collect", "weight_break_high",
    "weight_break_low", "weight_collect", "weight_max", "weight_min",
    "wtd_Avg_Price", "wtd_avg_wt", "yield_grade",
)

# --- fixed values: raw columns the lot schema reads, after alias resolution ---
RAW_INPUTS = (
    "_section", "age", "avg_price", "avg_price_max", "avg_price_min",
    "avg_weight", "avg_weight_max", "avg_weight_min", "category", "class",
    "commodity", "dressing", "final_ind", "frame", "head_count", "lot_desc",
    "market_location_city", "market_location_name", "market_location_state",
    "market_type_category", "muscle_grade", "price_unit", "published_date",
    "quality_grade_name", "receipts", "receipts_week_ago", "receipts_year_ago",
    "report_date", "report_narrative", "report_title", "slug_id",
    "weight_break_high", "weight_break_low", "yield_grade",
)

# --- fixed values: text columns of a lot: lot column -> raw column ---
TEXT_COLUMNS = {
    "market_name": "market_location_name",
    "market_city": "market_location_city",
    "market_state": "market_location_state",
    "report_title": "report_title",
    "market_type": "market_type_category",
    "species": "category",
    "commodity": "commodity",
    "animal_class": "class",
    "quality_grade": "quality_grade_name",
    "lot_desc": "lot_desc",
    "dressing": "dressing",
    "age": "age",
    "frame": "frame",
    "muscle_grade": "muscle_grade",
    "yield_grade": "yield_grade",
    "price_unit": "price_unit",
    "narrative": "report_narrative",
    "final_ind": "final_ind",
}

# --- fixed values: whole-number columns of a lot: lot column -> raw column ---
INTEGER_COLUMNS = {
    "slug_id": "slug_id",
    "avg_weight": "avg_weight",
    "weight_min": "avg_weight_min",
    "weight_max": "avg_weight_max",
    "weight_break_low": "weight_break_low",
    "weight_break_high": "weight_break_high",
    "head_count": "head_count",
    "receipts": "receipts",
    "receipts_week_ago": "receipts_week_ago",
    "receipts_year_ago": "receipts_year_ago",
}

# --- fixed values: the 39 public lot columns, in order, and those that are prices ---
LOT_COLUMNS = (
    "id", "report_date", "published_date",
    "market_name", "market_city", "market_state", "slug_id", "report_title",
    "market_type", "is_summary",
    "species", "commodity", "animal_class", "breed_type", "quality_grade",
    "lot_desc", "dressing", "age", "frame", "muscle_grade", "yield_grade",
    "price_unit", "avg_price", "price_min", "price_max",
    "price_per_lb", "price_per_head", "price_per_cwt",
    "avg_weight", "weight_min", "weight_max",
    "weight_break_low", "weight_break_high",
    "head_count", "receipts", "receipts_week_ago", "receipts_year_ago",
    "buyer_intent", "narrative",
)

PRICE_COLUMNS = (
    "avg_price", "price_min", "price_max",
    "price_per_lb", "price_per_head", "price_per_cwt",
)


def _lot_type(name: str) -> T.DataType:
    if name == "report_date":
        return T.DateType()
    if name == "published_date":
        return T.TimestampNTZType()
    if name == "is_summary":
        return T.BooleanType()
    if name in INTEGER_COLUMNS:
        return T.LongType()
    return T.StringType()


# Stored lots: prices in 1e-4 dollars, plus the report's status, the text of dates that
# would not parse, what tells reports apart, and the month the table is partitioned by.
LOTS_SCHEMA = T.StructType(
    [
        T.StructField(f"{name}_e4", T.LongType())
        if name in PRICE_COLUMNS
        else T.StructField(name, _lot_type(name))
        for name in LOT_COLUMNS
    ]
    + [
        T.StructField("final_ind", T.StringType()),
        T.StructField("report_date_raw", T.StringType()),
        T.StructField("published_date_raw", T.StringType()),
        T.StructField("report_key", T.StringType()),
        T.StructField("report_month", T.StringType()),
    ]
)
