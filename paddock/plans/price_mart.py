"""Prices by day: how often each price per hundredweight was paid, mergeable by adding counts.

A row holds one price of a day, commodity and species.  Prices are quoted in cents, so a day
has no more rows than different prices, however many lots were sold, and the counts of any
window are sums.  Histograms and exact quantiles are made from them without the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.dates import report_month
from ..operators.distributions import box_of_prices, histogram_of_prices, outliers_of_prices
from ..operators.filters import date_range
from ..session import discard, scratch_path, store
from ..sources.months import drop_months, in_months, read_table, touched_months, write_months

KEYS = ("report_date", "species", "commodity", "avg_price_e4")
PRICES_SCHEMA = "report_date date, species string, commodity string, avg_price_e4 bigint, lots bigint, report_month string"


def price_counts(rows: DataFrame) -> DataFrame:
    """Rows priced per hundredweight, counted by day, species, commodity and price.

    Of any typed rows with these columns: lots, or raw rows with headers and summaries.
    """
    priced = rows.filter((F.col("price_unit") == S.PER_CWT) & F.col("avg_price_e4").isNotNull())
    return (
        priced.groupBy(*KEYS)
        .agg(F.count("*").alias("lots"))
        .withColumn("report_month", report_month(F.col("report_date")))
    )


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts added up; prices that no lot has any more are left out."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*KEYS, "report_month").agg(F.sum("lots").alias("lots")).where("lots <> 0")


def read_prices(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored counts, or nothing if they were never written."""
    return read_table(spark, path, PRICES_SCHEMA)


def change_prices(spark: SparkSession, path: str, came: DataFrame, went: DataFrame | None = None) -> list[str | None]:
    """Add the prices of rows that came to the stored counts and take off those of rows that went.

    ``came`` and ``went`` must not read the table at ``path``.  Only the months touched are
    read and written; a call that is lost before it wrote leaves the table as it was.
    """
    changes = price_counts(came)
    if went is not None:
        changes = merged_counts(changes, price_counts(went).withColumn("lots", -F.col("lots")))
    changes_path, staged_path = scratch_path(spark, "price-changes"), scratch_path(spark, "prices")
    changes = store(changes, "price-changes", changes_path)
    months = touched_months(changes)
    stored = read_prices(spark, path)
    merged = changes if stored is None else merged_counts(changes, in_months(stored, months))
    staged = store(merged, "prices", staged_path)
    write_months(staged, path)
    drop_months(spark, path, set(months) - set(touched_months(staged)))
    discard(spark, changes_path)
    discard(spark, staged_path)
    return months


def _prices(counts: DataFrame, group: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """Counts of a window by group and price."""
    rows = date_range(counts, date_from, date_to) if date_from or date_to else counts
    return rows.filter(F.col(group).isNotNull()).groupBy(group, "avg_price_e4").agg(F.sum("lots").alias("lots"))


def mart_price_box(counts: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``price_box`` of a window, or of all days."""
    return box_of_prices(_prices(counts, "commodity", date_from, date_to))


def mart_price_outliers(counts: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``price_box_outliers`` of a window, or of all days."""
    return outliers_of_prices(_prices(counts, "commodity", date_from, date_to))


def mart_price_histogram(
    counts: DataFrame, date_from: str | None = None, date_to: str | None = None, bins: int = S.HISTOGRAM_BINS
) -> DataFrame:
    """``price_histogram`` of a window, or of all days."""
    rows = counts.filter(F.col("species").isin("Sheep", "Goats"))
    return histogram_of_prices(_prices(rows, "species", date_from, date_to), bins)
