"""Distribution report over raw report rows: counts, shares, histogram, box plot.

The distributions first count rows by distinct price, so everything after that one
shuffle works on price lists, which grow with the spread of prices and not with the
number of lots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.dates import iso_date
from ..functions.exact import dollars, int_div
from ..functions.labels import commodity_short
from .aggregates import with_share


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value, most frequent first, nulls left out."""
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def value_share(rows: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with shares to a tenth of a per cent."""
    return with_share(value_counts(rows, column))


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(rows, column).limit(k)


def report_counts(rows: DataFrame) -> DataFrame:
    """Rows per report, fewest first."""
    counts = rows.groupBy("slug_id").agg(F.count("*").alias("count"))
    return counts.orderBy("count", "slug_id")


def cwt_prices(rows: DataFrame, group: str) -> DataFrame:
    """Rows by group and price among those priced per hundredweight."""
    priced = rows.filter((F.col("price_unit") == S.PER_CWT) & F.col("avg_price_e4").isNotNull())
    return (
        priced.filter(F.col(group).isNotNull())
        .groupBy(group, "avg_price_e4")
        .agg(F.count("*").alias("lots"))
    )


def price_histogram(rows: DataFrame, bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """Equal bins over each species' own price range, the last one closed above.

    A species with a single price gets a range of one dollar around it.
    """
    return histogram_of_prices(cwt_prices(rows.filter(F.col("species").isin("Sheep", "Goats")), "species"), bins)


def histogram_of_prices(prices: DataFrame, bins: int = S.HISTOGRAM_BINS) -> DataFrame:
    """``price_histogram`` of prices counted by species."""
    # The count is only there to ask for the same columns as below, so that the
    # counted prices are computed once and both readers share them.
    edges = (
        prices.groupBy("species")
        .agg(
            F.min("avg_price_e4").alias("low"),
            F.max("avg_price_e4").alias("high"),
            F.sum("lots").alias("n"),
        )
        .filter("n > 0")
    )
    half_dollar = F.when(F.col("low") == F.col("high"), 5_000).otherwise(0)
    edges = edges.select(
        "species",
        (F.col("low") - half_dollar).alias("low"),
        (F.col("high") + half_dollar).alias("high"),
    )
    # At most two rows, by the species filter above.
    edges = F.broadcast(edges)
    place = int_div((F.col("avg_price_e4") - F.col("low")) * bins, F.col("high") - F.col("low"))
    counted = (
        prices.join(edges, "species")
        .groupBy("species", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("lots").alias("count"))
    )
    frame = edges.select(
        "species", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    width = F.col("high") - F.col("low")

    def edge(step: Column) -> Column:
        return (F.col("low") * bins + width * step) / float(bins * 10_000)

    return frame.join(counted, ["species", "bin"], "left").select(
        "species",
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _fences(prices: DataFrame) -> DataFrame:
    """Quartiles and the 1.5 IQR fences of each commodity, in 1e-4 dollars, exact.

    The state is a commodity's distinct prices with their counts.  Prices are quoted
    in cents, so there are some hundred thousand of them however many lots there are.
    """
    quartiles = F.percentile("avg_price_e4", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("lots"))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return (
        prices.groupBy("commodity")
        .agg(quartiles.alias("q"), F.sum("lots").alias("n"))
        .select(
            "commodity",
            "n",
            q1.alias("q1"),
            F.col("q")[1].alias("median"),
            q3.alias("q3"),
            (q1 - (q3 - q1) * 1.5).alias("low_fence"),
            (q3 + (q3 - q1) * 1.5).alias("high_fence"),
        )
    )


def price_box(rows: DataFrame) -> DataFrame:
    """Box plot figures of each commodity: quartiles, whiskers and count of outliers."""
    return box_of_prices(cwt_prices(rows, "commodity"))


def box_of_prices(prices: DataFrame) -> DataFrame:
    """``price_box`` of prices counted by commodity."""
    within = F.col("avg_price_e4").between(F.col("low_fence"), F.col("high_fence"))
    kept = F.when(within, F.col("avg_price_e4"))
    low = F.least(F.min(kept), F.col("q1"))
    high = F.greatest(F.max(kept), F.col("q3"))
    return (
        prices.join(_fences(prices), "commodity")
        .groupBy("commodity", "n", "q1", "median", "q3")
        .agg(
            low.alias("low"),
            high.alias("high"),
            F.coalesce(F.sum(F.when(~within, F.col("lots"))), F.lit(0)).alias("outliers"),
        )
        .select(
            "commodity",
            commodity_short(F.col("commodity")).alias("label"),
            "n",
            *[dollars(F.col(name)).alias(name) for name in ("q1", "median", "q3")],
            dollars(F.col("low")).alias("whisker_low"),
            dollars(F.col("high")).alias("whisker_high"),
            "outliers",
        )
    )


def price_box_outliers(rows: DataFrame) -> DataFrame:
    """The prices drawn as single points, with their counts."""
    return outliers_of_prices(cwt_prices(rows, "commodity"))


def outliers_of_prices(prices: DataFrame) -> DataFrame:
    """``price_box_outliers`` of prices counted by commodity."""
    outside = ~F.col("avg_price_e4").between(F.col("low_fence"), F.col("high_fence"))
    return (
        prices.join(_fences(prices), "commodity")
        .filter(outside)
        .select("commodity", dollars(F.col("avg_price_e4")).alias("price"), F.col("lots").alias("count"))
    )


def dataset_summary(rows: DataFrame, files: str = "source_file") -> DataFrame:
    """Rows, files, first and last report date, states and markets.

    Rows are counted by file, state and market first, so that the distinct counts
    run over that list.
    """
    cells = rows.groupBy(files, "market_state", "market_name").agg(
        F.count("*").alias("rows"),
        F.min("report_date").alias("first"),
        F.max("report_date").alias("last"),
    )
    return cells.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.countDistinct(files).alias("files"),
        iso_date(F.min("first")).alias("first_date"),
        iso_date(F.max("last")).alias("last_date"),
        F.countDistinct("market_state").alias("states"),
        F.countDistinct("market_name").alias("markets"),
    )
