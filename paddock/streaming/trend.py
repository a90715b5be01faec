"""Weekly trend kept by a stream: sums of each week, which late reports reopen until a watermark passes.

The state holds one row of sums for each week and cell (species and commodity, say), so it is
bounded by the weeks that are still open.  Every batch writes the cells it changed with all
their sums; readers take each cell's last version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions.dates import iso_date, week_label
from ..functions.exact import dollars, ratio
from ..functions.measures import head_sum, weight_sum, weighted_sum
from ..operators.filters import days_before, equal, priced_per_lb
from ..session import discard, scratch_path, store
from ..sources.months import read_table

CELL = ("species", "commodity", "animal_class", "market_name")
SUMS = ("lb_num", "lb_den", "lots", "heads")


def _schema(cell: Sequence[str]) -> str:
    kinds = {field.name: field.dataType.simpleString() for field in S.LOTS_SCHEMA.fields}
    names = [f"{name} {kinds[name]}" for name in cell]
    sums = [f"{name} bigint" for name in (*SUMS, "lb_min", "lb_max")]
    return ", ".join(["report_date date", *names, *sums, "batch bigint"])


def open_weeks(lots: DataFrame, delay: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Sums of each day of a week and cell over a stream of lots, open until ``delay`` after the newest day seen.

    Days and not weeks are kept apart, since report windows are exact to the day; a week's
    days close together, with the week's end.  Lots without a date or a price per pound are
    in no week.
    """
    rows = priced_per_lb(lots).filter(F.col("report_date").isNotNull())
    # Weeks begin on Monday; the epoch was a Thursday.
    week = F.window("event_time", "7 days", "7 days", "4 days")
    return (
        rows.withColumn("event_time", F.col("report_date").cast("timestamp"))
        .withWatermark("event_time", delay)
        .groupBy(week.alias("week"), "report_date", *cell)
        .agg(
            weighted_sum("price_per_lb_e4").alias("lb_num"),
            weight_sum("price_per_lb_e4").alias("lb_den"),
            F.count("*").alias("lots"),
            head_sum().alias("heads"),
            F.min("price_per_lb_e4").alias("lb_min"),
            F.max("price_per_lb_e4").alias("lb_max"),
        )
        .drop("week")
    )


def stream_weekly_trend(
    spark: SparkSession,
    lots_path: str,
    trend_path: str,
    checkpoint_path: str,
    delay: str = "28 days",
    cell: Sequence[str] = CELL,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Start a run over the lot files not seen yet below ``lots_path``; it ends when they are all in.

    ``lots_path`` is a folder to which normalised lots are added as Parquet.  A lot whose week
    ended more than ``delay`` before the newest day of earlier batches comes too late and
    does not count; the query's progress tells how many did.  A batch that is run again
    writes the same folder again.
    """
    lots = (
        spark.readStream.schema(S.LOTS_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", "36500d")
        .parquet(lots_path)
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{trend_path}/batch={batch_id}")

    return (
        open_weeks(lots, delay, cell)
        .writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def read_trend(spark: SparkSession, trend_path: str, cell: Sequence[str] = CELL) -> DataFrame | None:
    """Each cell's last version; nothing if no batch was written."""
    versions = read_table(spark, trend_path, _schema(cell))
    if versions is None:
        return None
    keys = ["report_date", *cell]
    newest = F.max_by(F.struct(*SUMS, "lb_min", "lb_max"), "batch").alias("it")
    return versions.groupBy(*keys).agg(newest).select(*keys, "it.*")


def compact_trend(spark: SparkSession, trend_path: str, cell: Sequence[str] = CELL) -> None:
    """Put every cell's last version in the folder of the last batch and drop the others."""
    versions = read_table(spark, trend_path, _schema(cell))
    numbers = sorted(row[0] for row in versions.select("batch").distinct().collect()) if versions is not None else []
    if len(numbers) < 2:
        return
    staged_path = scratch_path(spark, "trend")
    staged = store(read_trend(spark, trend_path, cell), "trend", staged_path)
    staged.write.mode("overwrite").parquet(f"{trend_path}/batch={numbers[-1]}")
    for number in numbers[:-1]:
        discard(spark, f"{trend_path}/batch={number}")
    discard(spark, staged_path)


def streamed_trend(
    trend: DataFrame,
    as_of: str,
    species: str | None = None,
    commodity: str | None = None,
    animal_class: str | None = None,
    period: int = 90,
    market: str | None = None,
) -> DataFrame:
    """``weekly_trend`` without weight bounds, from the stream's table."""
    rows = equal(trend, species=species, commodity=commodity, animal_class=animal_class, market_name=market)
    first, last = (F.lit(day).cast("date") for day in (days_before(as_of, period), as_of))
    return (
        rows.filter(F.col("report_date").between(first, last))
        .groupBy(week_label(F.col("report_date")).alias("week_label"))
        .agg(
            iso_date(F.min("report_date")).alias("week_start"),
            dollars(ratio(F.try_sum("lb_num"), F.try_sum("lb_den"))).alias("avg_price_per_lb"),
            dollars(F.min("lb_min")).alias("price_min"),
            dollars(F.max("lb_max")).alias("price_max"),
            F.try_sum("lots").alias("lot_count"),
            F.try_sum("heads").alias("head_count"),
        )
        .orderBy("week_label")
    )
