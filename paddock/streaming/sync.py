"""Incremental sync: new report files into the lot table and the daily mart."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions.dates import iso_date, iso_stamp
from ..operators.normalise import keep_final, normalise
from ..plans.mart import MART_SCHEMA, mart_state, read_mart, write_mart
from ..plans.mart_changes import changed_mart, changed_rows, lot_changes
from ..session import discard, is_complete, scratch_path, store, store_once
from ..sources.ledger import LEDGER_SCHEMA, ledger_path
from ..sources.months import drop_months, first_kept_day, in_months, touched_months, trim_days, write_months
from ..sources.reports import REPORT_FILES, alias_guard, report_files, store_rows
from ..sources.tables import put_fetches, read_lots, upsert_lots, write_lots

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


class MartStep:
    """One batch's change of the mart, in tables that are kept until it is done.

    What the lots change in the mart is written down before the lots are replaced, and the
    mart's new months before they replace the old ones.  A batch that is run again after a
    loss finds what was written and goes on from there, so that no change counts twice.
    """

    def __init__(self, spark: SparkSession, mart_path: str, folder: str):
        self.spark, self.mart_path = spark, mart_path
        self.changes, self.rows, self.months = (f"{folder}/{name}" for name in ("changes", "rows", "months"))

    def note_changes(self, came: DataFrame, went: DataFrame | None) -> None:
        if read_mart(self.spark, self.mart_path) is not None or is_complete(self.spark, self.changes):
            store_once(self.spark, self.changes, lambda: lot_changes(came, went))

    def apply(self, lots: DataFrame) -> None:
        """Bring the mart in step with ``lots``, the table after the batch."""
        if not is_complete(self.spark, self.months):
            if is_complete(self.spark, self.changes):
                changes = self.spark.read.parquet(self.changes)
                mart = read_mart(self.spark, self.mart_path)
                rows = store(changed_rows(mart, changes), "rows", self.rows)
                new = changed_mart(rows, lots)
                months = touched_months(changes)
            else:
                new, months = mart_state(lots), []
            # Months that are to be empty are named in a table, since a folder cannot tell.
            named = self.spark.createDataFrame([(month,) for month in months], "report_month string")
            store(named, "touched", f"{self.months}-touched")
            store(new, "months", self.months)
        new = self.spark.read.parquet(self.months)
        months = touched_months(self.spark.read.schema("report_month string").parquet(f"{self.months}-touched"))
        if not new.isEmpty():
            write_months(new, self.mart_path)
        drop_months(self.spark, self.mart_path, set(months) - set(touched_months(new)))
        for path in (self.changes, self.rows, f"{self.months}-touched", self.months):
            discard(self.spark, path)


def incremental_sync(
    spark: SparkSession,
    report_path: str,
    table_path: str,
    checkpoint_path: str,
    mart_path: str | None = None,
    bronze_path: str | None = None,
    pattern: str = REPORT_FILES,
    whole_reports: bool = True,
    files_per_batch: int = 10_000,
    strict: bool = False,
    final_only: bool = False,
    keep_days: int | None = None,
    as_of: str | None = None,
) -> StreamingQuery:
    """Start a run over the files not seen yet; it ends when they are all in.

    The stream carries file names only.  Each batch scans its files by header, since
    headers drift, and replaces the reports it holds, of each the newest fetch of all runs
    (``whole_reports=False``: upserts single lots by id, the later batch winning); writing
    the same batch twice changes nothing, so a batch lost half way is simply run again.  No
    file is too old: back-fills and copies that keep their times are read too, and lose
    against newer fetches of their reports.  Late reports reopen old weeks: the mart is
    changed by the lots that came and went.  Schedule it every six hours.

    ``strict`` stops at a column no one has described.  ``final_only``: once a report has a
    fetch with final rows, fetches without such rows do not replace it, and its preliminary
    rows are left out.  ``keep_days``: lots and mart keep the days from so many before
    ``as_of`` (a date, else today) on, and rows without a date; older rows go before the run
    and do not come in with it.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", "36500d")
        .load(report_path)
        .select("path")
    )
    first_day = None
    if keep_days is not None:
        first_day = first_kept_day(as_of or str(datetime.date.today()), keep_days)
        drop_old_days(spark, table_path, first_day, mart_path)

    def put(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = [row["path"] for row in batch.collect()]
        if not paths:
            return
        files_path = scratch_path(session, "report-files")
        files = report_files(session, paths, pattern, files_path)
        if strict:
            alias_guard(files)
        raw_path = f"{bronze_path}/batch={batch_id}" if bronze_path else scratch_path(session, "bronze")
        raw = store_rows(session, files, raw_path)
        discard(session, files_path)
        if raw is not None:
            put_rows(session, raw, batch_id)
        if not bronze_path:
            discard(session, raw_path)

    def put_rows(session: SparkSession, raw: DataFrame, batch_id: int) -> None:
        if whole_reports:
            step = MartStep(session, mart_path, f"{checkpoint_path}/mart-{batch_id}") if mart_path else None
            put_fetches(session, table_path, raw, final_only, first_day, step.note_changes if step else None)
            if step:
                step.apply(read_lots(session, table_path))
            return
        lots = keep_final(normalise(raw)) if final_only else normalise(raw)
        if first_day:
            lots = lots.filter(F.col("report_date").isNull() | (F.col("report_date") >= F.lit(first_day).cast("date")))
        months = upsert_lots(session, table_path, lots.withColumn("ingest_seq", F.lit(batch_id).cast("bigint")))
        if mart_path:
            stored = in_months(read_lots(session, table_path), months)
            write_mart(stored, mart_path)
            drop_months(session, mart_path, set(months) - set(touched_months(stored)))

    return (
        files.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def drop_old_days(spark: SparkSession, table_path: str, first_day: str, mart_path: str | None = None) -> list[str]:
    """Take days before ``first_day`` out of the lots, their list of fetches and the mart; returns the lots' months touched."""
    months = trim_days(spark, table_path, S.LOTS_SCHEMA, first_day, write_lots)
    trim_days(spark, ledger_path(table_path), LEDGER_SCHEMA, first_day)
    if mart_path:
        trim_days(spark, mart_path, MART_SCHEMA, first_day)
    return months


def drop_old_months(spark: SparkSession, table_path: str, as_of: str, days: int) -> list[str]:
    """``drop_old_days`` of the lots, given the day to count from."""
    return drop_old_days(spark, table_path, first_kept_day(as_of, days))


def freshness_status(lots: DataFrame, last_sync: str) -> DataFrame:
    """Newest publication, last and next sync, and the window of active lots."""
    synced = F.lit(last_sync).cast("timestamp_ntz")
    day = synced.cast("date")
    return lots.agg(F.max("published_date").alias("newest")).select(
        iso_stamp(F.col("newest")).alias("data_as_of"),
        iso_stamp(synced).alias("last_sync"),
        iso_stamp(synced + F.expr(f"interval {S.SYNC_HOURS} hours")).alias("next_sync"),
        iso_date(F.date_sub(day, S.FETCH_DAYS)).alias("window_from"),
        iso_date(day).alias("window_to"),
    )
