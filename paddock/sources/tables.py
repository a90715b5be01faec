"""The stored lot table: upsert, first load, partitioned layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.dates import report_month
from ..operators.normalise import keep_final, normalise
from ..plans.dealt import dealt
from ..plans.months_written import write_in_months
from ..session import discard, scratch_path, shuffles_let_go, store
from .months import drop_months, in_months, month_order, read_table, touched_months
from .ledger import newest_fetches, record_fetches
from .reports import (
    REPORT_FILES, alias_guard, fetched_reports, land_by_header, landed_files, report_files, report_headers, rows_of_fetches,
    store_rows,
)


def read_lots(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or nothing if it was never written."""
    return read_table(spark, path, S.LOTS_SCHEMA)


def last_write(
    rows: DataFrame, key: str = "id", order: str = "ingest_seq", path: str | None = None
) -> DataFrame:
    """One row of each key, that with the highest ``order``.

    The rows are written to ``path`` or to scratch space with their place, which must not
    change; beside it goes the list of places that lose, found on whole numbers only, with
    partial maxima, among the keys written more than once.  Of equal ``order`` the last in the
    table wins.  Where few rows lose the list is broadcast and no whole row is shuffled.
    """
    path = path or scratch_path(rows.sparkSession, "placed")
    placed = store(rows.withColumn("__place", F.monotonically_increasing_id()), "placed", path)
    highest = placed.groupBy(key).agg(F.max(order).alias("__order"), F.count("*").alias("__writes"))
    again = placed.select(key, order, "__place").join(highest.where("__writes > 1").drop("__writes"), key)
    last = again.where(F.col(order).eqNullSafe(F.col("__order"))).groupBy(key).agg(F.max("__place").alias("__last"))
    losers = again.select(key, "__place").join(last, key).where("__place <> __last").select("__place")
    losers = store(losers, "losers", f"{path}-losers")
    kept = placed.join(losers, "__place", "left_anti").where(F.col(key).isNotNull())
    return kept.select(*rows.columns)


def write_lots(lots: DataFrame, path: str, ids_per_file: int = 0, add: bool = False) -> list[str | None]:
    """Replace the months that ``lots`` holds, or ``add`` to them; returns these months.

    Months are spread over tasks by size; rows are sorted so that files can be
    skipped by species, class and weight.  With ``ids_per_file`` each file gets a
    Bloom filter for about so many ids, for lookups by id in a large table; such lots must
    not be read from the table itself.
    """
    rows, order = lots.select(*S.LOTS_SCHEMA.fieldNames()), ["species", "animal_class", "avg_weight"]
    if not ids_per_file:
        return write_in_months(rows, path, order, add)
    months = touched_months(rows)
    id_filter = {
        "parquet.bloom.filter.enabled#id": "true",
        "parquet.bloom.filter.expected.ndv#id": str(ids_per_file),
    }
    rows = dealt(rows, "report_month").sortWithinPartitions("report_month", *order)
    with shuffles_let_go(rows.sparkSession):
        (
            rows.write.mode("append" if add else "overwrite")
            .options(partitionOverwriteMode="dynamic", **id_filter)
            .partitionBy("report_month")
            .parquet(path)
        )
    return months


def _months_that_lose(current: DataFrame, went: DataFrame) -> dict[str | None, bool]:
    """The months of the stored rows that go, and whether other rows of the month stay."""
    lost = {row[0]: row[1] for row in went.groupBy("report_month").count().collect()}
    held = in_months(current, list(lost)).groupBy("report_month").count().collect()
    return {row[0]: row[1] > lost[row[0]] for row in held}


def _put(
    spark: SparkSession,
    path: str,
    fresh: DataFrame,
    current: DataFrame | None,
    lose: dict[str | None, bool],
    stays: Callable[[DataFrame], DataFrame],
) -> None:
    """Put ``fresh`` (a stored table) in the table; ``lose``: ``_months_that_lose``.

    A month that loses no row is only added to; one that does is written anew, with what stays
    of it.  Months are put in place one by one: a job lost during it leaves some months new and
    some old.  Running it again with the same updates gives the full result, since what was
    added is then found there and replaced.
    """
    if current is None:
        write_lots(fresh, path)
        return
    if lose:
        renewed, partly = in_months(fresh, list(lose)), [month for month, some in lose.items() if some]
        if partly:
            kept = stays(in_months(current, partly)).select(*S.LOTS_SCHEMA.fieldNames())
            renewed = renewed.unionByName(kept)
        drop_months(spark, path, set(lose) - set(write_lots(renewed, path)))
    added = set(touched_months(fresh)) - set(lose)
    if added:
        write_lots(in_months(fresh, list(added)), path, add=True)


def upsert_lots(spark: SparkSession, path: str, updates: DataFrame) -> list[str | None]:
    """Put ``updates`` in the table, the last write of an id winning; returns the months.

    ``updates`` has an ``ingest_seq``.  It is reduced to one row for each id; stored rows
    with these ids go, whatever month they are in (a lot whose date was corrected changes
    month).  Stored rows meet the updates by id only, so neither side is sorted as a whole,
    and only months that lose a row are written anew.
    """
    placed_path, fresh_path = scratch_path(spark, "placed"), scratch_path(spark, "updates")
    winners = last_write(updates, path=placed_path).select(*S.LOTS_SCHEMA.fieldNames())
    fresh = store(winners, "updates", fresh_path)
    discard(spark, placed_path)
    discard(spark, f"{placed_path}-losers")
    ids = fresh.select("id")
    months, lose = touched_months(fresh), {}
    current = read_lots(spark, path)
    if current is not None:
        # Only id and month are read to find the months that lose rows.
        lose = _months_that_lose(current, current.select("id", "report_month").join(ids, "id", "left_semi"))
        months = month_order({*months, *lose})
    _put(spark, path, fresh, current, lose, lambda rows: rows.join(ids, "id", "left_anti"))
    discard(spark, fresh_path)
    return months


def _key_of_lots() -> Column:
    """A lot's report; tables written before the column was there have id and date."""
    day = F.coalesce(F.col("report_date").cast("string"), F.col("report_date_raw"), F.lit(""))
    return F.coalesce("report_key", F.concat(F.coalesce(F.col("slug_id").cast("string"), F.lit("in")), F.lit("|"), day))


def replace_reports(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    reports: DataFrame | None = None,
    note_changes: Callable[[DataFrame, DataFrame | None], None] | None = None,
) -> list[str | None]:
    """Replace whole reports: the lots of a report id and date give way to the new ones.

    Places in a report shift when it is fetched anew with a moved window; replacing the
    report leaves no stale lots.  Months that lose no lot are only added to, so reports that are
    new cost no more than themselves.  ``updates`` holds one fetch of each report; ``reports``
    (report_key, report_date) names reports that may have no lots any more.
    ``note_changes`` is called with the lots that come and those that go (none for a new
    table) before the table changes.
    """
    current = read_lots(spark, path)
    if current is None and not note_changes:
        # A new table: nothing goes, and the lots are written once.
        write_lots(updates, path)
        days = read_lots(spark, path).select("report_month")
        if reports is not None:
            days = days.unionByName(reports.select(report_month(F.col("report_date")).alias("report_month")))
        return month_order(touched_months(days))
    fresh_path, stale_path = scratch_path(spark, "updates"), scratch_path(spark, "stale")
    fresh = store(updates.select(*S.LOTS_SCHEMA.fieldNames()), "updates", fresh_path)
    stale = fresh.select(_key_of_lots().alias("stale_key"), "report_date")
    if reports is not None:
        stale = stale.unionByName(reports.select(F.col("report_key").alias("stale_key"), "report_date"))
    stale = stale.distinct().withColumn("report_month", report_month(F.col("report_date")))
    stale = store(stale, "stale", stale_path)
    months = month_order(touched_months(stale))
    replaced = _key_of_lots() == F.col("stale_key")
    keys, went, lose = stale.select("stale_key"), None, {}
    if current is not None:
        # Only key and month are read to find the months that lose lots.
        keyed = in_months(current, months).select(_key_of_lots().alias("stale_key"), "report_month")
        lose = _months_that_lose(current, keyed.join(keys, "stale_key", "left_semi"))
        went = in_months(current, list(lose)).join(keys, replaced, "left_semi")
    if note_changes:
        note_changes(fresh, went)
    _put(spark, path, fresh, current, lose, lambda rows: rows.join(keys, replaced, "left_anti"))
    discard(spark, fresh_path)
    discard(spark, stale_path)
    return months


def _recent(first_day: str) -> Column:
    return F.col("report_date").isNull() | (F.col("report_date") >= F.lit(first_day).cast("date"))


def put_fetches(
    spark: SparkSession,
    table_path: str,
    raw: DataFrame,
    final_only: bool = False,
    first_day: str | None = None,
    note_changes: Callable[[DataFrame, DataFrame | None], None] | None = None,
) -> list[str | None]:
    """Put the reports of ``raw`` (stored rows with their fetch) in the table, the newest fetch of each.

    Newest of those at hand and of the one stored, as the table's list of fetches has it; so
    it does not matter in which order files arrive.  With ``final_only`` a fetch with final
    rows beats any without, and of a report that has final rows the preliminary ones are
    left out.  Lots and fetches of days before ``first_day`` are left out.  Returns the months touched.
    """
    fetched_path, chosen_path = scratch_path(spark, "fetched"), scratch_path(spark, "chosen")
    fetched = fetched_reports(raw)
    if first_day:
        # Before they are grouped: mostly few reports are recent.
        fetched = fetched.filter(_recent(first_day))
    fetched = store(fetched, "fetched", fetched_path)
    chosen = newest_fetches(spark, table_path, fetched, final_only)
    if chosen is not fetched:
        chosen = store(chosen, "chosen", chosen_path)
    lots = normalise(rows_of_fetches(raw, chosen, fetched))
    if final_only:
        lots = keep_final(lots)
    if first_day:
        lots = lots.filter(_recent(first_day))
    months = replace_reports(spark, table_path, lots, chosen, note_changes)
    record_fetches(spark, table_path, chosen)
    discard(spark, fetched_path)
    discard(spark, chosen_path)
    return months


def ingest_reports(
    spark: SparkSession,
    report_path,
    table_path: str,
    pattern: str = REPORT_FILES,
    bronze_path: str | None = None,
    strict: bool = False,
    final_only: bool = False,
    landing: str | None = None,
) -> None:
    """Read report files, normalise them and replace their reports in the table.

    Of several fetches of a report and date the newest counts.  ``strict`` stops before
    the scan if a file has a column no one has described.  With ``landing`` the files are
    copied there by header first: for folders whose file names are too many for the driver.
    """
    if strict:
        alias_guard(report_headers(spark, report_path, pattern))
    files_path, raw_path = scratch_path(spark, "report-files"), bronze_path or scratch_path(spark, "bronze")
    if landing:
        land_by_header(spark, report_path, landing, pattern)
        files = landed_files(spark, landing, files_path)
    else:
        files = report_files(spark, report_path, pattern, files_path)
    raw = store_rows(spark, files, raw_path)
    discard(spark, files_path)
    if raw is None:
        raise FileNotFoundError(f"no report files matching {pattern} in {report_path}")
    put_fetches(spark, table_path, raw, final_only)
    if not bronze_path:
        discard(spark, raw_path)


def ingest_if_empty(spark: SparkSession, report_path, table_path: str, **options) -> DataFrame:
    """Load the table only when it holds no lots; options as in ``ingest_reports``."""
    current = read_lots(spark, table_path)
    if current is None or current.isEmpty():
        ingest_reports(spark, report_path, table_path, **options)
        current = read_lots(spark, table_path)
    return current
