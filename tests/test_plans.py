"""What the plans look like: pruning, pushdown, no Python, no product joins."""

import re

import __spark_entry__ as app
import pytest
from helpers import lot_frame

from pyspark.sql import functions

from paddock.operators import aggregates, filters, listing, normalise
from paddock.sources.star import star_lots, star_raw
from paddock.sources.tables import last_write, read_lots, write_lots

FILE_QUERIES = {
    "scan_reports", "alias_guard", "ingest_if_empty", "incremental_sync", "write_reports",
    "upsert_lots", "replace_reports", "flatten_sections", "fetch_window", "lot_id",
    "schema_profile", "schema_profile_samples", "upsert_corrected_date", "write_reports_twice",
    "ingest_split_reports", "ingest_ids", "sync_refetch_moved_window", "sync_late_backfill",
    "sync_final_then_preliminary", "sync_unreadable_dates", "sync_retention", "sync_retention_mart", "mart_after_refetch",
    "stream_weekly_trend", "ingest_landed_by_header",
} | set(app.LLM_QUERIES)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "lots")
    months = [f"2026-{month:02d}-05" for month in range(1, 7)]
    write_lots(lot_frame(spark, *[{"report_date": day} for day in months for _ in range(4)]), path)
    return read_lots(spark, path)


@pytest.mark.parametrize("name", sorted(set(app.queries()) - FILE_QUERIES))
def test_no_python_and_no_product_joins(spark, sf_dir, name):
    text = plan(app.queries()[name](spark, sf_dir))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_window_prunes_months_and_pushes_filters(stored):
    text = plan(aggregates.weekly_trend(stored, "2026-03-10", species="Goats", period=30))
    assert "report_month" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(species,Goats)" in pushed and "IsNotNull(price_per_lb_e4)" in pushed
    assert "narrative" not in text and "quality_grade" not in text


def test_pruned_months_are_not_read(spark, stored):
    frame = filters.date_window(stored, "2026-03-10", 30)
    assert len(frame.select("id").inputFiles()) > 0
    files = {row[0] for row in frame.selectExpr("_metadata.file_path").distinct().collect()}
    assert files and all("2026-03" in name or "2026-02" in name for name in files)


def test_top_rows_need_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(listing.list_lots(stored, sort_by="price_per_lb"))
    assert "TakeOrderedAndProject" in plan(listing.nearest_lots(stored, 60))


def test_aggregates_are_partial_before_the_shuffle(stored):
    text = plan(aggregates.compare_markets(stored, "2026-03-10", "Goats"))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_movers_scan_once(stored):
    assert plan(aggregates.top_mover(stored, "2026-03-01", "2026-03-14")).count("FileScan") == 1


def test_fixture_joins_only_what_is_asked_for(spark, sf_dir):
    assert plan(star_lots(spark, sf_dir, "species price_per_lb_e4")).count("FileScan") == 2


def test_fixture_shuffles_order_lines_for_parts_and_orders_only(spark, sf_dir):
    """Customers meet their orders before the order lines do."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        text = plan(star_lots(spark, sf_dir, "receipts_week_ago"))
    finally:
        spark.conf.set(setting, kept)
    assert text.index("hashpartitioning(l_orderkey") < text.index("hashpartitioning(o_custkey")


def test_a_page_is_fetched_by_its_ids_at_the_source(spark, sf_dir):
    """Order lines are filtered where they are read, not after they were joined."""
    text = plan(listing.list_lots(star_lots(spark, sf_dir), sort_by="price_per_lb", limit=200))
    above = [text[: place].splitlines()[-2:] for place in (m.start() for m in re.finditer(r"FileScan parquet \[l_orderkey", text))]
    assert len(above) == 2 and all("Filter" in lines[0] and "concat_ws(-" in lines[0] for lines in above)
    assert listing.list_lots(star_lots(spark, sf_dir), species="Pigs").count() == 0


def test_lookups_read_their_months_only(stored):
    """A lot's month and the months of its trend window, not the whole table."""
    lookup = plan(listing.get_lot(stored, "0008", "2026-03-05"))
    assert "report_month" in lookup.split("PartitionFilters: [")[1].split("]")[0]
    text = plan(aggregates.lot_trend(stored, "0008", report_date="2026-03-05"))
    assert "dynamicpruning" in text and "BroadcastHashJoin" in text


def test_keep_final_reads_twice(stored):
    assert plan(normalise.keep_final(stored)).count("FileScan") == 2


def test_upsert_sorts_no_whole_rows(spark, stored):
    """Winners are found by numbers: no aggregate carries whole lots."""
    text = plan(last_write(stored.withColumn("ingest_seq", functions.lit(1))))
    assert "SortAggregate" not in text


def test_raw_rows_meet_orders_before_parts(spark, sf_dir):
    """All lines are wanted: the texts of parts are not shuffled with them for orders."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        raw, lots = plan(star_raw(spark, sf_dir)), plan(star_lots(spark, sf_dir))
    finally:
        spark.conf.set(setting, kept)
    assert raw.index("hashpartitioning(l_partkey") < raw.index("hashpartitioning(l_orderkey")
    assert lots.index("hashpartitioning(l_orderkey") < lots.index("hashpartitioning(l_partkey")
