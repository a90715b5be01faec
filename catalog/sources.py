"""Source and sink queries (S rows, the alias guard and the incremental sync).

Each writes the fixture's rows as files to a new folder of the shared scratch space
and reads them back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.measures import head_weighted_avg
from paddock.functions.prices import derive_prices
from paddock.functions.public import public_lots
from paddock.operators.normalise import normalise
from paddock.plans.mart import TERMS, read_mart
from paddock.session import scratch_path
from paddock.sources import payloads, reports, tables
from paddock.sources.star import star_lots, star_raw, star_reports, star_rows
from paddock.streaming.sync import incremental_sync
from paddock.streaming.trend import read_trend, stream_weekly_trend, streamed_trend

from . import aggregates  # noqa: F401  (registers the expected results reused here)
from . import AS_OF, EXPECTED, query
from .expected import PUBLIC_COLUMNS, avg_e4, lots, public, raw
from .plans import DAILY_MART
from .normalisation import raw_reports

# The public columns that do not depend on where a row stands in its file.
UNPLACED = tuple(name for name in PUBLIC_COLUMNS if name != "id")
LANDED = ("id", "slug_id", "report_date", "published_date", "price_unit", "avg_price")


def land(spark, sf_dir, path=None, forms=None, keyed=True, where="true", **options):
    """Write raw reports as CSV, in up to three forms of header, to one folder.

    ``keyed``: with the fixture's own ``id``, which no real report has.
    """
    path = path or scratch_path(spark, "reports")
    for form, rows in star_reports(spark, sf_dir).items():
        if forms is None or form in forms:
            rows = rows.where(where)
            reports.write_reports(rows if keyed else rows.drop("id"), path, **options)
    return path


def drop_off(spark, rows, path, age_days=0):
    """Write raw reports as CSV with one header; with ``age_days`` the files are that old."""
    reports.write_reports(rows, path)
    if age_days:
        set_back(spark, path, age_days)


def set_back(spark, path, days):
    """Make all files below ``path`` older, as copies that keep their times are."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = system.listFiles(place, True)
    while files.hasNext():
        file = files.next()
        system.setTimes(file.getPath(), file.getModificationTime() - days * 86_400_000, -1)


def as_payloads(rows):
    """Each row as a payload of its own, in the four shapes payloads come in.

    By turns: a list of two sections, a single section, a section without a name, and
    a list in which one section has no results.
    """
    record = F.struct(*[F.col(f"`{name}`") for name in LANDED])
    header = F.struct(F.col("id"), F.col("slug_id"))
    shape = F.length("id") % 4
    body = F.to_json(F.array(record))
    head = F.to_json(F.array(header))

    def section(name, results):
        named = f'"reportSection": "{name}", ' if name else ""
        return F.concat(F.lit("{" + named + '"results": '), results, F.lit("}"))

    both = F.concat(
        F.lit("["), section("Report Header", head), F.lit(", "), section("Report Details", body), F.lit("]")
    )
    gap = F.concat(F.lit('[{"reportSection": "Report Header"}, '), section("Report Details", body), F.lit("]"))
    return rows.select(
        F.when(shape == 0, both)
        .when(shape == 1, section("Report Details", body))
        .when(shape == 2, section(None, body))
        .otherwise(gap)
        .alias("value")
    )


FLAT = """
    SELECT id, CASE length(id) % 4 WHEN 2 THEN 'UNKNOWN' ELSE 'Report Details' END AS section,
      CAST(slug_id AS VARCHAR) AS slug_id, strftime(published_date, '%m/%d/%Y %H:%M:%S') AS published_date,
      CASE length(id) % 4 WHEN 0 THEN 1 ELSE 0 END AS source_row
    FROM raw
    UNION ALL SELECT id, 'Report Header', CAST(slug_id AS VARCHAR), NULL, 0 FROM raw WHERE length(id) % 4 = 0"""


def flat_rows(spark, sf_dir):
    """Payload files written, scanned and flattened."""
    path = scratch_path(spark, "payloads")
    as_payloads(raw_reports(spark, sf_dir)).write.text(path)
    return payloads.flatten_sections(payloads.scan_payloads(spark, path), LANDED)


@query("flatten_sections", raw(FLAT))
def flatten_sections(spark, sf_dir):
    return flat_rows(spark, sf_dir).select(
        "id", F.col("_section").alias("section"), "slug_id", "published_date", "source_row"
    )


@query("fetch_window", raw("""
    SELECT id, strftime(published_date, '%m/%d/%Y %H:%M:%S') AS published_date FROM raw
    WHERE published_date BETWEEN DATE '2001-07-31' - 100 AND DATE '2001-07-31'"""))
def fetch_window(spark, sf_dir):
    return payloads.fetch_window(flat_rows(spark, sf_dir), AS_OF).select("id", "published_date")


@query("write_reports", raw("SELECT count(DISTINCT slug_id) AS reports, count(*) AS rows FROM raw"))
def write_reports(spark, sf_dir):
    """Counts of reports and of rows written."""
    path = scratch_path(spark, "reports")
    written = reports.write_reports(raw_reports(spark, sf_dir), path)
    counted = reports.written_reports(spark, path)
    return counted.withColumn("rows", F.lit(written.get["rows"]).cast("bigint"))


@query("scan_reports", lots(f"SELECT {public()} FROM lots"))
def scan_reports(spark, sf_dir):
    """Files of three different headers in one folder, read and normalised."""
    return public_lots(normalise(reports.scan_reports(spark, land(spark, sf_dir))))


@query("alias_guard", raw("""
    SELECT 'id' AS column_name, count(DISTINCT slug_id) AS files FROM raw"""))
def alias_guard(spark, sf_dir):
    """The guard stops at the fixture's own key; where it occurs, counted by report."""
    headers = reports.report_headers(spark, land(spark, sf_dir))
    by_report = headers.withColumn("path", F.regexp_extract("path", "/report=([^/]+)/", 1))
    try:
        reports.alias_guard(headers)
        named = []
    except ValueError as stopped:
        named = str(stopped).partition(": ")[2].split(", ")
    return reports.unknown_columns(by_report).where(F.col("column_name").isin(*named))


@query("upsert_lots", lots(f"SELECT {public()} FROM lots"))
def upsert_lots(spark, sf_dir):
    """A stale half of the lots, then all of them with stale copies mixed in."""
    path = scratch_path(spark, "lots")
    fresh = star_lots(spark, sf_dir).withColumn("ingest_seq", F.lit(2).cast("bigint"))
    stale = fresh.withColumns(
        {"head_count": F.lit(-1).cast("bigint"), "ingest_seq": F.lit(1).cast("bigint")}
    )
    tables.upsert_lots(spark, path, stale.filter(F.col("slug_id") % 2 == 0))
    tables.upsert_lots(spark, path, fresh.unionByName(stale.filter(F.col("slug_id") % 3 == 0)))
    return public_lots(tables.read_lots(spark, path), tuple(PUBLIC_COLUMNS))


@query("replace_reports", lots(f"SELECT {public()} FROM lots"))
def replace_reports(spark, sf_dir):
    """Reports stored under other ids first; the refetched reports leave none of them."""
    path = scratch_path(spark, "lots")
    fresh = star_lots(spark, sf_dir)
    shifted = fresh.filter(F.col("slug_id") % 2 == 0).withColumn("id", F.concat(F.lit("old-"), "id"))
    tables.replace_reports(spark, path, shifted)
    tables.replace_reports(spark, path, fresh)
    return public_lots(tables.read_lots(spark, path), tuple(PUBLIC_COLUMNS))


@query("upsert_corrected_date", lots(f"SELECT {public()} FROM lots"))
def upsert_corrected_date(spark, sf_dir):
    """Lots first stored under a date forty days early: the correction moves them, one row each."""
    path = scratch_path(spark, "lots")
    fresh = star_lots(spark, sf_dir).withColumn("ingest_seq", F.lit(2).cast("bigint"))
    early = fresh.filter(F.col("slug_id") % 2 == 0).withColumns(
        {"report_date": F.date_sub("report_date", 40), "ingest_seq": F.lit(1).cast("bigint")}
    )
    early = early.withColumn("report_month", F.substring(F.col("report_date").cast("string"), 1, 7))
    tables.upsert_lots(spark, path, early)
    tables.upsert_lots(spark, path, fresh)
    return public_lots(tables.read_lots(spark, path))


@query("write_reports_twice", raw("SELECT count(DISTINCT slug_id) AS reports, count(*) AS rows FROM raw"))
def write_reports_twice(spark, sf_dir):
    """Reports landed again replace what was landed; counted from the files."""
    path = land(spark, sf_dir, keyed=False)
    rows = reports.scan_reports(spark, land(spark, sf_dir, path, keyed=False))
    return rows.agg(F.count_distinct("slug_id").alias("reports"), F.count("*").alias("rows"))


@query("ingest_if_empty", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def ingest_if_empty(spark, sf_dir):
    """Loads on the first call and does nothing on the second; ids are those of the ingest."""
    table, landed = scratch_path(spark, "lots"), land(spark, sf_dir, keyed=False)
    tables.ingest_if_empty(spark, landed, table)
    return public_lots(tables.ingest_if_empty(spark, landed, table), UNPLACED)


def split_lots(spark, sf_dir):
    """Reports landed in files of at most fifty rows, ingested."""
    landed = land(spark, sf_dir, keyed=False, max_rows_per_file=50)
    return tables.ingest_if_empty(spark, landed, scratch_path(spark, "lots"))


@query("ingest_split_reports", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def ingest_split_reports(spark, sf_dir):
    return public_lots(split_lots(spark, sf_dir), UNPLACED)


@query("ingest_landed_by_header", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def ingest_landed(spark, sf_dir):
    """Files of fifty rows copied by header, twice, then scanned folder by folder."""
    landed, landing = land(spark, sf_dir, keyed=False, max_rows_per_file=50), scratch_path(spark, "landing")
    reports.land_by_header(spark, landed, landing)
    return public_lots(tables.ingest_if_empty(spark, landed, scratch_path(spark, "lots"), landing=landing), UNPLACED)


@query("ingest_ids", lots("""
    SELECT count(*) AS lots, count(*) AS ids, count(*) AS ids_of_their_report FROM lots"""))
def ingest_ids(spark, sf_dir):
    """Every lot of split reports has an id of its own, made of its report's id and date."""
    rows = split_lots(spark, sf_dir)
    prefix = F.concat_ws("-", "slug_id", F.replace("report_date_raw", F.lit("/"), F.lit("-")), F.lit(""))
    return rows.agg(
        F.count("*").alias("lots"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("id").startswith(prefix)).alias("ids_of_their_report"),
    )


@query("incremental_sync", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def sync(spark, sf_dir):
    """Two drops of files of different headers, each followed by a run of the stream."""
    landed = scratch_path(spark, "drops")
    table, progress = scratch_path(spark, "lots"), scratch_path(spark, "progress")
    for drop in (["canonical"], ["alias", "published_alias"]):
        land(spark, sf_dir, landed, drop, keyed=False)
        incremental_sync(spark, landed, table, progress, strict=True).awaitTermination()
    return public_lots(tables.read_lots(spark, table), UNPLACED)


@query("sync_refetch_moved_window", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def sync_refetch(spark, sf_dir):
    """Reports fetched first without some rows, then whole: places shift, no lot counts twice."""
    landed = scratch_path(spark, "drops")
    table, progress = scratch_path(spark, "lots"), scratch_path(spark, "progress")
    for where in ("slug_id % 2 = 0 and length(report_date) % 2 = 0", "true"):
        land(spark, sf_dir, landed, keyed=False, where=where)
        incremental_sync(spark, landed, table, progress).awaitTermination()
    return public_lots(tables.read_lots(spark, table), UNPLACED)


@query("sync_late_backfill", lots(f"SELECT {public(UNPLACED)} FROM lots"))
def sync_late_backfill(spark, sf_dir):
    """Whole reports first; older fetches of them with fewer rows arrive in a later run and lose."""
    landed = scratch_path(spark, "drops")
    table, progress = scratch_path(spark, "lots"), scratch_path(spark, "progress")
    rows = star_raw(spark, sf_dir)
    drop_off(spark, rows, f"{landed}/new")
    incremental_sync(spark, landed, table, progress).awaitTermination()
    drop_off(spark, rows.where("slug_id % 2 = 0 and length(report_date) % 2 = 0"), f"{landed}/old", age_days=30)
    incremental_sync(spark, landed, table, progress).awaitTermination()
    return public_lots(tables.read_lots(spark, table), UNPLACED)


FINAL_ROWS = """
    final_ind = 'Final' OR NOT EXISTS (SELECT 1 FROM raw r
      WHERE r.slug_id = lots.slug_id AND r.report_date = lots.report_date AND r.final_ind = 'Final')"""


@query("sync_final_then_preliminary", lots(f"SELECT {public(UNPLACED)} FROM lots WHERE {FINAL_ROWS}"))
def sync_final_then_preliminary(spark, sf_dir):
    """Final rows first, preliminary ones in a later run: these only fill reports without final rows."""
    landed = scratch_path(spark, "drops")
    table, progress = scratch_path(spark, "lots"), scratch_path(spark, "progress")
    for status in ("Final", "Preliminary"):
        drop_off(spark, star_raw(spark, sf_dir).where(F.col("final_ind") == status), f"{landed}/{status}")
        incremental_sync(spark, landed, table, progress, final_only=True).awaitTermination()
    return public_lots(tables.read_lots(spark, table), UNPLACED)


@query("sync_unreadable_dates", lots(f"""
    SELECT slug_id, CASE WHEN slug_id % 2 = 0 THEN 'week of ' || dayname(report_date) ELSE strftime(report_date, '%m/%d/%Y') END
      AS report_date_raw, count(*) AS lots, CAST(sum(cents) AS BIGINT) * 100 AS prices_e4 FROM lots GROUP BY ALL"""))
def sync_unreadable_dates(spark, sf_dir):
    """Half the reports give no date but a text; seven such texts of one report stay seven reports."""

    def change(rows):
        day = F.to_date(F.regexp_replace("report_date", "^([0-9]+)/([0-9]+)/([0-9]+)$", "$3-$1-$2"))
        text = F.when(F.col("slug_id") % 2 == 0, F.concat(F.lit("week of "), F.date_format(day, "EEEE")))
        return rows.withColumn("report_date", F.coalesce(text, F.date_format(day, "MM/dd/yyyy")))

    landed = scratch_path(spark, "drops")
    table, progress = scratch_path(spark, "lots"), scratch_path(spark, "progress")
    for place, date in (("a", "week of %day"), ("b", "%/%")):
        rows = change(star_raw(spark, sf_dir)).where(F.col("report_date").like(date))
        drop_off(spark, rows, f"{landed}/{place}")
        incremental_sync(spark, landed, table, progress).awaitTermination()
    rows = tables.read_lots(spark, table)
    return rows.groupBy("slug_id", "report_date_raw").agg(
        F.count("*").alias("lots"), F.sum("avg_price_e4").alias("prices_e4")
    )


KEEP_DAYS = 100


def synced_with_retention(spark, sf_dir):
    """Even reports without a limit of age, then the others with one; both runs feed the mart."""
    landed = scratch_path(spark, "drops")
    table, mart, progress = (scratch_path(spark, name) for name in ("lots", "mart", "progress"))
    for odd, keep in ((0, None), (1, KEEP_DAYS)):
        drop_off(spark, star_raw(spark, sf_dir).where(f"slug_id % 2 = {odd}"), f"{landed}/{odd}")
        incremental_sync(spark, landed, table, progress, mart, keep_days=keep, as_of=AS_OF).awaitTermination()
    return table, mart


RECENT = f"report_date >= DATE '{AS_OF}' - {KEEP_DAYS}"


@query("sync_retention", lots(f"SELECT {public(UNPLACED)} FROM lots WHERE {RECENT}"))
def sync_retention(spark, sf_dir):
    return public_lots(tables.read_lots(spark, synced_with_retention(spark, sf_dir)[0]), UNPLACED)


def stored_mart(spark, path):
    mart = read_mart(spark, path).drop(*TERMS, "report_month")
    return mart.withColumn("report_date", F.col("report_date").cast("string"))


@query("sync_retention_mart", lots(DAILY_MART.replace("FROM lots", f"FROM lots WHERE {RECENT}")))
def sync_retention_mart(spark, sf_dir):
    return stored_mart(spark, synced_with_retention(spark, sf_dir)[1])


@query("mart_after_refetch", lots(DAILY_MART))
def mart_after_refetch(spark, sf_dir):
    """A mart of reports fetched first with other prices and heads and too many rows, then as they are."""
    rows = star_raw(spark, sf_dir)
    odd = F.length("avg_price") % 2 == 0
    wrong = {name: F.when(odd, F.lit(value)).otherwise(F.col(name)) for name, value in (("avg_price", "12.34"), ("head_count", "77"))}
    even = rows.where("slug_id % 2 = 0")
    first = even.withColumns(wrong).unionByName(rows.where("slug_id % 4 <> 2"))
    landed = scratch_path(spark, "drops")
    table, mart, progress = (scratch_path(spark, name) for name in ("lots", "mart", "progress"))
    for place, drop in (("a", first), ("b", even)):
        drop_off(spark, drop, f"{landed}/{place}")
        incremental_sync(spark, landed, table, progress, mart).awaitTermination()
    return stored_mart(spark, mart)


@query("stream_weekly_trend", EXPECTED["weekly_trend"])
def stream_trend(spark, sf_dir):
    """Lots up to the day in question; a fifth of the reports of the last month arrive in a later run."""
    drops, trend, progress = (scratch_path(spark, name) for name in ("lots", "trend", "progress"))
    rows = star_lots(spark, sf_dir).filter(F.col("report_date") <= F.lit(AS_OF).cast("date"))
    late = (F.col("slug_id") % 5 == 0) & (F.col("report_date") > F.lit(AS_OF).cast("date") - 30)
    for part in (rows.filter(~late), rows.filter(late)):
        part.write.mode("append").parquet(drops)
        stream_weekly_trend(spark, drops, trend, progress, delay="35 days").awaitTermination()
    return streamed_trend(read_trend(spark, trend), AS_OF)


# --- absurd numbers: a seventh of the rows with prices, weights and heads beyond all bounds ---

EXTREME = """
    SELECT id, species, price_unit, cents % 7 = 0 AS wild, cents * 100 * CASE WHEN cents % 7 = 0 THEN 10000000000 ELSE 1 END AS p,
      avg_weight * 10000 AS w, head_count AS head
    FROM raw WHERE cents IS NOT NULL"""
EXTREME_PRICED = """
    SELECT *, CASE WHEN price_unit = 'Per Cwt' THEN (2 * p + 100) // 200
      WHEN NOT wild THEN (2 * p * 10000 + w) // (2 * w) END AS lb FROM wild_rows"""


def wild_rows(spark, sf_dir):
    rows = star_rows(spark, sf_dir, ("id", "species", "price_unit", "price_cents", "avg_weight", "head_count"))
    wild = F.col("price_cents") % 7 == 0
    return rows.where("price_cents is not null").select(
        "id", "species", "price_unit",
        (F.col("price_cents") * 100 * F.when(wild, 10_000_000_000).otherwise(1)).alias("price_e4"),
        (F.col("avg_weight") * 10_000 * F.when(wild, 1_000_000).otherwise(1)).alias("weight_e4"),
        (F.col("head_count") * F.when(wild, 10_000_000_000_000).otherwise(1)).alias("head_count"),
    ).withColumns({name: F.expr(sql) for name, sql in derive_prices("price_e4", "price_unit", "weight_e4").items()})


@query("extreme_prices", f"""{raw('').rstrip()}, wild_rows AS ({EXTREME}), priced AS ({EXTREME_PRICED})
    SELECT id, lb AS price_per_lb_e4,
      CASE WHEN price_unit = 'Per Unit' THEN p WHEN NOT wild THEN (2 * lb * w + 1000000) // 2000000 * 100 END AS price_per_head_e4
    FROM priced""")
def extreme_prices(spark, sf_dir):
    """A price that is beyond whole numbers is null; the lot stays."""
    return wild_rows(spark, sf_dir).select("id", "price_per_lb_e4", "price_per_head_e4")


@query("extreme_average", f"""{raw('').rstrip()}, wild_rows AS ({EXTREME}), priced AS ({EXTREME_PRICED}),
    weighed AS (SELECT species, lb AS ppl, coalesce(head, 1) AS hw FROM priced WHERE NOT wild OR coalesce(head, 0) = 0)
    SELECT species, {avg_e4()} AS avg_e4 FROM weighed GROUP BY species""")
def extreme_average(spark, sf_dir):
    """Lots whose price times heads is beyond whole numbers weigh nothing."""
    return wild_rows(spark, sf_dir).groupBy("species").agg(head_weighted_avg().alias("avg_e4"))
