"""Files in and out: drifting headers, payloads, upsert, incremental sync."""

import json

import pytest
from helpers import lot_frame, raw_row
from pyspark.sql import functions as F

from paddock.functions.public import public_lots
from paddock.operators.normalise import normalise
from paddock.plans.mart import daily_mart
from paddock.sources import payloads, reports, tables
from paddock.sources.profile import schema_profile
from paddock.streaming.sync import incremental_sync

PLAIN = (
    "slug_id,report_date,published_date,_section,category,class,price_unit,avg_price,avg_weight,report_narrative\n"
    '1772,02/09/2026,02/09/2026 18:47:05,Report Header,,,,,,"Header, ""quoted"""\n'
    '1772,02/09/2026,02/09/2026 18:47:05,Report Details,Goats,Kids,Per Cwt,264.58,118,"two\nlines"\n'
    "1772,02/16/2026,02/16/2026 10:00:00,Report Details,Goats,Kids,Per Cwt,N/A,118,x\n"
    "1772,02/16/2026,02/16/2026 10:00:00,Report Details,Sheep,Ewes,Per Unit,187,60,x\n"
)
ALIASED = (
    "report_date,slug_id,wtd_Avg_Price,wtd_avg_wt,weight_Break_Low,published_Date,category,class,price_unit,_section\n"
    "02/13/2026,2922,249.5,130.0,130.0,02/13/2026 08:11:45,Sheep,Lambs,Per Cwt,UNKNOWN\n"
)


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a_1772.csv").write_text(PLAIN)
    (folder / "a_2922.csv").write_text(ALIASED)
    (folder / "notes.txt").write_text("no report")
    return str(folder)


def test_headers_are_read_by_name(spark, landed):
    rows = {r.id: r for r in public_lots(normalise(reports.with_source_row(reports.scan_reports(spark, landed)))).collect()}
    assert sorted(rows) == ["1772-02-09-2026-0001", "1772-02-16-2026-0003", "2922-02-13-2026-0000"]
    assert rows["1772-02-09-2026-0001"].narrative == "two\nlines"
    other = rows["2922-02-13-2026-0000"]
    assert (other.avg_price, other.avg_weight, other.weight_break_low) == (249.5, 130, 130)
    assert other.published_date == "2026-02-13T08:11:45" and other.animal_class == "Lambs"


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        reports.scan_reports(spark, str(tmp_path))


def test_alias_guard(spark, landed):
    headers = reports.report_headers(spark, landed)
    reports.alias_guard(headers)
    with pytest.raises(ValueError, match="wtd_avg_wt"):
        reports.alias_guard(headers, [n for n in reports.S.KNOWN_RAW_COLUMNS if n != "wtd_avg_wt"])


def test_header_reading_opens_files_with_a_marker(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbfslug_id,\"a \"\"b\"\", c\"\n1,2\n")
    assert reports.report_headers(spark, str(tmp_path)).first()["header"] == ["slug_id", 'a "b", c']


def test_written_reports_read_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "a", " padded "), ("1", "b", 'say "x", y'), ("2", "c", "two\nlines"), ("2", "d", None)],
        "slug_id string, class string, report_narrative string",
    )
    path = str(tmp_path / "out")
    written = reports.write_reports(rows, path, max_rows_per_file=1)
    assert written.get["rows"] == 4
    assert reports.written_reports(spark, path).first()["reports"] == 2
    back = reports.scan_reports(spark, path).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert reports.report_headers(spark, path).count() == 4


def test_payload_shapes(spark):
    record = {"slug_id": 1772, "avg_price": 264.58, "wtd_avg_wt": 118, "class": None, "new_key": {"a": 1}}
    lines = [
        json.dumps([{"reportSection": "Report Header", "results": [{"slug_id": 1}]},
                    {"reportSection": "Report Details", "results": [record, record]}]),
        json.dumps({"results": [record]}),
        json.dumps([{"reportSection": "Report Details"}]),
        json.dumps("Invalid slug 9"),
        json.dumps([]),
        "",
    ]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    rows = payloads.flatten_sections(frame).orderBy("_section", "source_row").collect()
    assert [(r["_section"], r.source_row) for r in rows] == [
        ("Report Details", 1), ("Report Details", 2), ("Report Header", 0), ("UNKNOWN", 0),
    ]
    assert (rows[0].avg_price, rows[0].avg_weight, rows[0]["class"]) == ("264.58", "118", None)


def test_upsert_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "lots")

    def lots(*rows, seq):
        return lot_frame(spark, *rows).withColumn("ingest_seq", F.lit(seq).cast("bigint"))

    tables.upsert_lots(spark, path, lots({"id": "a", "head_count": 1}, {"id": "b", "report_date": "2026-01-05"}, seq=0))
    copies = lots(*[{"id": "a", "head_count": 2}] * 50, seq=1).unionByName(lots({"id": "a", "head_count": 3}, seq=2))
    months = tables.upsert_lots(spark, path, copies.unionByName(lots({"id": "c", "report_date": None}, seq=1)))
    assert set(months) == {"2026-02", None}
    got = {r.id: (r.head_count, r.report_month) for r in tables.read_lots(spark, path).collect()}
    assert got == {"a": (3, "2026-02"), "b": (1, "2026-01"), "c": (1, None)}
    tables.upsert_lots(spark, path, lots({"id": "c", "report_date": None, "head_count": 9}, seq=2))
    assert tables.read_lots(spark, path).filter("id = 'c'").first().head_count == 9


def test_replaced_report_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "lots")
    tables.replace_reports(spark, path, lot_frame(spark, {"id": "x"}, {"id": "y"}, {"id": "z", "slug_id": 2}, {"id": "n", "report_date": None}))
    tables.replace_reports(spark, path, lot_frame(spark, {"id": "w"}, {"id": "m", "report_date": None}))
    assert sorted(r.id for r in tables.read_lots(spark, path).collect()) == ["m", "w", "z"]


def _files(path):
    return {str(file): file.stat().st_mtime_ns for file in path.rglob("*.parquet")}


def test_months_that_lose_nothing_are_added_to(spark, tmp_path):
    """New reports and ids cost no more than themselves: what is stored of their months is not written again."""
    path = tmp_path / "lots"
    tables.replace_reports(spark, str(path), lot_frame(spark, {"id": "a"}, {"id": "b", "report_date": "2026-01-05", "slug_id": 5}))
    before = _files(path)
    tables.replace_reports(spark, str(path), lot_frame(spark, {"id": "c", "slug_id": 2}, {"id": "d", "slug_id": 3, "report_date": None}))
    assert before.items() <= _files(path).items() and len(_files(path)) > len(before)
    before = _files(path)
    update = lot_frame(spark, {"id": "e", "slug_id": 4}).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    assert tables.upsert_lots(spark, str(path), update) == ["2026-02"]
    assert before.items() <= _files(path).items()
    # The same batch once more changes no row; of its month what stays is written anew.
    assert tables.upsert_lots(spark, str(path), update) == ["2026-02"]
    assert sorted(r.id for r in tables.read_lots(spark, str(path)).collect()) == ["a", "b", "c", "d", "e"]
    months = tables.replace_reports(spark, str(path), lot_frame(spark, {"id": "f", "slug_id": 5, "report_date": "2026-01-05"}))
    assert months == ["2026-01"]
    assert sorted(r.id for r in tables.read_lots(spark, str(path)).collect()) == ["a", "c", "d", "e", "f"]


def test_rows_are_kept_by_what_was_not_chosen(spark, tmp_path):
    """Rows of a few fetches that lost are left out by a short list, and by none if all were chosen."""
    rows = spark.createDataFrame([(str(n), "2026-02-09", f"f{n % 3}") for n in range(30)], "slug_id string, report_date string, fetch string")
    raw = rows.withColumn("fetched_at", F.lit("2026-02-10 00:00:00").cast("timestamp"))
    fetched = reports.fetched_reports(raw)
    assert reports.rows_of_fetches(raw, fetched, fetched) is raw
    for kept in ("fetch <> 'f1'", "fetch = 'f1'"):
        got = reports.rows_of_fetches(raw, fetched.where(kept), fetched)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, raw.where(kept).collect()))


def test_last_write_shuffles_no_whole_rows_where_few_lose(spark):
    rows = spark.range(2000).select((F.col("id") % 1990).cast("string").alias("id"), F.lit("x").alias("text"), (F.col("id") % 7).alias("ingest_seq"))
    kept = tables.last_write(rows)
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.count("FileScan") == 2 and "hashpartitioning" not in text
    got = {r.id: r.ingest_seq for r in kept.collect()}
    assert len(got) == kept.count() == 1990
    assert all(got[str(n)] == max(n % 7, (n + 1990) % 7) for n in range(10))


def test_ingest_only_into_an_empty_table(spark, landed, tmp_path):
    path = str(tmp_path / "table")
    assert tables.ingest_if_empty(spark, landed, path).count() == 3
    (tmp_path / "landed" / "b.csv").write_text(PLAIN.replace("1772", "9999"))
    assert tables.ingest_if_empty(spark, landed, path).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    drops, table = tmp_path / "drops", str(tmp_path / "table")
    mart_path, progress = str(tmp_path / "mart"), str(tmp_path / "progress")
    drops.mkdir()
    (drops / "1.csv").write_text(PLAIN)

    def run():
        incremental_sync(spark, str(drops), table, progress, mart_path).awaitTermination()

    run()
    first = tables.read_lots(spark, table).count()
    (drops / "2.csv").write_text(ALIASED)
    (drops / "3.csv").write_text(PLAIN.replace("187,60", "190,60"))
    run()
    run()
    got = tables.read_lots(spark, table)
    assert (first, got.count()) == (2, 3)
    assert got.filter("slug_id = 1772 and species = 'Sheep'").first().avg_price_e4 == 1_900_000
    batch = daily_mart(got)
    stored = spark.read.schema(batch.schema).parquet(mart_path).select(*batch.columns)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, batch.collect()))


def test_stream_replacing_whole_reports(spark, tmp_path):
    drops, table, progress = tmp_path / "drops", str(tmp_path / "table"), str(tmp_path / "progress")
    drops.mkdir()
    (drops / "1.csv").write_text(PLAIN)
    incremental_sync(spark, str(drops), table, progress, whole_reports=True).awaitTermination()
    header, *rows = PLAIN.split("\n1772,02/16/2026")
    (drops / "2.csv").write_text(header + "\n1772,02/16/2026" + rows[1])
    incremental_sync(spark, str(drops), table, progress, whole_reports=True).awaitTermination()
    ids = sorted(r.id for r in tables.read_lots(spark, table).collect())
    assert ids == ["1772-02-09-2026-0001", "1772-02-16-2026-0002"]


def test_schema_profile(spark, landed):
    rows = {r.column_name: r for r in schema_profile(reports.scan_by_header(spark, landed)).collect()}
    assert (rows["slug_id"].files, rows["slug_id"].total_files, rows["slug_id"].dtype) == (2, 2, "int64")
    assert (rows["avg_price"].dtype, rows["avg_price"].files) == ("float64", 1)
    assert rows["avg_price"].duplicate_note == "Also appears as: wtd_Avg_Price"
    assert rows["slug_id"].sample_values == "1772 | 2922" and rows["slug_id"].slug_ids == "1772, 2922"
    assert rows["wtd_avg_wt"].sample_values == "130.0"


def test_raw_row_helper_covers_every_text_column(spark):
    assert set(raw_row()) <= set(reports.S.KNOWN_RAW_COLUMNS)


def test_parts_of_a_report_are_numbered_through(spark, tmp_path):
    rows = spark.createDataFrame(
        [("7", "02/09/2026", "Kids", "Goats", "Per Cwt", str(100 + i), "60") for i in range(10)],
        "slug_id string, report_date string, class string, category string, price_unit string, avg_price string, avg_weight string",
    )
    path = str(tmp_path / "landed")
    reports.write_reports(rows, path, max_rows_per_file=4)
    stored = tables.ingest_if_empty(spark, path, str(tmp_path / "table"))
    assert stored.count() == 10 and stored.select("id").distinct().count() == 10
    reports.write_reports(rows, path, max_rows_per_file=3)  # replaces the files
    assert reports.scan_reports(spark, path).count() == 10


def test_newest_fetch_in_one_batch_counts(spark, tmp_path):
    import os

    drops, table = tmp_path / "drops", str(tmp_path / "table")
    drops.mkdir()
    (drops / "new.csv").write_text(PLAIN.replace("187,60", "190,60"))
    (drops / "old.csv").write_text(PLAIN)
    os.utime(drops / "old.csv", (1_700_000_000, 1_700_000_000))
    incremental_sync(spark, str(drops), table, str(tmp_path / "progress")).awaitTermination()
    got = tables.read_lots(spark, table)
    assert got.count() == 2 and got.filter("species = 'Sheep'").first().avg_price_e4 == 1_900_000


def test_late_files_are_read(spark, tmp_path):
    import os

    drops, table = tmp_path / "drops", str(tmp_path / "table")
    drops.mkdir()
    for name in ("1.csv", "2.csv"):
        (drops / name).write_text(PLAIN if name == "1.csv" else ALIASED)
        if name == "2.csv":
            os.utime(drops / name, (1_600_000_000, 1_600_000_000))
        incremental_sync(spark, str(drops), table, str(tmp_path / "progress")).awaitTermination()
    assert tables.read_lots(spark, table).count() == 3


def test_a_corrected_date_moves_the_lot(spark, tmp_path):
    path = str(tmp_path / "lots")
    first = lot_frame(spark, {"id": "a", "report_date": "2026-01-05"}, {"id": "b", "report_date": "2026-03-05"})
    tables.upsert_lots(spark, path, first.withColumn("ingest_seq", F.lit(0).cast("bigint")))
    moved = lot_frame(spark, {"id": "a", "report_date": "2026-02-05"}).withColumn("ingest_seq", F.lit(1).cast("bigint"))
    months = tables.upsert_lots(spark, path, moved)
    assert set(months) == {"2026-01", "2026-02"}
    assert sorted((r.id, r.report_month) for r in tables.read_lots(spark, path).collect()) == [("a", "2026-02"), ("b", "2026-03")]


def test_old_months_go(spark, tmp_path):
    from paddock.streaming.sync import drop_old_months

    path = str(tmp_path / "lots")
    tables.write_lots(lot_frame(spark, {"report_date": "2025-01-05"}, {"report_date": "2026-02-05"}), path)
    assert drop_old_months(spark, path, "2026-02-15", 100) == ["2025-01"]
    assert [r.report_month for r in tables.read_lots(spark, path).collect()] == ["2026-02"]


def test_unreadable_and_pretty_printed_payloads(spark, tmp_path):
    whole = json.dumps({"results": [{"slug_id": 7, "brand_new": "x"}]}, indent=2)
    (tmp_path / "pretty.json").write_text(whole)
    (tmp_path / "cut.json").write_text(whole[:20])
    frame = payloads.scan_payloads(spark, str(tmp_path), whole_files=True)
    assert tuple(payloads.unreadable_payloads(frame).first()) == (2, 1)
    row = payloads.flatten_sections(frame).first()
    assert row.slug_id == "7" and row.other_keys == {"brand_new": "x"}


def test_huge_numbers_keep_their_lots(spark):
    from helpers import raw_frame

    rows = raw_frame(spark, raw_row(avg_price="1e10"), raw_row(avg_price="5000000", avg_weight="1000000"), raw_row(avg_price="1e300"))
    lots = {r.id: r for r in normalise(rows).collect()}
    assert lots["0"].avg_price_e4 == 10**14 and lots["1"].price_per_lb_e4 == 5 * 10**8
    assert len(lots) == 3 and lots["2"].avg_price_e4 is None


def test_day_only_publication(spark):
    from helpers import raw_frame

    rows = raw_frame(spark, raw_row(published_date="2026-02-09"), raw_row(published_date="02/09/2026 18:47:05"))
    got = {r.id: r.published_date for r in public_lots(normalise(rows)).collect()}
    assert got == {"0": "2026-02-09", "1": "2026-02-09T18:47:05"}


def test_file_locations(tmp_path, spark):
    from paddock.sources.files import arrow_location

    assert arrow_location("/a b/c.csv") == ("local", "/a b/c.csv")
    assert arrow_location("file:/a b/c.csv") == arrow_location("file:///a b/c.csv") == ("local", "/a b/c.csv")
    assert arrow_location("file:/a%20b", encoded=True) == ("local", "/a b")
    assert arrow_location("s3a://bucket/a b") == ("uri", "s3://bucket/a%20b")
    assert arrow_location("hdfs://host:8020/x") == ("uri", "hdfs://host:8020/x")
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "m.csv").write_text("slug_id\n1\n")
    assert reports.report_headers(spark, str(folder)).first()["header"] == ["slug_id"]


def test_work_folder(spark, tmp_path, monkeypatch):
    import os

    from paddock import session

    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Bare, "x")
    base = spark.conf.get("spark.checkpoint.dir")
    kept = set(os.listdir(f"{base}/paddock")) if os.path.isdir(f"{base}/paddock") else set()
    lots = lot_frame(spark, {"id": "a"}).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    tables.upsert_lots(spark, str(tmp_path / "lots"), lots)
    assert set(os.listdir(f"{base}/paddock")) <= kept


def test_many_files_are_landed_by_header(spark, tmp_path):
    """The driver gets one row for each header; landing again copies nothing; parts stay one fetch."""
    source, landing = tmp_path / "in", tmp_path / "landing"
    rows = spark.createDataFrame([("7", f"02/{1 + i % 9:02d}/2026", str(i)) for i in range(90)], "slug_id string, report_date string, avg_price string")
    reports.write_reports(rows, str(source / "parts"), max_rows_per_file=2)
    (source / "alone").mkdir()
    for i in range(40):
        (source / "alone" / f"{i}.csv").write_text(("slug_id,wtd_Avg_Price" if i % 2 else "wtd_Avg_Price,slug_id") + f"\n{i},{i}\n")
    (source / "alone" / "empty.csv").write_text("")
    for _ in range(2):
        reports.land_by_header(spark, str(source), str(landing))
    assert spark.read.json(str(landing / "headers")).count() == 3
    files = [path for path in (landing / "files").rglob("*.csv")]
    assert len(files) == len(list(source.rglob("*.csv"))) - 1
    assert not [path for path in (landing / "files").rglob("_*")]
    got = reports.with_source_row(reports.scan_landed(spark, str(landing)))
    want = reports.with_source_row(reports.scan_reports(spark, str(source)))
    shown = ["slug_id", "report_date", "avg_price"]
    assert sorted(map(repr, got.select(*shown).collect())) == sorted(map(repr, want.select(*shown).collect()))
    part = got.where("report_date is not null")
    assert part.select("fetch").distinct().count() == 1
    assert sorted(r.source_row for r in part.collect()) == list(range(90))
    stamps = {round(path.stat().st_mtime * 1000) for path in (source / "alone").glob("*.csv")}
    alone = got.where("report_date is null").selectExpr("unix_millis(fetched_at) as at").distinct().collect()
    assert {r.at for r in alone} <= {s + d for s in stamps for d in (-1, 0, 1)}


def test_dealt_rows_are_the_same_rows(spark):
    """Of all types, with null keys; what goes to one bucket is packed, and a key stays in one task."""
    from paddock.plans.dealt import _pack, _unpack, dealt

    rows = spark.range(5_000).selectExpr(
        "id", "if(id % 11 = 0, null, cast(id % 37 as string)) as `Key`", "cast(id as double) / 7 as key2", "id % 2 = 0 as even",
        "date_add(date'2026-01-01', cast(id % 90 as int)) as day", "if(id % 3 = 0, null, 'two\nlines \u00e9') as text",
        "cast('2026-01-01 01:02:03.000004' as timestamp_ntz) as at", "cast('2026-01-01 01:02:03' as timestamp) as stamp",
    ).repartition(3)
    out = dealt(rows, "Key")
    assert out.columns == rows.columns and [f.dataType for f in out.schema] == [f.dataType for f in rows.schema]
    assert out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty()
    tasks = [row["Key"] for row in out.select("Key", F.spark_partition_id().alias("task")).distinct().collect()]
    assert len(tasks) == len(set(tasks)) == 38 and dealt(rows.limit(0), "Key").isEmpty()
    batches = rows.withColumn("__bucket", F.lit(0)).toArrow().to_batches()
    packed = list(_pack(iter(batches)))
    assert sum(batch.nbytes for batch in packed) * 3 < sum(batch.nbytes for batch in batches)
    assert sum(batch.num_rows for batch in _unpack(iter(packed))) == 5_000


def test_written_reports_are_packed_and_landed_as_they_are(spark, tmp_path):
    source, landing = tmp_path / "in", tmp_path / "landing"
    rows = spark.createDataFrame([(str(i % 3), "02/09/2026", f'say "{i}",\nx') for i in range(60)], "slug_id string, report_date string, class string")
    reports.write_reports(rows, str(source), max_rows_per_file=7)
    files = [path for path in source.rglob("part-*")]
    assert files and all(path.name.endswith(".csv.gz") and path.read_bytes()[:2] == b"\x1f\x8b" for path in files)
    assert {tuple(row.header) for row in reports.report_headers(spark, str(source)).collect()} == {tuple(rows.columns)}
    reports.land_by_header(spark, str(source), str(landing))
    assert sorted(p.read_bytes() for p in (landing / "files").rglob("part-*")) == sorted(p.read_bytes() for p in files)
    for back in (reports.scan_landed(spark, str(landing)), reports.scan_reports(spark, str(source))):
        assert sorted(map(repr, back.select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))


def test_small_report_files_are_written_by_tasks_and_put_in_place(spark, tmp_path):
    texts = [None, "x", " padded\t", 'say "x", y', "two\nlines", "1"]
    rows = spark.createDataFrame(
        [(report, f"{i}", texts[i % 6]) for i in range(40) for report in ("1", "a/b=c", None)],
        "slug_id string, class string, report_narrative string",
    )
    path = tmp_path / "out"
    assert reports.write_reports(rows, str(path), max_rows_per_file=3).get["rows"] == 120
    folders = sorted(place.name for place in path.iterdir())
    assert folders == ["report=1", "report=__HIVE_DEFAULT_PARTITION__", "report=a%2Fb%3Dc"]
    # Left by a task that was lost: it goes when the report is written again, other reports stay.
    (path / "report=1" / "_lost").write_text("x")
    reports.write_reports(rows.where("slug_id = '1'"), str(path), max_rows_per_file=50)
    files = [file for file in path.rglob("*") if file.is_file()]
    # Spark's own writer leaves a checksum beside each file on a local disk.
    assert all(file.name.startswith("part-") and file.name.endswith(".csv.gz") for file in files)
    assert sum(file.parent.name == "report=1" for file in files) <= 2 < len(files)
    back = reports.scan_reports(spark, str(path)).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_raw_rows_are_kept_only_where_asked(spark, landed, tmp_path):
    from pathlib import Path

    scratch = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "paddock"
    before = set(scratch.glob("bronze-*"))
    tables.ingest_if_empty(spark, str(landed), str(tmp_path / "lots"))
    incremental_sync(spark, str(landed), str(tmp_path / "synced"), str(tmp_path / "progress")).awaitTermination()
    assert set(scratch.glob("bronze-*")) == before
    tables.ingest_if_empty(spark, str(landed), str(tmp_path / "kept"), bronze_path=str(tmp_path / "bronze"))
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 5


ODD = {
    "plain": 'slug_id,a,b\n1,x,"two\nlines"\n\n2,"say ""x"", y",\n3,"", z \n',
    "crlf": 'slug_id,a,b\r\n1,x,"two\r\nlines"\r\n\r\n2,y,"one\nend"\r\n',
    "widths": 'slug_id,a,b\n1\n2,x,y,z\n,,\n3,x',
    "quotes": 'slug_id,a,b\n1,"q"z,y"y\n2,"q" ,"""q"""\n3,"never, closed\n4,x\n',
    "return": 'slug_id,a,b\n1,x\ry,z\n2,x,y\r\n',
    "bytes": b'slug_id,a,b\n1,caf\xe9,"\xc3\xa9"\n',
    "marked": b'\xef\xbb\xbfslug_id,a,b\n1,x,y\n',
    "header": 'slug_id,a,b\n',
}


def odd_files(folder):
    folder.mkdir()
    for name, text in ODD.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    (folder / "_hidden.csv").write_text("slug_id,a,b\n1,x,y\n")
    return str(folder)


@pytest.mark.parametrize("piece", [9, 8 << 20])
def test_files_are_read_as_sparks_reader_does(spark, tmp_path, monkeypatch, piece):
    from paddock.sources import csv_rows

    folder = odd_files(tmp_path / "odd files")
    options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
    wanted = spark.read.schema("slug_id string, a string, b string").options(**options).csv(folder)
    wanted = wanted.selectExpr("_metadata.file_path as source_file", "slug_id", "a", "b")
    wanted = {(r.source_file, r.slug_id, r.a, r.b) for r in wanted.collect()}
    got = reports.scan_reports(spark, folder)
    assert {(r.source_file, r.slug_id, r.a, r.b) for r in got.collect()} == wanted
    monkeypatch.setattr(csv_rows, "PIECE", piece)
    found = set()
    for name in ODD:
        rows = [row for batch in csv_rows.file_rows(f"{folder}/{name}.csv", 3) for row in batch.to_pylist()]
        found |= {(f"file:{tmp_path}/odd%20files/{name}.csv", r["c0"], r["c1"], r["c2"]) for r in rows}
    assert found == wanted


def test_names_of_files_stay_in_tasks(spark, tmp_path):
    """Neither the plan of a scan nor the driver holds a name for each file."""
    rows = spark.createDataFrame([(str(i % 30), f"{i}") for i in range(900)], "slug_id string, class string")
    reports.write_reports(rows, str(tmp_path / "in"), max_rows_per_file=2)
    raw = reports.scan_reports(spark, str(tmp_path / "in"))
    assert len(raw.inputFiles()) < 50 and raw.select("source_file").distinct().count() >= 450
    places = reports.with_source_row(raw).groupBy("fetch").agg(F.max("source_row").alias("last"), F.count_distinct("source_row").alias("n"))
    assert [(r["last"], r["n"]) for r in places.collect()] == [(29, 30)] * 30


def test_a_large_fetch_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "FETCH_BYTES", 0)
    rows = spark.createDataFrame([("7", f"{i}") for i in range(100)], "slug_id string, class string")
    reports.write_reports(rows, str(tmp_path / "in"), max_rows_per_file=9)
    raw = reports.scan_reports(spark, str(tmp_path / "in"))
    assert raw.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.source_row for r in raw.collect()) == list(range(100))


def test_folders_are_listed_as_by_spark(spark, tmp_path):
    for name in ("a/report=1/x.csv", "a/_left/x.csv", "a/.x.csv", "a/x.csv.gz", "a/x.txt", "b/c/d/e/x y%20.csv", "x._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    from paddock.sources.files import list_files

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", reports.REPORT_FILES)
    for path in (str(tmp_path), f"{tmp_path}/*/", [f"{tmp_path}/a", f"file:{tmp_path}/b/c/d/e/x y%20.csv"]):
        want = reader.load(path).selectExpr("path", "length", "unix_millis(modificationTime) as stamp")
        got = list_files(spark, path, reports.REPORT_FILES)
        assert sorted(got.collect()) == sorted(want.collect()) and not got.isEmpty()
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"{tmp_path}/none", "*.csv")


def test_raw_rows_are_written_by_the_tasks_that_read_them(spark, tmp_path):
    """The same rows as a scan gives, of several headers, both spellings of a column in one of them."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(PLAIN)
    (folder / "b.csv").write_text(ALIASED)
    (folder / "c.csv").write_text("price_min,slug_id,avg_price_min\n1,7,2\n3,7,\n")
    (folder / "d.csv").write_text("class\n")
    want = reports.scan_reports(spark, str(folder))
    path = str(tmp_path / "raw")
    for _ in range(2):
        got = reports.store_rows(spark, reports.report_files(spark, str(folder)), path)
    assert set(got.columns) == set(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert [r.avg_price_min for r in got.where("slug_id = 7").orderBy("source_row").collect()] == ["2", "3"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert reports.store_rows(spark, reports.report_files(spark, str(tmp_path / "none")), str(tmp_path / "no")) is None
