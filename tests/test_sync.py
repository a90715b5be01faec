"""The sync: which fetch counts, retention, and the mart kept by changes."""

import os
import time

import pytest
from helpers import lot_frame

from paddock.operators.filters import date_window
from paddock.plans import mart, mart_changes
from paddock.session import store
from paddock.sources import ledger, tables
from paddock.sources.reports import scan_reports, with_source_row
from paddock.streaming.sync import MartStep, incremental_sync



def columns(names, *rows):
    return "\n".join([names, *rows]) + "\n"


NAMES = "slug_id,report_date,class,category,commodity,price_unit,avg_price,avg_weight,head_count,final_ind"


def row(slug="7", day="02/09/2026", kind="Kids", price="200", status="Final"):
    return f"{slug},{day},{kind},Goats,Slaughter Goats,Per Cwt,{price},60,2,{status}"


class Landing:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.table, self.mart, self.progress = (str(folder / name) for name in ("table", "mart", "progress"))
        (folder / "drops").mkdir()

    def run(self, name, text, age_days=0, **options):
        path = self.folder / "drops" / f"{name}.csv"
        path.write_text(text)
        if age_days:
            stamp = path.stat().st_mtime - age_days * 86_400
            os.utime(path, (stamp, stamp))
        return self.again(**options)

    def again(self, **options):
        incremental_sync(
            self.spark, str(self.folder / "drops"), self.table, self.progress, self.mart, **options
        ).awaitTermination()
        return sorted(r.avg_price_e4 // 10_000 for r in tables.read_lots(self.spark, self.table).collect())

    def check_mart(self):
        lots = tables.read_lots(self.spark, self.table)
        want = mart.mart_state(lots)
        got = mart.read_mart(self.spark, self.mart).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def test_an_older_fetch_does_not_replace_a_newer_one(landing):
    assert landing.run("new", columns(NAMES, row(price="1"), row(price="2"), row(price="3"))) == [1, 2, 3]
    assert landing.run("old", columns(NAMES, row(price="9"), row(day="02/16/2026", price="8")), 30) == [1, 2, 3, 8]
    assert landing.run("newest", columns(NAMES, row(price="4"))) == [4, 8]
    landing.check_mart()
    stored = {r.report_key: r.fetch for r in ledger.read_ledger(landing.spark, landing.table).collect()}
    assert set(stored) == {"7|2026-02-09", "7|2026-02-16"}
    assert stored["7|2026-02-09"].endswith("newest.csv") and stored["7|2026-02-16"].endswith("old.csv")


def test_preliminary_does_not_replace_final(landing):
    assert landing.run("a", columns(NAMES, row(price="1", status="Preliminary")), final_only=True) == [1]
    both = columns(NAMES, row(price="2"), row(price="3", status="Preliminary"))
    assert landing.run("b", both, final_only=True) == [2]
    assert landing.run("c", columns(NAMES, row(price="4", status="Preliminary")), final_only=True) == [2]
    assert landing.run("d", columns(NAMES, row(price="5")), 30, final_only=True) == [2]
    assert landing.run("e", columns(NAMES, row(price="6")), final_only=True) == [6]
    landing.check_mart()


def test_unreadable_dates_are_compared_as_text(landing):
    assert landing.run("a", columns(NAMES, *[row(day="week one", price=str(i)) for i in range(4)])) == [0, 1, 2, 3]
    assert landing.run("b", columns(NAMES, *[row(day="week two", price=str(i)) for i in range(5, 8)])) == [0, 1, 2, 3, 5, 6, 7]
    assert landing.run("c", columns(NAMES, row(day="week one", price="9"))) == [5, 6, 7, 9]
    assert landing.run("d", columns(NAMES, row(day="", price="10"), row(slug="x7", day="", price="11"))) == [5, 6, 7, 9, 10, 11]
    landing.check_mart()


def test_files_without_ids_never_replace_each_other(landing):
    names = NAMES.replace("slug_id,", "")
    rows = [columns(names, row(price=str(i)).replace("7,", "", 1)) for i in range(3)]
    assert landing.run("a", rows[0]) == [0]
    assert landing.run("b", rows[1]) == [0, 1]
    assert landing.run("c", columns("category,price_unit,avg_price", "Goats,Per Cwt,5")) == [0, 1, 5]
    landing.check_mart()
    lots = tables.read_lots(landing.spark, landing.table)
    assert {r.report_key.split("|")[1] for r in lots.collect()} == {"2026-02-09", ""}


def test_a_folder_without_ids_is_ingested(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("category,price_unit,avg_price\nGoats,Per Cwt,5\nSheep,Per Cwt,6\n")
    assert tables.ingest_if_empty(spark, str(tmp_path / "in"), str(tmp_path / "table")).count() == 2


def test_retention_to_the_day(landing):
    days = ["10/01/2025", "11/06/2025", "11/07/2025", "11/08/2025", "02/15/2026", "no day"]
    text = columns(NAMES, *[row(slug=str(i), day=day, price=str(i)) for i, day in enumerate(days)])
    assert landing.run("a", text) == [0, 1, 2, 3, 4, 5]
    late = columns(NAMES, row(slug="8", day="11/06/2025", price="8"), row(slug="9", day="11/07/2025", price="9"))
    assert landing.run("b", late, keep_days=100, as_of="2026-02-15") == [2, 3, 4, 5, 9]
    landing.check_mart()
    lots = tables.read_lots(landing.spark, landing.table)
    assert lots.filter("report_date is not null").count() == date_window(lots, "2026-02-15", 100).count() == 4
    # Time passes without a new file.
    assert landing.again(keep_days=100, as_of="2026-05-27") == [5]
    landing.check_mart()
    assert {r.report_key for r in ledger.read_ledger(landing.spark, landing.table).collect()} == {"5|no day"}


def test_a_report_that_loses_all_its_lots(landing):
    assert landing.run("a", columns(NAMES, row(price="1"), row(slug="8", price="2"))) == [1, 2]
    assert landing.run("b", columns(NAMES, row(price=""))) == [2]
    assert landing.run("c", columns(NAMES, row(price="", slug="8"))) == []
    assert mart.read_mart(landing.spark, landing.mart).count() == 0


# --- the mart by changes ---

BASE = [
    {"id": "a", "price_per_lb_e4": 100, "head_count": 2}, {"id": "b", "price_per_lb_e4": 200, "head_count": 0},
    {"id": "c", "price_per_lb_e4": 300, "head_count": None, "slug_id": 2},
    {"id": "d", "price_per_lb_e4": None, "slug_id": 2}, {"id": "e", "animal_class": None, "slug_id": 2},
    {"id": "f", "report_date": None, "slug_id": 3}, {"id": "g", "report_date": "2026-01-05", "price_per_head_e4": 7, "slug_id": 4},
]


def changed(spark, tmp_path, before, came, went):
    path = str(tmp_path / "mart")
    mart.write_mart(lot_frame(spark, *before), path)
    after = [r for r in before if r["id"] not in {w["id"] for w in went}] + came
    changes = tables.store(
        mart_changes.lot_changes(lot_frame(spark, *came), lot_frame(spark, *went) if went else None), "changes"
    )
    rows = tables.store(mart_changes.changed_rows(mart.read_mart(spark, path), changes), "rows")
    months = set(mart_changes.touched_months(changes))
    lots = lot_frame(spark, *after)
    got = mart_changes.changed_mart(rows, lots)
    want = mart.mart_state(lots).select(*got.columns)
    want = [r for r in want.collect() if r.report_month in months]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    return rows.where("anew").count()


@pytest.mark.parametrize(
    "went, came, anew",
    [
        ([], [{"id": "h", "price_per_lb_e4": 50}], 0),
        (["b"], [], 0),
        (["a"], [], 1),
        (["c"], [], 1),
        (["a"], [{"id": "h", "price_per_lb_e4": 90}], 0),
        (["a"], [{"id": "h", "price_per_lb_e4": 110}], 1),
        (["a", "b", "c"], [], 0),
        (["d", "e", "f"], [], 0),
        (["g"], [{"id": "g", "report_date": "2026-01-05", "price_per_head_e4": 7, "slug_id": 4}], 0),
        (["g", "f"], [{"id": "x", "report_date": "2025-12-31"}], 0),
    ],
)
def test_changes_equal_the_whole_mart(spark, tmp_path, went, came, anew):
    assert changed(spark, tmp_path, BASE, came, [r for r in BASE if r["id"] in went]) == anew


def test_sums_beyond_whole_numbers_are_made_anew(spark, tmp_path):
    wild = {"id": "w", "price_per_lb_e4": 2**40, "head_count": 2**22}
    wilder = {"id": "v", "price_per_lb_e4": 2**40, "head_count": 2**22}
    assert changed(spark, tmp_path, [*BASE, wild, wilder], [], [wild]) >= 1


def test_only_touched_days_are_asked_for(spark, tmp_path):
    lots_path = str(tmp_path / "lots")
    days = ["2026-01-05", "2026-02-09", "2026-02-10", "2026-03-02"]
    lots = [{"id": f"{day}{i}", "report_date": day, "price_per_lb_e4": 100 + i} for day in days for i in range(3)]
    tables.write_lots(lot_frame(spark, *lots), lots_path)
    stored = tables.read_lots(spark, lots_path)
    rows = mart.mart_state(stored.where("report_date = date '2026-02-09'"))
    text = mart_changes.made_anew(stored, rows)._jdf.queryExecution().executedPlan().toString()
    assert "report_month" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "2026-02-09" in text and "2026-02-10" not in text and "2026-01" not in text
    assert "NestedLoop" not in text and "narrative" not in text


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    """Losses after every step: what was written down is used, no change counts twice."""
    table, mart_path = str(tmp_path / "lots"), str(tmp_path / "mart")
    tables.write_lots(lot_frame(spark, *BASE), table)
    mart.write_mart(tables.read_lots(spark, table), mart_path)
    came = lot_frame(spark, {"id": "n", "price_per_lb_e4": 500}, {"id": "m", "price_per_lb_e4": 5, "slug_id": 9})

    class Lost(Exception):
        pass

    class Failing(MartStep):
        def apply(self, lots):
            raise Lost

    def attempt(kind):
        step = kind(spark, mart_path, str(tmp_path / "step"))
        tables.replace_reports(spark, table, came, None, step.note_changes)
        step.apply(tables.read_lots(spark, table))

    for _ in range(2):
        with pytest.raises(Lost):
            attempt(Failing)
    attempt(MartStep)
    attempt(MartStep)
    lots = tables.read_lots(spark, table)
    want = mart.mart_state(lots)
    got = mart.read_mart(spark, mart_path).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.id for r in lots.collect()} == {"c", "d", "e", "f", "g", "n", "m"}


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().iterator()
    names = []
    while blocks.hasNext():
        names.append(str(blocks.next()))
    return {name for name in names if name.startswith("shuffle")}


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    """A driver that seldom clears its memory would keep those of a whole sync."""
    lots = lot_frame(spark, *[{"id": f"{i}", "slug_id": i, "report_key": f"{i}|2026-02-09"} for i in range(40)])
    before, wait = shuffle_files(spark), 0
    tables.write_lots(lots, str(tmp_path / "table"))
    store(lots.groupBy("slug_id").count(), "counts", str(tmp_path / "counts"))
    mart.write_mart(lots, str(tmp_path / "mart"))
    left = shuffle_files(spark) - before
    while left and wait < 50:
        time.sleep(0.1)
        left, wait = left & shuffle_files(spark), wait + 1
    assert not left


def test_the_fetch_of_a_file_is_found_once_a_file(spark, tmp_path):
    """Parts that one job wrote are numbered through, in order of their names; other files apart."""
    job = "0ee96b36-a004-440d-915e-6d20d4520570"
    for name, prices in ((f"part-00000-{job}.c0.csv", "123"), (f"part-00001-{job}.c0.csv", "45"), ("x.csv", "67")):
        (tmp_path / name).write_text(columns(NAMES, *[row(price=price) for price in prices]))
    raw = with_source_row(scan_reports(spark, str(tmp_path)))
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
    got = {(r.fetch.rpartition("/")[2], r.avg_price): r.source_row for r in raw.collect()}
    assert got == {(job, "1"): 0, (job, "2"): 1, (job, "3"): 2, (job, "4"): 3, (job, "5"): 4, ("x.csv", "6"): 0, ("x.csv", "7"): 1}


def test_fetches_of_days_that_are_not_kept_are_not_listed(landing):
    """The list says which fetch the table holds; without lots of that day it holds none."""
    text = columns(NAMES, row(day="02/09/2026", price="1"), row(day="02/09/2025", price="2"), row(day="soon", price="3"))
    assert landing.run("a", text, keep_days=100, as_of="2026-02-10") == [1, 3]
    listed = {r.report_key for r in ledger.read_ledger(landing.spark, landing.table).collect()}
    assert listed == {"7|2026-02-09", "7|soon"}
    assert landing.run("b", columns(NAMES, row(day="02/09/2025", price="4")), keep_days=1000, as_of="2026-02-10") == [1, 3, 4]
    landing.check_mart()


def test_months_are_written_by_tasks_in_order(spark, tmp_path):
    """What replaces a month may be read from it; files are in order and hold no hidden leftovers."""
    from pyspark.sql import functions as F

    draw = [{"id": f"{i}", "report_date": f"2026-0{1 + i % 3}-05" if i % 4 else None, "species": ["Sheep", None, "Goats"][i % 3],
             "report_month": f"2026-0{1 + i % 3}" if i % 4 else None, "avg_weight": (i * 7) % 50} for i in range(200)]
    path, lots = tmp_path / "table", lot_frame(spark, *draw)
    assert set(tables.write_lots(lots, str(path))) == {"2026-01", "2026-02", "2026-03", None}
    stored = tables.read_lots(spark, str(path))
    assert stored.exceptAll(lots).isEmpty() and lots.exceptAll(stored).isEmpty()
    january = stored.where("report_month = '2026-01'").withColumn("head_count", F.lit(5).cast("bigint"))
    held = january.count()
    assert tables.write_lots(january, str(path)) == ["2026-01"]
    tables.write_lots(tables.read_lots(spark, str(path)).where("head_count = 5").limit(1), str(path), add=True)
    again = tables.read_lots(spark, str(path))
    assert again.count() == 201 and again.where("head_count = 5").count() == held + 1
    files = [file.name for file in path.rglob("*") if file.is_file()]
    assert files and all(name.startswith("part-") for name in files)
    for file in path.rglob("part-*"):
        rows = [(r.species or "", r.avg_weight) for r in spark.read.parquet(str(file)).collect()]
        assert rows == sorted(rows)
