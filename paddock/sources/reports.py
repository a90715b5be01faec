"""Report files: CSV whose columns differ from file to file.

Files are grouped by their header first and each group is scanned with its own names.  The
number of scans follows the number of different headers, not of files; tasks list, open and
read the files, whose names never come to the driver.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv  # noqa: F401  (pa.csv)
import pyarrow.fs  # noqa: F401  (pa.fs)
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from .. import schema as S
from ..functions.dates import parse_date, report_month
from ..functions.text import coerce_numeric, null_tokens, strip, to_int_trunc
from ..operators.normalise import alias_sources, report_key, union_reports
from ..plans.dealt import packed, unpacked
from ..session import advisory_size, discard, scratch_path, ship_package, shuffles_let_go, store
from .csv_rows import count_rows, rows_of_files, rows_written, shown
from .files import file_tasks, list_files, open_location, uri_name

LINEAGE = ("source_file", "fetch", "source_row", "fetched_at")
FILES = "path string, length bigint, stamp bigint, header array<string>, source_file string, fetch string"
# Files that one Spark job wrote share its id in their names.
PART_OF = r"^(.*/)part-[0-9]+-([0-9a-f-]{36})[^/]*$"
# Landed files lie in a folder that tells when they were fetched, in milliseconds.
FETCHED_AT = r"/fetched=([0-9]+)/"
CHUNK = 8 << 20
# A task reads about so many files, or bytes, most of them packed; a larger fetch is read by several.
TASK_FILES, TASK_BYTES, FETCH_BYTES = 2_000, 4 << 20, 8 << 20
# Signs that Spark does not leave in the name of a partition's folder.
UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
# Packed rows that a task writes as files: some 30 MB of text.
PACKED_BYTES = 4 << 20
# So much text of a task is put in order of its reports at a time.
WRITTEN_BYTES = 128 << 20
# Report files as they are fetched, and packed as ``write_reports`` leaves them.
REPORT_FILES = "*.{csv,csv.gz}"


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First CSV record of each file, and its fetch; opens the file, reads no more than its start."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        headers, names, fetches = [], [], []
        for path in batch["path"].to_pylist():
            system, inner = open_location(path)
            with system.open_input_stream(inner, buffer_size=65_536) as stream:
                text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
                headers.append(next(csv.reader(text), []))
            names.append(uri_name(path))
            # Parts of a landed fetch were written moments apart.
            part = re.match(PART_OF, re.sub(FETCHED_AT, "/", names[-1]))
            fetches.append(part.group(1) + part.group(2) if part else names[-1])
        added = [pa.array(headers, pa.list_(pa.string())), pa.array(names, pa.string()), pa.array(fetches, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "header", "source_file", "fetch"])


def report_files(
    spark: SparkSession, path: str | Sequence[str], pattern: str = REPORT_FILES, store_at: str | None = None
) -> DataFrame:
    """Every report file below ``path`` with its header and its fetch, found once and stored.

    A ``fetch`` is a file, or all files that one job wrote into one folder: the parts of a
    large report are numbered through.
    """
    files = list_files(spark, path, pattern).mapInArrow(_read_headers, FILES)
    return store(files, "report-files", store_at)


def report_headers(spark: SparkSession, path: str | Sequence[str], pattern: str = REPORT_FILES) -> DataFrame:
    """``path, header`` of every report file below ``path``."""
    return list_files(spark, path, pattern).mapInArrow(_read_headers, FILES).select("path", "header")


def _with_bases(files: DataFrame) -> DataFrame:
    """Files with the rows before them in their fetch, where one task is not to read the whole fetch.

    Those of fetches that are large, or whose files differ in their headers: their rows are
    counted first.  Others have no ``base`` and are numbered as they are read.
    """
    sizes = files.groupBy("fetch").agg(F.sum("length").alias("bytes"), F.count_distinct("header").alias("headers"))
    apart = sizes.where((F.col("bytes") > FETCH_BYTES) | (F.col("headers") > 1)).select("fetch")
    apart = apart.join(files, "fetch").select("fetch", "path", F.size("header").alias("width"))
    if apart.isEmpty():
        return files.withColumn("base", F.lit(None).cast("bigint"))
    dealt_out = apart.repartition(file_tasks(files.sparkSession), "path")
    counted = dealt_out.select("path", "width").mapInArrow(count_rows, "path string, rows bigint").join(apart, "path")
    earlier = Window.partitionBy("fetch").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("path", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    return files.join(store(bases, "bases"), "path", "left")


def _tasks_of_headers(spark: SparkSession, files: DataFrame) -> list[tuple[tuple[str, ...], DataFrame]]:
    """Each different header and its files, dealt to the tasks that are to read them."""
    files = _with_bases(files.where(F.size("header") > 0))
    sizes = files.groupBy("header").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).collect()
    found = []
    for header, count, size in sorted((tuple(row["header"]), row["files"], row["bytes"]) for row in sizes):
        tasks = max(min(count, file_tasks(spark)), size // TASK_BYTES, count // TASK_FILES)
        those = files.where(F.col("header") == F.array(*[F.lit(name) for name in header]))
        unit = F.when(F.col("base").isNull(), F.col("fetch")).otherwise(F.col("path"))
        those = those.repartition(tasks, unit).sortWithinPartitions("fetch", "path")
        found.append((header, those.select("path", "source_file", "fetch", "stamp", "base")))
    return found


def scan_files(spark: SparkSession, files: DataFrame) -> list[DataFrame]:
    """One all-text frame per different header, under the names found in the files.

    ``files``: stored by ``report_files``.  The driver gets one row for each header and no file
    name; tasks take some files each and read them, whole fetches side by side.  A file is read
    by one task, since quoted text may hold line breaks; large reports should be landed as
    several files, as ``write_reports`` does.
    """
    frames = []
    for header, those in _tasks_of_headers(spark, files):
        places = [f"c{i}" for i in range(len(header))]
        schema = ", ".join([*[f"{place} string" for place in places], "source_file string, fetch string, source_row bigint, stamp bigint"])
        rows = those.mapInArrow(rows_of_files(len(header)), schema)
        rows = rows.withColumn("stamp", F.timestamp_millis("stamp"))
        frames.append(rows.toDF(*header, *LINEAGE))
    return frames


def store_rows(spark: SparkSession, files: DataFrame, path: str) -> DataFrame | None:
    """``with_source_row`` of all rows of ``files``, written to ``path`` by the tasks that read them.

    Nothing if there is no file with a header.  What is at ``path`` goes.
    """
    found = _tasks_of_headers(spark, files)
    if not found:
        return None
    discard(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    full, columns, written = system.makeQualified(place).toString(), {}, None
    for header, those in found:
        sources = alias_sources([*header, *LINEAGE])
        sources = {name: at for name, at in sources.items() if name not in LINEAGE}
        columns.update(dict.fromkeys(sources))
        part = those.mapInArrow(rows_written(len(header), sources, full), "hidden string")
        written = part if written is None else written.unionByName(part)
    listing = scratch_path(spark, "files")
    names = store(written, "files", listing).repartition(file_tasks(spark), "hidden")
    with shuffles_let_go(spark):
        names.mapInArrow(shown(full), "hidden string").write.format("noop").mode("overwrite").save()
    discard(spark, listing)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    for name, kind in zip(LINEAGE, (T.StringType(), T.StringType(), T.LongType(), T.TimestampType())):
        schema = schema.add(name, kind)
    return spark.read.schema(schema).parquet(path)


def scan_by_header(
    spark: SparkSession, path: str | Sequence[str], pattern: str = REPORT_FILES
) -> list[DataFrame]:
    """``scan_files`` of every report file below ``path``."""
    frames = scan_files(spark, report_files(spark, path, pattern))
    if not frames:
        raise FileNotFoundError(f"no report files matching {pattern} in {path}")
    return frames


def _copied(landing: str):
    """A task's work: put each file under its header's folder, and say which header that is.

    A copy is written under another name and then moved, so a folder holds whole files
    only; a file that is there already is left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            landed = []
            for path, stamp in zip(batch["path"], batch["stamp"]):
                system, inner = open_location(path)
                with system.open_input_stream(inner, buffer_size=65_536) as stream:
                    header = next(csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")), [])
                signature = hashlib.sha256(json.dumps(header).encode()).hexdigest()[:24]
                folder, _, name = path.rpartition("/")
                source = hashlib.sha256(folder.encode()).hexdigest()[:24]
                target, place = open_location(f"{landing}/files/{signature}/{source}/fetched={stamp}/{name}")
                if header and target.get_file_info(place).type == pa.fs.FileType.NotFound:
                    target.create_dir(place.rpartition("/")[0], recursive=True)
                    partial = f"{place.rpartition('/')[0]}/_{uuid.uuid4().hex}"
                    # As it is: by its name a packed file would be unpacked.
                    with system.open_input_stream(inner, compression=None) as stream, target.open_output_stream(partial) as copy:
                        while chunk := stream.read(CHUNK):
                            copy.write(chunk)
                    target.move(partial, place)
                landed.append((signature if header else None, json.dumps(header)))
            yield pd.DataFrame(landed, columns=["signature", "header"])

    return run


def land_by_header(spark: SparkSession, path: str | Sequence[str], landing: str, pattern: str = REPORT_FILES) -> None:
    """Copy the report files below ``path`` to ``landing``, one folder for each different header.

    Tasks list and copy the files; the driver gets one row for each header and no file name.
    Files keep the time they were fetched at; landing the same files again changes nothing.
    """
    files = list_files(spark, path, pattern).select("path", "stamp")
    landed = files.mapInPandas(_copied(landing), "signature string, header string")
    headers = landed.where("signature is not null").distinct()
    # A folder for each header's names: writing one that is there again changes nothing.
    headers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signature").json(
        f"{landing}/headers"
    )


def landed_files(spark: SparkSession, landing: str, store_at: str | None = None) -> DataFrame:
    """``report_files`` of a landing, with the times its files were fetched at."""
    files = list_files(spark, f"{landing}/files", "*").mapInArrow(_read_headers, FILES)
    stamp = F.regexp_extract("path", FETCHED_AT, 1).cast("bigint")
    return store(files.withColumn("stamp", stamp), "report-files", store_at)


def scan_landed(spark: SparkSession, landing: str) -> DataFrame:
    """``scan_reports`` of a landing."""
    frames = scan_files(spark, landed_files(spark, landing))
    if not frames:
        raise FileNotFoundError(f"no report files landed in {landing}")
    return union_reports(frames)


def scan_reports(spark: SparkSession, path: str | Sequence[str], pattern: str = REPORT_FILES) -> DataFrame:
    """Every report row as text under canonical names, with where it came from."""
    return union_reports(scan_by_header(spark, path, pattern))


def with_source_row(bronze: DataFrame, path: str | None = None) -> DataFrame:
    """Scanned rows written out, to ``path`` or to scratch space: the raw layer of the table.

    Each has its ``source_row``, its place in its ``fetch`` from 0, counting rows dropped later.
    Both are found as the files are read.
    """
    return store(bronze, "bronze", path, "zstd")


def _report(raw: DataFrame) -> list[Column]:
    """Key and date of each raw row's report, as its lots have them; absent columns are null."""

    def text(name: str) -> str:
        return strip(null_tokens(f"`{name}`")) if name in raw.columns else "cast(null as string)"

    slug, day = text("slug_id"), parse_date(text("report_date"))
    key = report_key(to_int_trunc(coerce_numeric(slug)), slug, "fetch", day, text("report_date"))
    return [F.expr(key).alias("report_key"), F.expr(day).alias("report_date")]


def fetched_reports(raw: DataFrame) -> DataFrame:
    """One row for each report and fetch in ``raw``, whether or not it has lots.

    ``raw`` is a stored table with ``fetch`` and ``fetched_at``; ``final`` says whether the
    fetch holds a final row of the report.
    """
    status = strip("final_ind") if "final_ind" in raw.columns else "cast(null as string)"
    rows = raw.select(*_report(raw), "fetch", "fetched_at", F.expr(f"{status} <=> 'Final'").alias("final"))
    return (
        rows.groupBy("report_key", "report_date", "fetch")
        .agg(F.max("fetched_at").alias("fetched_at"), F.max("final").alias("final"))
        .withColumn("report_month", report_month(F.col("report_date")))
    )


def rows_of_fetches(raw: DataFrame, chosen: DataFrame, fetched: DataFrame) -> DataFrame:
    """The rows of ``raw`` whose report and fetch are listed in ``chosen``, a part of the list ``fetched``.

    Mostly all fetches are chosen, or nearly so: rows are then kept by what was not chosen, a
    list short enough to be broadcast, so that whole rows are not shuffled.  Both are stored
    tables.
    """
    names = ["report_key", "fetch"]
    total, taken = fetched.count(), chosen.count()
    if taken == total:
        return raw
    listed, kind = (chosen, "left_semi") if 2 * taken < total else (None, "left_anti")
    if listed is None:
        listed = store(fetched.select(*names).join(chosen.select(*names), names, "left_anti"), "not-chosen")
    key, _ = _report(raw)
    keyed = raw.withColumn("__key", key)
    same = (keyed["__key"] == listed["report_key"]) & (keyed["fetch"] == listed["fetch"])
    return keyed.join(listed, same, kind).drop("__key")


def unknown_columns(headers: DataFrame, known: Iterable[str] = S.KNOWN_RAW_COLUMNS) -> DataFrame:
    """Column names no one has described yet, with the number of files they occur in."""
    return (
        headers.select("path", F.explode("header").alias("column_name"))
        .filter(~F.col("column_name").isin(*known))
        .groupBy("column_name")
        .agg(F.count_distinct("path").alias("files"))
    )


def alias_guard(headers: DataFrame, known: Iterable[str] = S.KNOWN_RAW_COLUMNS) -> None:
    """Fail if any file has an unknown column."""
    names = ", ".join(sorted(row["column_name"] for row in unknown_columns(headers, known).collect()))
    if names:
        raise ValueError(f"unknown report columns: {names}")


def _folder(report: str | None) -> str:
    """Name of a report's folder, as Spark names those of partitions."""
    if not report:
        return "report=__HIVE_DEFAULT_PARTITION__"
    return "report=" + UNSAFE.sub(lambda sign: f"%{ord(sign.group()):02X}", report)


class _ReportFile:
    """A packed CSV file that is written under a hidden name."""

    def __init__(self, place: str, header: bytes):
        system, inner = open_location(place)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.pack = zlib.compressobj(wbits=31)
        self.out = system.open_output_stream(inner, compression=None)
        self.out.write(self.pack.compress(header))

    def add(self, rows: pa.RecordBatch) -> None:
        sink = pa.BufferOutputStream()
        pa.csv.write_csv(rows, sink, pa.csv.WriteOptions(include_header=False))
        self.out.write(self.pack.compress(sink.getvalue()))

    def close(self) -> None:
        self.out.write(self.pack.flush())
        self.out.close()


def _by_report(table: pa.Table) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """The rows of each report (the last column), without it, in the order they came."""
    reports = table.column(table.num_columns - 1).combine_chunks().dictionary_encode()
    codes = reports.indices.fill_null(len(reports.dictionary)).to_numpy()
    order = np.argsort(codes, kind="stable")
    rows = table.select(range(table.num_columns - 1)).combine_chunks().take(order).combine_chunks().to_batches()[0]
    names, codes = [*reports.dictionary.to_pylist(), None], codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(codes)]):
        yield names[codes[start]], rows.slice(start, end - start)


def _written(path: str, header: list[str], max_rows: int, job: str):
    """A task's work: packed rows to files of their reports; says which are whole."""
    line = ",".join('"' + name.replace('"', '""') + '"' for name in header).encode() + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get(), 0
        for table in unpacked(batches, WRITTEN_BYTES):
            done = []
            for report, rows in _by_report(table):
                folder = _folder(report)
                for start in range(0, rows.num_rows, max_rows):
                    hidden = f"_{job}-{task.taskAttemptId()}-{files}"
                    file = _ReportFile(f"{path}/{folder}/{hidden}", line)
                    file.add(rows.slice(start, max_rows))
                    file.close()
                    done.append((folder, hidden, f"part-{task.partitionId():05d}-{job}.c{files:06d}.csv.gz"))
                    files += 1
            yield _listed(done)

    return run


def _listed(files: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = zip(*files) if files else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in columns], ["folder", "hidden", "name"])


def _put_in_place(path: str):
    """A task's work: of a report's folder only the files just written stay, under their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, files in zip(batch["folder"], batch["files"]):
                system, inner = open_location(f"{path}/{folder}")
                there = {file.base_name: file for file in system.get_file_info(pa.fs.FileSelector(inner))}
                names = {file["hidden"]: file["name"] for file in files}
                for name in there.keys() - names.keys() - set(names.values()):
                    if there[name].is_file:
                        system.delete_file(f"{inner}/{name}")
                for hidden, name in names.items():
                    # One that is gone was put in place before a task was lost.
                    if hidden in there:
                        system.move(f"{inner}/{hidden}", f"{inner}/{name}")
            yield pd.DataFrame({"folders": [len(batch)]})

    return run


def write_reports(rows: DataFrame, path: str, max_rows_per_file: int = 1_000_000) -> Observation:
    """Write one folder of CSV files per report id; returns the count of rows written.

    A report written before is replaced.  Rows, all text, are rebalanced by report, so small
    reports share a task and a large one is split over several; files are packed with gzip.
    Reports may have very many small files, which Spark's writer takes some 20 ms each for: tasks
    write them under hidden names and list them in a table, since of a task that ran twice only
    one list is kept; then other tasks put a folder's listed files in place and delete the rest.
    """
    spark, written, job = rows.sparkSession, Observation(), str(uuid.uuid4())
    header = rows.columns
    places = [f"c{i}" for i in range(len(header))]
    texts = rows.toDF(*places).select(*[F.col(place).cast("string").alias(place) for place in places])
    texts = texts.withColumn("report", F.col(places[header.index("slug_id")]))
    texts = texts.observe(written, F.count(F.lit(1)).alias("rows"))
    listing = scratch_path(spark, "files")
    with advisory_size(spark, PACKED_BYTES):
        files = packed(texts, "report").mapInArrow(
            _written(path, header, max_rows_per_file, job), "folder string, hidden string, name string"
        )
        files = store(files, "files", listing)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    folders = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder").groupBy("folder")
    listed = folders.agg(F.collect_list(F.struct("hidden", "name")).alias("files"))
    listed.mapInPandas(_put_in_place(path), "folders long").agg(F.sum("folders")).collect()
    discard(spark, listing)
    return written


def written_reports(spark: SparkSession, path: str) -> DataFrame:
    """Number of reports that have files; reads file names only."""
    return (
        list_files(spark, path, REPORT_FILES)
        .select(F.regexp_extract("path", "/report=([^/]+)/", 1).alias("report"))
        .agg(F.count_distinct("report").alias("reports"))
    )
