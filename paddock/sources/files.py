"""Files by the names that Spark uses, listed and opened in tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

# Hadoop's names of file systems that Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_location(path: str, encoded: bool = False) -> tuple[str, str]:
    """(kind, place) of a path or URI: ``local`` and a file name, or ``uri`` and an Arrow URI.

    ``encoded``: the path is percent-encoded, as ``input_file_name()`` gives it.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or not scheme.isascii():
        return "local", unquote(path) if encoded else path
    scheme = scheme.lower()
    if scheme == "file":
        rest = "/" + rest.lstrip("/")
        return "local", unquote(rest) if encoded else rest
    if not encoded:
        rest = quote(rest, safe="/:@?=&+,;~!$'()*%" if "%" in rest else "/:@?=&+,;~!$'()*")
    return "uri", f"{SCHEMES.get(scheme, scheme)}:{rest}"


def open_location(path: str, encoded: bool = False):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    kind, place = arrow_location(path, encoded)
    if kind == "local":
        return fs.LocalFileSystem(), place
    return fs.FileSystem.from_uri(place)


GLOB = set("{}[]*?\\")
LISTED = "path string, length bigint, stamp bigint, folder boolean"
# Folders below the given ones that are listed one by one, so that their contents are dealt to tasks.
LEVELS = 2
# What Java leaves in the path of a URI, besides letters of other scripts.
PLAIN = re.compile(r"[^A-Za-z0-9_.!~'()*,;:$&+=/@-]")


def uri_name(path: str) -> str:
    """A path as Spark names the file of a row: percent-encoded."""

    def encoded(sign: re.Match) -> str:
        kept = not sign.group().isascii() and unicodedata.category(sign.group()) not in ("Zs", "Zl", "Zp", "Cc")
        return sign.group() if kept else quote(sign.group(), safe="")

    return PLAIN.sub(encoded, path)


def file_tasks(spark: SparkSession) -> int:
    """Among so many tasks files are dealt that are listed or opened."""
    return max(2 * spark.sparkContext.defaultParallelism, 4)


def _roots(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Whole names of the paths given, which may hold wildcards."""
    roots = []
    for name in [path] if isinstance(path, str) else path:
        if ":/" in name and not GLOB & set(name):
            roots.append(name)
            continue
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(place):
            roots.append(system.makeQualified(place).toString())
            continue
        found = [status.getPath().toString() for status in system.globStatus(place) or []]
        if not found:
            raise FileNotFoundError(f"no such path: {name}")
        roots += found
    return roots


def _patterns(pattern: str) -> list[str]:
    """Names with wildcards, without choices in braces."""
    found = re.search(r"{([^{}]*)}", pattern)
    if not found:
        return [pattern]
    before, after = pattern[: found.start()], pattern[found.end() :]
    return [name for choice in found.group(1).split(",") for name in _patterns(before + choice + after)]


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(pattern: str, deep: bool) -> Callable:
    """A task's work: folders are replaced by what they hold, if ``deep`` down to the last file."""
    names = _patterns(pattern)

    def wanted(info) -> bool:
        return any(fnmatchcase(info.base_name, name) for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["folder"] is False:
                    rows.append(tuple(row.values()))
                    continue
                system, inner = open_location(row["path"])
                found, start = [system.get_file_info(inner)], len(inner)
                if found[0].type == fs.FileType.NotFound:
                    raise FileNotFoundError(row["path"])
                if found[0].type == fs.FileType.Directory:
                    found, start = system.get_file_info(fs.FileSelector(inner, recursive=deep)), len(inner.rstrip("/"))
                for info in found:
                    below = info.path[start:]
                    if any(_hidden(part) for part in below.split("/")[1:]):
                        continue
                    path = row["path"].rstrip("/") + below
                    if info.type == fs.FileType.File and wanted(info):
                        rows.append((path, info.size, info.mtime_ns // 1_000_000, False))
                    elif info.type == fs.FileType.Directory and not deep:
                        rows.append((path, None, None, True))
            columns = zip(*rows) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "length", "stamp", "folder"])

    return run


def list_files(spark: SparkSession, path: str | Sequence[str], pattern: str) -> DataFrame:
    """``path, length, stamp`` (milliseconds) of every file below ``path`` that matches ``pattern``.

    Tasks list the folders; the driver names only what it was given, so there may be any
    number of files.  Hidden files are left out as by Spark's readers.
    """
    ship_package(spark)
    roots, tasks = _roots(spark, path), file_tasks(spark)
    rows = spark.createDataFrame([(root, None, None, None) for root in roots], LISTED)
    # Where many are given they are dealt as they are.
    for _ in range(LEVELS if len(roots) < tasks else 0):
        rows = rows.repartition(tasks, "path").mapInArrow(_listed(pattern, False), LISTED)
    rows = rows.repartition(tasks, "path").mapInArrow(_listed(pattern, True), LISTED)
    return rows.select("path", "length", "stamp")
