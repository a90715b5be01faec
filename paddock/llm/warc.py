"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each.  The index holds a line for each
capture, keyed by the URL with its host reversed, so that a site's captures stand together:

* level two: lines sorted by key, in compressed blocks of ``BLOCK_LINES``, in one file for
  each range of keys;
* level one: beside it a sparse directory, the first key and the byte range of each block.

A lookup searches the ranges, then the directory, by bisection, reads one block by its range
and bisects its lines; the line names a file and the range of the record.  Lookups of many
keys are sorted first, so that a task passes once through its part of the index, and the
records they name are read in the order of the files.

Tasks write files under names of their own; what a lost task leaves is never referred to,
because the table of captures holds what the tasks that counted returned.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import scratch_path, store
from paddock.sources.files import open_location

from .scratch import Scratch

#: Lines in a block of the index, bytes after which a new archive begins, bytes between
#: records that are read along rather than skipped.
BLOCK_LINES, ARCHIVE_BYTES, GAP_BYTES = 2000, 1 << 29, 1 << 16
#: What a task looks up and reads: keys, and bytes of compressed records.
KEYS_AT_ONCE, BYTES_AT_ONCE = 50_000, 4 << 20
WRITTEN = "capture_key string, page_id long, file string, start long, size long"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload binary, "
    "payload_bytes long, payload_digest string"
)
_DATE = "2024-01-01T00:00:00Z"  # pages have no date of their own
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def reversed_host(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query; no fragment.

    What is no URL is its own key; null is empty.  White space and control characters are
    replaced by '+', since they part the index's fields.
    """
    pattern = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*).*$"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    key = F.concat(turned, F.regexp_extract(url, pattern, 2), F.lit(")"), F.regexp_extract(url, pattern, 3))
    return F.regexp_replace(F.when(url.rlike(pattern), key).otherwise(F.coalesce(url, F.lit(""))), r"[\x00-\x20\x7f]", "+")


def capture_key(url: Column, page_id: Column) -> Column:
    """The URL's sort key and the capture's number, so written that text order is its order."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat_ws(" ", reversed_host(url), F.coalesce(number, F.lit("-")))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}, end + 4


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD; a response's digest is that of the payload as read."""
    headers, at = _headers(data, 0)
    block = data[at : at + int(headers["content-length"])]
    http, body = _headers(block, 0)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    payload = None if revisit else block[body:]
    if payload is not None and _digest(payload) != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return (
        _page_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"],
        _page_of(headers["warc-refers-to"]) if revisit else None, payload,
        int(http["content-length"]) if revisit else len(payload), digest,
    )


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(data: bytes) -> bytes:
    member = zlib.compressobj(4, wbits=31)
    return member.compress(data) + member.flush()


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, wbits=31)


@dataclass
class Archive:
    """A folder of WARC files, its captures, and the ranges of its index."""

    folder: str
    captures: DataFrame
    ranges: list[tuple[bytes, bytes, str]]  # first key, last key, file of level two


def write_archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; the table of captures.

    Of records whose payloads are equal and at least ``least`` bytes, the one with the
    largest page_id is a response and the others revisit it; rows that share that page_id
    are all responses.  A null page_id counts as smaller than all; null html is empty.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        capture_key(F.col("url"), F.col("page_id")).alias("capture_key"), payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
    )
    groups = named.where(F.length("payload") >= least).groupBy("sha1").agg(
        F.max("page_id").alias("responder"), F.count(F.lit(1)).alias("copies")
    )
    # Only payloads held twice need the join's answer; the rest are responses.
    repeated = groups.where("copies > 1").drop("copies").hint("shuffle_hash")
    roles = named.join(repeated, "sha1", "left").select(
        "capture_key", "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("responder")), F.col("responder")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_location(folder)
        system.create_dir(place, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for first in range(0, batch.num_rows, 64):
                for key, page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.slice(first, 64).columns)):
                    if out is None or at > ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{place}/{name}", compression=None)
                    member = _packed(record_bytes(page_id, url, payload, _digest(payload), refers_to, refers_to is not None))
                    out.write(member)
                    rows.append((key, page_id, name, at, len(member)))
                    at += len(member)
            yield _batch(rows, ("capture_key", "page_id", "file", "start", "size"), _WRITTEN_TYPES)
        if out:
            out.close()

    # An archive for each shuffle partition, also where the join split one to even it out.
    most = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(roles.coalesce(most).mapInArrow(run, WRITTEN), "captures")


_WRITTEN_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_RECORD_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())


def _batch(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, bytes, str]]:
    """Write both levels of the index; the first and last key and the file of each range.

    There are as many ranges as partitions, whatever the number of captures.
    """
    lines = captures.select("capture_key", "file", "start", "size")
    ranged = lines.repartitionByRange(*lines.columns).sortWithinPartitions(*lines.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_location(folder)
        system.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        out, directory, block, at, last = None, [], [], 0, ""

        def flush() -> int:
            data = _packed("\n".join(block).encode())
            directory.append(f"{block[0].rsplit(chr(9), 3)[0]}\t{at}\t{len(data)}")
            out.write(data)
            return at + len(data)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                out = out or system.open_output_stream(f"{place}/{name}", compression=None)
                block.append("\t".join(map(str, row)))
                last = row[0]
                if len(block) == BLOCK_LINES:
                    at = flush()
                    block.clear()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with system.open_output_stream(f"{place}/{name}.dir", compression=None) as file:
            file.write("\n".join(directory).encode())
        first = directory[0].rsplit("\t", 2)[0]
        yield _batch([(first, last, name)], ("first", "last", "file"), (pa.string(),) * 3)

    rows = ranged.mapInArrow(run, "first string, last string, file string").collect()
    return sorted((row.first.encode(), row.last.encode(), row.file) for row in rows)


class IndexReader:
    """Finds captures by key in the ranges of one index; keeps the last directory and block."""

    def __init__(self, folder: str, ranges: list[tuple[bytes, bytes, str]]):
        self.system, self.place = open_location(folder)
        self.ranges = ranges
        self.lasts = [last for _, last, _ in ranges]
        self.directory = self.block = (None, [], [])
        self.reads = 0  # blocks read by their range

    def _directory(self, name: str):
        if self.directory[0] != name:
            with self.system.open_input_file(f"{self.place}/{name}.dir") as file:
                rows = [line.rsplit(b"\t", 2) for line in file.read().split(b"\n")]
            self.directory = (name, [row[0] for row in rows], [(int(a), int(n)) for _, a, n in rows])
        return self.directory[1:]

    def _block(self, name: str, start: int, size: int):
        if self.block[0] != (name, start):
            with self.system.open_input_file(f"{self.place}/{name}") as file:
                file.seek(start)
                rows = [line.rsplit(b"\t", 3) for line in _unpacked(file.read(size)).split(b"\n")]
            self.reads += 1
            self.block = ((name, start), [row[0] for row in rows], rows)
        return self.block[1:]

    def find(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """(file, start, size) of every capture with just this key."""
        at = bisect_left(self.lasts, key)
        while at < len(self.ranges) and self.ranges[at][0] <= key:
            name = self.ranges[at][2]
            firsts, places = self._directory(name)
            # Equal keys may begin in the block before the first that starts with the key.
            number = max(bisect_left(firsts, key) - 1, 0)
            while number < len(firsts) and firsts[number] <= key:
                keys, rows = self._block(name, *places[number])
                for row in rows[bisect_left(keys, key) : bisect_right(keys, key)]:
                    yield row[1].decode(), int(row[2]), int(row[3])
                number += 1
            at += 1


def build_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    folder = folder or scratch_path(pages.sparkSession, "archive")
    captures = write_archive(pages, f"{folder}/warc")
    return Archive(folder, captures, build_index(captures, f"{folder}/index"))


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """file, start and size of the captures with the ``capture_key`` values of ``keys``.

    Keys that no capture has give no row, repeated keys count once.  A task looks up about
    KEYS_AT_ONCE keys.
    """
    distinct = keys.select("capture_key").distinct()
    tasks = -(-keys.count() // KEYS_AT_ONCE) or 1
    sorted_keys = distinct.repartitionByRange(tasks, "capture_key").sortWithinPartitions("capture_key")
    folder, ranges = f"{archive.folder}/index", archive.ranges

    def run(batches):
        reader = IndexReader(folder, ranges)
        for batch in batches:
            found = [place for key in batch.column(0).to_pylist() for place in reader.find(key.encode())]
            yield _batch(found, ("file", "start", "size"), _WRITTEN_TYPES[2:])

    return sorted_keys.mapInArrow(run, "file string, start long, size long")


def read_records(archive: Archive, places: DataFrame) -> DataFrame:
    """The records at ``places``, read in the order of the files, near ones in one read.

    The number of tasks follows the bytes to be read, not the few that name them.
    """
    folder = f"{archive.folder}/warc"
    places = Scratch().table(places, "places")
    tasks = -(-(places.agg(F.sum("size")).first()[0] or 0) // BYTES_AT_ONCE) or 1
    ordered = places.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")

    def spans(rows):
        """Runs of places of one file that one read covers."""
        run: list[tuple[str, int, int]] = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + GAP_BYTES or row[1] - run[0][1] > 1 << 22):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def run(batches):
        system, place = open_location(folder)
        name, file = None, io.BytesIO()
        for batch in batches:
            for span in spans(zip(*(column.to_pylist() for column in batch.columns))):
                if span[0][0] != name:
                    file.close()
                    name, file = span[0][0], system.open_input_file(f"{place}/{span[0][0]}")
                first = span[0][1]
                file.seek(first)
                data = file.read(span[-1][1] + span[-1][2] - first)
                rows = [parse_record(_unpacked(data[at - first : at - first + size])) for _, at, size in span]
                yield _batch(rows, [c.split()[0] for c in RECORD.split(", ")], _RECORD_TYPES)
        file.close()

    return ordered.mapInArrow(run, RECORD)


def op1(pages: DataFrame) -> DataFrame:
    """Write all pages, look every capture up through the index, read and describe it."""
    archive = build_archive(pages)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("capture_key"))
    records = read_records(archive, lookup(archive, keys))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
