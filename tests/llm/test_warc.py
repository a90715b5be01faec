import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from paddock.llm import warc

ROWS = [
    (1, "http://a.b.c/x", "<p>"), (2, "http://a.b.c/x", "<p>"), (3, None, None), (4, "not a url\n z", ""),
    (4, "not a url\n z", ""), (None, "http://u@A.b:80/?q=1#f", "é"), (-5, "", "é"),
    (7, "http://a.b.c/x", "z" * 300_000), (9, "http://a.b.c/x", "\r\n\r\n"),
]
KIND = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows):
    least = -(2**63)
    last = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        last[data] = max(last.get(data, least), least if page_id is None else page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = (least if page_id is None else page_id) == last[data]
        out.append((page_id, len(data), digest(data), "response" if first else "revisit", None if first else last[data]))
    return sorted(out, key=repr)


def found(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(row[n] for n in names) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_small_pages(spark, rows):
    frame = spark.createDataFrame(rows, KIND).withColumn("sha1", F.lit("clash")).withColumn("payload", F.lit(1))
    assert found(warc.op1(frame)) == expected(rows)


def test_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert found(warc.op1(pages)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_payloads_and_absent_keys(spark):
    archive = warc.build_archive(spark.createDataFrame(ROWS, KIND))
    keys = [(f"c,b,a)/x {2**63 + n:020d}",) for n in (7, 8)] + [("zz 1",)]
    keys = spark.createDataFrame(keys, "capture_key string")
    rows = warc.read_records(archive, warc.lookup(archive, keys)).collect()
    assert [(r.page_id, bytes(r.payload)) for r in rows] == [(7, b"z" * 300_000)]


def test_lookup_spans_blocks_and_ranges(tmp_path):
    """Equal keys that reach over blocks and over ranges are all found, absent ones cost one read."""
    folder, ranges = tmp_path, []
    lines = [[("a", i) for i in range(3)] + [("b", i) for i in range(5)], [("b", 9)], [("d", 0)]]
    for number, part in enumerate(lines):
        data, directory = b"", []
        for first in range(0, len(part), 2):
            block = warc._packed("\n".join(f"{k}\tf\t{n}\t1" for k, n in part[first : first + 2]).encode())
            directory.append(f"{part[first][0]}\t{len(data)}\t{len(block)}")
            data += block
        (folder / f"{number}.idx").write_bytes(data)
        (folder / f"{number}.idx.dir").write_text("\n".join(directory))
        ranges.append((part[0][0].encode(), part[-1][0].encode(), f"{number}.idx"))
    reader = warc.IndexReader(str(folder), ranges)
    assert [n for _, n, _ in reader.find(b"b")] == [0, 1, 2, 3, 4, 9]
    assert [n for _, n, _ in reader.find(b"a")] == [0, 1, 2]
    before = reader.reads
    assert list(reader.find(b"c")) == [] and reader.reads == before


def test_reversed_host(spark):
    urls = [
        ("https://m.Example.ORG:8080/a/b?q=1#top", "org,example,m:8080)/a/b?q=1"), ("http://u:p@h.net", "net,h)"),
        ("plain text", "plain+text"), ("", ""), (None, ""),
    ]
    frame = spark.createDataFrame(urls, "url string, want string")
    assert all(r.got == r.want for r in frame.withColumn("got", warc.reversed_host(F.col("url"))).collect())


def test_large_payloads_are_read_by_several_tasks(spark):
    """60 MB that do not compress: the tasks follow the bytes, not the few addresses."""
    pages = spark.range(240).selectExpr(
        "id as page_id", "concat('http://a.b/', id) as url",
        "concat_ws('', transform(sequence(1, 3900), i -> sha2(concat(id, '-', i), 256))) as html",
    )
    archive = warc.build_archive(pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("capture_key"))
    records = warc.read_records(archive, warc.lookup(archive, keys))
    by_task = records.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("payload_bytes").alias("bytes")).collect()
    total = sum(r.bytes for r in by_task)
    assert total == 240 * 3900 * 64 and len(by_task) >= 6
    assert max(r.bytes for r in by_task) < total / 2
