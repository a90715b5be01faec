"""Rows dealt to tasks by a key, moved in packed blocks.

A row of forty texts takes 800 bytes in Spark's own shuffle, half of them lengths and
padding, and is compressed with few of its like.  Here a task deals its rows to buckets of the key
in batches and packs what goes to one bucket by columns (Parquet in memory: texts that come
again are numbers, and so are lengths), a sixth of the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package

BATCH_BYTES = 64 << 20
BUCKET = "__bucket"
BLOCK = "bucket int, size long, block binary"


def _block(table: pa.Table) -> tuple[int, bytes]:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, compression="none", write_statistics=False)
    raw = sink.getvalue()
    return raw.size, pa.Codec("zstd").compress(raw, asbytes=True)


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """What goes to each bucket, in the order it came."""
    table = pa.Table.from_batches(held).combine_chunks()
    buckets = table[BUCKET].to_numpy()
    order = np.argsort(buckets, kind="stable")
    table, buckets = table.drop_columns([BUCKET]).take(order).combine_chunks(), buckets[order]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    packed = [_block(table.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(buckets)])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets[starts], pa.int32()),
            pa.array([size for size, _ in packed], pa.int64()),
            pa.array([block for _, block in packed], pa.binary()),
        ],
        ["bucket", "size", "block"],
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= BATCH_BYTES:
            yield _blocks(held)
            held, size = [], 0
    if held:
        yield _blocks(held)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        for size, block in zip(batch["size"], batch["block"]):
            raw = codec.decompress(block.as_buffer(), size.as_py())
            yield from pq.ParquetFile(pa.BufferReader(raw)).read(use_threads=False).to_batches()


def unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """For functions that run on ``packed`` rows: all rows of a task, some ``most`` bytes of them at a time."""
    held, size = [], 0
    for batch in _unpack(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Blocks of ``rows``, columns ``c0, c1, ...``, rebalanced by ``key``."""
    spark = rows.sparkSession
    ship_package(spark)
    names, buckets = rows.columns, int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = [f"c{i}" for i in range(len(names))]
    bucket = F.pmod(F.hash(places[names.index(key)]), F.lit(buckets)).alias(BUCKET)
    blocks = rows.toDF(*places).select("*", bucket).mapInArrow(_pack, BLOCK)
    return blocks.hint("rebalance", "bucket")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` rebalanced by ``key``: small keys share a task, a large one is split over several."""
    schema = T.StructType([T.StructField(f"c{i}", field.dataType) for i, field in enumerate(rows.schema)])
    return packed(rows, key).mapInArrow(_unpack, schema).toDF(*rows.columns)
