"""Questions that blocks of documents put to the whole corpus.

A *block* is a set of documents fixed by a hash, small enough for a task.  It sends each
distinct key it holds once, packed by *bucket* of the key's hash; each bucket sees every
block that holds a key and answers in the order in which it was asked; the block joins the
answers with its documents.  A key that a third of all documents hold is one entry of each
block, so no key is hot, and a task holds one block or one bucket only.  The block's
documents are shuffled once: the plan reuses that exchange for every round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "__block"
ASKS = "__bucket long, __block long, __round int, payload binary"
_ASKS = pa.schema(
    [("__bucket", pa.int64()), ("__block", pa.int64()), ("__round", pa.int32()), ("payload", pa.binary())]
)


def total_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.length(text))).first()[0] or 0


def parts(chars: int, each: int) -> int:
    return max(1, -(-chars // each))


def with_blocks(docs: DataFrame, blocks: int, key: list[str]) -> DataFrame:
    """``docs`` with the number of its block; equal keys share a block."""
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(*key), F.lit(blocks)))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper half of the hash; the lower half tells keys of a bucket apart."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def bounds(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each run."""
    if not len(sorted_buckets):
        return []
    first = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    end = np.r_[first[1:], len(sorted_buckets)]
    return list(zip(sorted_buckets[first].tolist(), first.tolist(), end.tolist()))


def message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASKS)], schema=_ASKS)


def ask(blocked: DataFrame, questions: Callable[[pa.Table], list[tuple[int, bytes]]], round_: int = 0) -> DataFrame:
    """One row for each block and bucket with the packed keys that ``questions`` gives."""

    def run(table: pa.Table) -> pa.Table:
        block = table[BLOCK][0].as_py()
        return message([(bucket, block, round_, payload) for bucket, payload in questions(table)])

    return blocked.groupBy(BLOCK).applyInArrow(run, ASKS)


def answer(asks: DataFrame, reply: Callable[[list[bytes]], list[bytes]], round_: int = 0) -> DataFrame:
    """The reply to each packed question, from all questions of its bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blocks = table["__bucket"][0].as_py(), table["__block"].to_pylist()
        replies = reply(table["payload"].to_pylist())
        return message([(bucket, block, round_, payload) for block, payload in zip(blocks, replies)])

    return asks.groupBy("__bucket").applyInArrow(run, ASKS)


def replies_of(table: pa.Table, round_: int = 0) -> list[bytes]:
    """A block's replies in the order of buckets."""
    rows = zip(table["__round"].to_pylist(), table["__bucket"].to_pylist(), table["payload"].to_pylist())
    return [payload for found, _, payload in sorted(rows, key=lambda row: row[:2]) if found == round_]


def pack_bits(flags: np.ndarray) -> bytes:
    return np.int64(len(flags)).tobytes() + np.packbits(flags).tobytes()


def unpack_bits(payload: bytes) -> np.ndarray:
    count = int(np.frombuffer(payload, np.int64, 1)[0])
    return np.unpackbits(np.frombuffer(payload, np.uint8, offset=8), count=count).astype(bool)


def flags_of(table: pa.Table, round_: int = 0) -> np.ndarray:
    """All replies of a round that are packed bits, as one array."""
    return np.concatenate([np.empty(0, bool), *map(unpack_bits, replies_of(table, round_))])


def tagged(blocked: DataFrame, replies: DataFrame, run: Callable[[pa.Table, pa.Table], object], schema):
    """``run`` on each block's documents with its replies."""
    return blocked.groupBy(BLOCK).cogroup(replies.groupBy(BLOCK)).applyInArrow(run, schema)
