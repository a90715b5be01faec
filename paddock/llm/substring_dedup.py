"""Removal of repeated passages, found through difference-cover anchors.

A passage of at least ``window`` words that two documents share starts at any place in
either.  Residues of a difference cover of ``period`` have every difference between two
of them, so among the first ``period`` words of the match there is a shift that brings
both documents to a cover position at once: hashing runs of ``window - period + 1`` words
at cover positions only (3 of 7 places) meets every match.  Windows around an anchor that
another document shares are then compared whole, and those whose first holder has a smaller
doc_id are removed.

Both steps are rounds of :mod:`exchange`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .texts import WordBlock, raw_texts

#: Characters in a block of documents and in the documents that share a bucket of keys.
BLOCK_CHARS, BUCKET_CHARS = 4 << 20, 16 << 20
ADDED = ("n_words", "n_removed", "kept_text")
_NULL_ID = -(2**63)


def _ids(table: pa.Table, key: str) -> np.ndarray:
    """Ids as numbers; a null id counts as smaller than all others."""
    return table[key].cast(pa.int64()).fill_null(_NULL_ID).to_numpy()


class _Passages:
    """Anchors and candidate windows of one block, in an order fixed by its documents."""

    def __init__(self, table, key, text, window, period, cover, buckets):
        self.ids = _ids(table, key)
        self.block = WordBlock(raw_texts(table[text]))
        self.window, self.period, self.buckets = window, period, buckets
        found, place = self.block.windows(window - period + 1)
        residue = (place - self.block.start[self.block.doc[place]]) % period
        here = np.isin(residue, cover)
        self.place, hashes = place[here], found[here]
        keys, self.key_of = np.unique(hashes, return_inverse=True)
        bucket = X.bucket_of(keys, buckets)
        self.order = np.lexsort((keys, bucket))
        self.keys, self.bucket = keys[self.order], bucket[self.order]
        owner = self.ids[self.block.doc[self.place]]
        self.local = np.zeros(len(keys), bool)  # held by two ids of this block
        if len(keys):
            by_key = np.argsort(self.key_of, kind="stable")
            first = np.searchsorted(self.key_of[by_key], np.arange(len(keys)))
            sorted_owner = owner[by_key]
            self.local = np.minimum.reduceat(sorted_owner, first) != np.maximum.reduceat(sorted_owner, first)

    def anchors(self):
        residues = self.keys.astype(np.uint32)
        return [(b, residues[i:j].tobytes()) for b, i, j in X.bounds(self.bucket)]

    def candidates(self, elsewhere: np.ndarray):
        """Windows around an anchor that another document holds; sets ``first`` etc."""
        shared = self.local.copy()
        shared[self.order] |= elsewhere
        block = self.block
        marked = np.zeros(len(block.hashes) + self.period, np.int64)
        marked[self.place[shared[self.key_of]]] = 1
        upto = np.r_[0, np.cumsum(marked)]
        found, place = block.windows(self.window)
        near = upto[place + self.period] > upto[place]
        self.at, hashes = place[near], found[near]
        owner = self.ids[block.doc[self.at]]
        keys, self.window_key = np.unique(hashes, return_inverse=True)
        self.first = np.zeros(len(keys), np.int64)
        if len(keys):
            by_key = np.argsort(self.window_key, kind="stable")
            start = np.searchsorted(self.window_key[by_key], np.arange(len(keys)))
            self.first = np.minimum.reduceat(owner[by_key], start)
        bucket = X.bucket_of(keys, self.buckets)
        self.window_order = np.lexsort((keys, self.first, bucket))
        self.window_bucket = bucket[self.window_order]
        self.owner = owner
        return keys

    def questions(self, keys):
        ordered, first = keys[self.window_order], self.first[self.window_order]
        return [
            (b, ordered[i:j].tobytes() + first[i:j].tobytes()) for b, i, j in X.bounds(self.window_bucket)
        ]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """For each word whether a removed window covers it."""
        before = np.zeros(len(self.first), bool)
        before[self.window_order] = earlier
        gone = before[self.window_key] | (self.owner > self.first[self.window_key])
        edges = np.zeros(len(self.block.hashes) + 1, np.int64)
        starts = self.at[gone]
        edges[starts] += 1
        np.subtract.at(edges, starts + self.window, 1)
        return np.cumsum(edges[:-1]) > 0


def _held_twice(payloads: list[bytes]) -> list[bytes]:
    lists = [np.frombuffer(p, np.uint32) for p in payloads]
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    return [X.pack_bits(part) for part in np.split(twice, np.cumsum([len(x) for x in lists])[:-1])]


def _held_earlier(payloads: list[bytes]) -> list[bytes]:
    sizes = [len(p) // 16 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes)])
    first = np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in zip(payloads, sizes)])
    order = np.lexsort((first, keys))
    starts = np.r_[True, keys[order][1:] != keys[order][:-1]]
    least = first[order][starts][np.cumsum(starts) - 1]
    earlier = np.zeros(len(keys), bool)
    earlier[order] = first[order] > least
    return [X.pack_bits(part) for part in np.split(earlier, np.cumsum(sizes)[:-1])]


def substring_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 13,
    period: int = 7,
    cover: tuple[int, ...] = (0, 1, 3),
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words, one space apart).

    A word goes if a window of ``window`` words covers it whose words also start in a
    document with a smaller ``key``; all windows are judged on the input.  Null text: no
    words.  Null key: smaller than all others.  Rows that share a key never remove each
    other's words.  Input columns named like an added one are replaced; others stay.
    An empty table gives an empty table.
    """
    if period >= window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover of {period} below {window}")
    docs = docs.drop(*ADDED)
    chars = X.total_chars(docs, text)
    buckets = X.parts(chars, BUCKET_CHARS)
    blocked = X.with_blocks(docs, X.parts(chars, BLOCK_CHARS), [key, text])

    def passages(table):
        return _Passages(table, key, text, window, period, cover, buckets)

    anchors = X.ask(blocked, lambda table: passages(table).anchors())
    shared = X.answer(anchors, _held_twice)

    def candidates(table, replies):
        found = passages(table)
        keys = found.candidates(X.flags_of(replies))
        block = table[X.BLOCK][0].as_py()
        return X.message([(bucket, block, 1, payload) for bucket, payload in found.questions(keys)])

    def run_candidates(table, replies):
        return candidates(table, replies) if len(table) else X.message([])

    windows = X.tagged(blocked, shared, run_candidates, X.ASKS)
    earlier = X.answer(windows, _held_earlier, 1)
    fields = [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_text", T.StringType())]

    def finish(table, replies):
        found = passages(table)
        found.candidates(X.flags_of(replies, 0))
        gone = found.removed(X.flags_of(replies, 1))
        kept, lost = [], []
        for words, start, end in zip(found.block.words, found.block.start, found.block.end):
            here = gone[start:end]
            lost.append(int(here.sum()))
            if lost[-1]:
                words = [words[i] for i in np.flatnonzero(~here)]
            kept.append(b" ".join(words).decode())
        table = table.drop_columns([X.BLOCK])
        for name, values in zip(ADDED, (found.block.lengths.tolist(), lost, kept)):
            table = table.append_column(name, pa.array(values, pa.string() if name == "kept_text" else pa.int64()))
        return table

    return X.tagged(blocked, shared.unionByName(earlier), finish, T.StructType(fields))


def op3(docs: DataFrame) -> DataFrame:
    """The digest of :func:`substring_dedup` for each document."""
    return substring_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
