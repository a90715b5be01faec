"""Packing of tokenized documents into sequences of a fixed length.

How many pieces there are of each length decides everything: the histogram has at most
``capacity`` entries however many documents there are, so the plan is made from it alone.
*Exact complements* come first: for a long piece, a hash of the available lengths finds
one, two or three others that fill its gap to the token, and such a combination is used as
often as its scarcest length allows.  What stays is packed best fit, longest first.  The
plan says which ranks of each length go where; pieces are ranked inside their length, in
parts so that a length that a third of all pieces share is spread over tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.session import store

from .byte_bpe import chunk_table

#: Characters that one call tokenizes at once, and pieces in one part of a ranking.
SLICE_CHARS, PART_ROWS = 1 << 21, 1 << 14
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _slices(sizes: list[int]):
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE_CHARS:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and ``end_id``, cut only if over ``capacity``.

    All pieces but the first are then full.  A null text is empty: one piece, ``end_id``.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table = chunk_table(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1)
            rows = []
            for first, last in _slices(pc.binary_length(pc.fill_null(texts, "")).to_pylist()):
                encoded = table.encode([x or "" for x in texts.slice(first, last - first).to_pylist()])
                for doc, tokens in zip(ids[first:last], encoded):
                    tokens += end
                    count = len(tokens) // 4
                    pieces = -(-count // capacity)
                    edge = count - (pieces - 1) * capacity
                    start = 0
                    for piece in range(pieces):
                        rows.append((doc, piece, start, edge - start, zlib.crc32(tokens[4 * start : 4 * edge])))
                        start, edge = edge, edge + capacity
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(run, PIECES)


def _usable(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often a combination can be taken."""
    return min(int(counts[length]) // lengths.count(length) for length in set(lengths))


def _pair(free: np.ndarray, gap: int) -> int:
    """The largest free length whose complement to ``gap`` is free too, else 0."""
    found = np.flatnonzero(free[1:gap] & free[gap - 1 : 0 : -1])
    return int(found[-1]) + 1 if len(found) else 0


def _fillers(counts: np.ndarray, gap: int):
    """Free combinations of one, two, then three lengths that sum to ``gap``."""
    free = counts > 0
    if free[gap]:
        yield (gap,)
    for size in np.flatnonzero(free[1:gap])[::-1] + 1:
        other = gap - int(size)
        if other <= size and free[other]:
            yield (int(size), other)
    for size in np.flatnonzero(free[1:gap])[::-1] + 1:
        second = _pair(free, gap - int(size))
        if second:
            yield (int(size), second, gap - int(size) - second)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), from pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    made: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            for filler in _fillers(left, capacity - length):
                combination = (length, *filler)
                times = _usable(left, combination)
                if times:
                    for part in combination:
                        left[part] -= times
                    made.append((combination, times))
                    break
            else:
                break
    made.extend(_best_fit(left, capacity))
    return made


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; sequences filled alike are handled as one group."""
    open_by_gap: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        gap = length
        while count and gap <= capacity:
            if not open_by_gap[gap]:
                gap += 1
                continue
            parts, number = open_by_gap[gap].pop()
            used = min(count, number)
            if used < number:
                open_by_gap[gap].append((parts, number - used))
            count -= used
            open_by_gap[gap - length].append(((*parts, length), used))
            gap = length
        each = capacity // length
        for size, number in ((each, count // each), (count % each, 1)):
            if size and number:
                open_by_gap[capacity - size * length].append(((length,) * size, number))
    return [group for groups in open_by_gap for group in groups]


class Places:
    """For each length, the ranges of ranks that go to consecutive sequences."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], capacity: int):
        ranges: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        given = [0] * (capacity + 1)
        sequence = 0
        for lengths, times in made:
            offset = 0
            for length in lengths:
                ranges[length].append((given[length], sequence, offset))
                given[length] += times
                offset += length
            sequence += times
        self.sequences = sequence
        self.ranges = {n: np.array(rows, np.int64).T for n, rows in enumerate(ranges) if rows}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            here = lengths == length
            first, base, at = self.ranges[int(length)]
            place = np.searchsorted(first, ranks[here], side="right") - 1
            sequence[here] = base[place] + ranks[here] - first[place]
            offset[here] = at[place]
        return sequence, offset


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank``, counted from 0 inside each length.

    ``counts`` has the pieces of each length; a length is ranked in as many parts as it has
    PART_ROWS, so that one which a third of all pieces share is spread over tasks.
    """
    sizes = [(length, -(-count // PART_ROWS)) for length, count in counts.items()]
    # At most one row for each length up to the capacity.
    shares = F.broadcast(pieces.sparkSession.createDataFrame(sizes, "length long, parts long"))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    pieces = pieces.join(shares, "length").withColumn("part", F.pmod(key, F.col("parts"))).drop("parts")
    sizes = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        pieces.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("first"))
        .drop("first", "part")
    )


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with ``sequence_id`` and ``offset``.

    Each sequence is gapless from offset 0.  Repeated rows are separate pieces; an empty
    table gives an empty table.
    """
    counts = {row.length: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = Places(plan(counts, capacity), capacity)

    def run(batches):
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            lengths, ranks = frame["length"].to_numpy(), frame["rank"].to_numpy()
            sequence, offset = places.find(lengths, ranks)
            frame = frame.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence))
            yield from frame.append_column("offset", pa.array(offset)).to_batches()

    named = ranked(pieces, counts)
    kinds = dict(named.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in named.columns if c != "rank")
    return named.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack them: a row for each piece.

    Null text: empty.  Null ids stay null.  Other columns are not used.
    """
    pieces = store(token_pieces(docs, tokenizer, capacity), "token-pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
