"""Shards of nearly equal size, by splitters sampled in proportion to size.

Rows are put in the order of a key (a hash of the text, so equal texts stand together; a
hash of the id; the place in the table, which tells repeated rows apart).  A sample of keys,
drawn in proportion to size, gives splitters that part the order into many small ranges;
the ranges are counted, and those that turn out overfull are sampled and split again, until
none is.  The counted ranges say in which of them each shard begins; these are read once
more for the exact key, so the shards follow the sizes of all rows, not of the sample.

A hot group of copies is many rows in a row of the order: it is split between ranges and
shards like any other stretch.  No task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.session import store

from .scratch import Scratch

#: Rows a range may hold before it is split again, and rows it is meant to hold.
FULL, AIM = 400_000, 100_000
#: Ranges for each shard at least, and sampled keys for each range.
FINE, DRAWN = 4, 16
#: A group of equal texts is not parted by a shard's edge if it holds less than this part of a shard.
WHOLE = 0.01
_KEY = ("__group", "__second", "__place")
_U = np.uint64


def joined_keys(group: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each row's key as 24 bytes that compare like the three whole numbers."""
    columns = [part.astype(np.int64).view(_U) ^ _U(1 << 63) for part in (group, second, place)]
    return np.ascontiguousarray(np.stack(columns, 1).astype(">u8")).view("S24").reshape(-1)


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    return joined_keys(*(batch.column(batch.schema.get_field_index(name)).to_numpy() for name in _KEY))


def _ranges(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Range i begins with splitter i - 1."""
    return np.searchsorted(splitters, keys, side="right").astype(np.int64)


def with_range(keyed: DataFrame, splitters: np.ndarray, **known: np.ndarray) -> DataFrame:
    """``keyed`` with the number of each row's range, and what is ``known`` of that range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _ranges(splitters, keys_of(batch))
            added = [found, *(values[found] for values in known.values())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, added)], [*batch.schema.names, "__range", *known]
            )

    added = [T.StructField(name, T.LongType()) for name in ("__range", *known)]
    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields, *added]))


def _draw(rows: DataFrame, step: Column) -> DataFrame:
    """Keys and how often each is drawn: size / step times on average, the rest by a hash.

    A draw depends on the row alone, so a task that runs again draws the same.
    """
    share = F.col("size") / step
    chance = F.pmod(F.xxhash64(*_KEY, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(*_KEY, F.floor(share + chance).alias("drawn")).where("drawn > 0")


def _sample(rows: DataFrame, step: Column) -> tuple[np.ndarray, np.ndarray]:
    """Drawn keys in order with their weights; as many as the ranges asked for times DRAWN."""
    table = _draw(rows, step).toArrow()
    keys = joined_keys(*(table[name].to_numpy() for name in _KEY))
    order = np.argsort(keys, kind="stable")
    return keys[order], table["drawn"].to_numpy()[order]


def _quantiles(keys: np.ndarray, weights: np.ndarray, pieces: int) -> np.ndarray:
    """Sampled keys that part the sample's weight into ``pieces``."""
    if not len(keys) or pieces < 2:
        return keys[:0]
    reach = np.cumsum(weights)
    wanted = reach[-1] * np.arange(1, pieces) / pieces
    return np.unique(keys[np.minimum(np.searchsorted(reach, wanted), len(keys) - 1)])


def _count(keyed: DataFrame, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes of each range: one row of the answer for each range."""
    counted = with_range(keyed.select(*_KEY, "size"), splitters).groupBy("__range")
    table = counted.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).toArrow()
    rows, sizes = np.zeros(len(splitters) + 1, np.int64), np.zeros(len(splitters) + 1, np.int64)
    place = table["__range"].to_numpy()
    rows[place], sizes[place] = table["rows"].to_numpy(), table["bytes"].to_numpy()
    return rows, sizes


def sampled_splitters(
    keyed: DataFrame, shards: int, full: int = FULL, aim: int = AIM
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splitters such that no range holds more than ``full`` rows, and rows and bytes of each range.

    Keys are all different, so an overfull range can always be split.
    """
    count, total = keyed.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return np.empty(0, "S24"), np.zeros(1, np.int64), np.zeros(1, np.int64)
    pieces = max(FINE * shards, -(-count // aim))
    keys, weights = _sample(keyed, F.lit(total / (pieces * DRAWN)))
    splitters = _quantiles(keys, weights, pieces)
    while True:
        rows, sizes = _count(keyed, splitters)
        overfull = np.flatnonzero(rows > full)
        if not len(overfull):
            return splitters, rows, sizes
        splitters = np.union1d(splitters, _split(keyed, splitters, overfull, rows, aim))


def _split(keyed: DataFrame, splitters: np.ndarray, overfull: np.ndarray, rows: np.ndarray, aim: int) -> np.ndarray:
    """Further splitters inside the overfull ranges, drawn by rows: there rows are what is too many."""
    inside = with_range(keyed.select(*_KEY), splitters).where(F.col("__range").isin(overfull.tolist()))
    keys, weights = _sample(inside.withColumn("size", F.lit(1)), F.lit(float(aim) / DRAWN))
    held = _ranges(splitters, keys)
    found = [keys[:0]]
    for number in overfull.tolist():
        here = held == number
        pieces = max(2, -(-int(rows[number]) // aim))
        found.append(_quantiles(keys[here], weights[here], pieces))
    return np.concatenate(found)


def _first_keys(keyed: DataFrame, splitters: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """The key at which each shard but the first begins: its row's middle is past the shard's edge.

    Each edge lies in one range; the ranges in question are read again, each by one task.
    """
    reach = np.cumsum(sizes)
    total, before = int(reach[-1]), reach - sizes
    edges = [(s, -(-s * total // shards)) for s in range(1, shards)]
    # Of a range's last row the middle may lie before an edge that the range holds.
    wanted: dict[int, list[int]] = {}
    for _, edge in edges:
        wanted.setdefault(int(np.searchsorted(reach, edge, side="left")), []).append(edge)

    def run(table: pa.Table) -> pa.Table:
        number = table["__range"][0].as_py()
        keys = joined_keys(*(table[name].to_numpy() for name in _KEY))
        order = np.argsort(keys, kind="stable")
        size = table["size"].to_numpy()[order]
        middle = 2 * (int(before[number]) + np.cumsum(size)) - size
        found = [int(np.searchsorted(middle, 2 * edge)) for edge in wanted[number]]
        at = [keys[order[i]].ljust(24, b"\0") if i < len(order) else None for i in found]
        return pa.table({"edge": pa.array(wanted[number], pa.int64()), "key": pa.array(at, pa.binary())})

    narrow = with_range(keyed.select(*_KEY, "size"), splitters).where(F.col("__range").isin(list(wanted)))
    found = {r.edge: r.key for r in narrow.groupBy("__range").applyInArrow(run, "edge long, key binary").collect()}
    starts = []
    for _, edge in edges:
        key = found[edge]
        if key is None:  # the next range's first row begins the shard
            number = int(np.searchsorted(reach, edge, side="left"))
            later = number + 1 + np.flatnonzero(sizes[number + 1 :] > 0)
            key = bytes(splitters[int(later[0]) - 1]).ljust(24, b"\0") if len(later) else b"\xff" * 24
        starts.append(bytes(key))
    return np.array(starts, "S24")


def _keep_whole(keyed: DataFrame, starts: np.ndarray, limit: float) -> np.ndarray:
    """Shard edges moved to the nearer end of a group of equal texts that they would part.

    Only groups of at most ``limit`` bytes are kept whole.
    """
    padded = [bytes(s).ljust(24, b"\0") for s in starts]
    groups = {key: int.from_bytes(key[:8], "big") - (1 << 63) for key in padded if key != b"\xff" * 24}
    if not groups:
        return starts
    rows = keyed.where(F.col("__group").isin(list(set(groups.values())))).select(*_KEY, "size")

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, group = keys_of(batch), batch.column(3).to_numpy(), batch.column(0).to_numpy()
            for key, number in groups.items():
                here = group == number
                if here.any():
                    left = here & (keys < np.bytes_(key))
                    columns = [[key], [int(sizes[left].sum())], [int(sizes[here].sum())]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.binary()), *map(pa.array, columns[1:])], ["key", "left", "all"]
                    )

    sums = rows.mapInArrow(side, "key binary, left long, all long").groupBy("key")
    found = {bytes(r[0]): (r[1], r[2]) for r in sums.agg(F.sum("left"), F.sum("all")).collect()}
    moved = []
    for key in padded:
        left, whole = found.get(key, (0, 0))
        if left and whole <= limit:
            # The first key of the group, or of the one after it.
            first = groups[key] + (2 * left >= whole) + (1 << 63)
            key = first.to_bytes(8, "big") + bytes(16) if first < 1 << 64 else b"\xff" * 24
        moved.append(key)
    return np.array(moved, "S24")


def assign_shards(keyed: DataFrame, shards: int, full: int = FULL, aim: int = AIM, whole: float = WHOLE) -> DataFrame:
    """``keyed`` with ``shard`` and ``slot``; ``keyed`` is a stored table with ``size`` and the key's columns.

    A shard's bytes differ from an equal share by at most half a row, or half a group kept
    whole, at each of its two edges.  Slots count the shard's rows from 0 in the order of keys.
    """
    splitters, _, sizes = sampled_splitters(keyed, shards, full, aim)
    total = int(sizes.sum())
    starts = np.empty(0, "S24")
    if total and shards > 1:
        starts = _keep_whole(keyed, _first_keys(keyed, splitters, sizes, shards), whole * total / shards)
    # With the shards' edges among the splitters each range lies in one shard.
    splitters = np.union1d(splitters, starts)
    rows, _ = _count(keyed, splitters)
    firsts = np.concatenate([np.zeros(1, "S24"), splitters])
    shard = np.searchsorted(np.sort(starts), firsts, side="right")
    reach = np.cumsum(rows) - rows
    shard_first = np.searchsorted(shard, shard, side="left")
    offset = reach - reach[shard_first]
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*_KEY)) - 1
    ranged = with_range(keyed, splitters, shard=shard.astype(np.int64), __offset=offset)
    return ranged.withColumns(
        {"shard": F.col("shard").cast("int"), "slot": F.col("__offset") + place}
    ).drop("__range", "__offset")


def with_key(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text and 8 more) and the key's columns, not yet stored."""
    return docs.withColumns(
        {
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
            "__group": F.xxhash64(F.coalesce(text, F.lit(""))),
            "__second": F.xxhash64(id_column),
            "__place": F.monotonically_increasing_id(),
        }
    )


def write_shards(
    docs: DataFrame, path: str, shards: int, text: str = "text", id_column: str = "doc_id", tasks: int | None = None
) -> DataFrame:
    """Write ``docs`` as a table in folders ``shard=0`` on, rows in the order of slots; returns it read back.

    Columns of ``docs`` named ``shard``, ``slot`` or ``size`` are replaced.  The shards are
    found on a narrow table; rows join it by their place in a stored copy.
    """
    scratch = Scratch()
    docs = docs.drop("shard", "slot", "size")
    placed = scratch.table(docs.withColumn("__place", F.monotonically_increasing_id()), "placed")
    # The place is the stored one: it names the row.
    keys = with_key(placed.select(id_column, text, F.col("__place").alias("__row")), text, id_column)
    keyed = scratch.table(keys.select("size", "__group", "__second", F.col("__row").alias("__place")), "shard-keys")
    found = assign_shards(keyed, shards).select("__place", "shard", "slot", "size")
    rows = placed.join(found, "__place").drop("__place")
    (
        rows.repartitionByRange(tasks or 4 * shards, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
    scratch.drop(placed, keyed)
    return docs.sparkSession.read.parquet(path)


def op13(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Each document's shard and slot, by the law ``bytes``.

    Null text: size 8, checksum 0, grouped with empty texts.  Null and repeated ids are rows
    like others; an empty table gives an empty one; other columns are ignored.  With fewer
    rows than shards some shards stay empty.
    """
    rows = with_key(docs.select("doc_id", "text"))
    rows = rows.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    keyed = store(rows, "shard-keys")
    return assign_shards(keyed, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
