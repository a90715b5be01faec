"""Near-duplicate groups by MinHash with tensored tables.

A text is the set of its runs of five words.  Sixteen *half keys*, each of two minimum
hashes, come from 32 hash functions; a table's key joins one half of the first eight with
one of the other eight, which gives 64 tables of four hashes each where separate ones would
take 256.  Texts of similarity 0.85 share no key with probability 7e-5, at 0.9 2e-6.

Equal sets count once: their documents join through the set's smallest id.  A set that
shares no key is alone.  The others are candidates, and links among them are confirmed on
whole sets.  A crowd of loose copies of one text shares keys all over, so its pairs are not
written out; three bounds that lose no link choose them:

* sets of similarity s share one of their ``n - ceil(s * n) + 1`` rarest shingles, and a
  text that was edited in many places has rare ones of its own there;
* a sketch of 512 bits holds the parity of the shingles that hash to each bit, so two sets
  differ in at least as many shingles as their sketches in bits, which must not be more
  than the similarity allows;
* within a shingle's group each set is first compared with one hub, the set with the fewest
  shingles of its own; only sets that this leaves in different components are compared.

Rarity is counted by a round of :mod:`exchange`, groups meet in joins, which Spark splits
when a key is hot, and no task or driver holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import components
from .scratch import Scratch
from .texts import WordHashes, hashes_of, mixed, raw_texts, window_hashes, words_of

SHINGLE, SIDE, ROWS = 5, 8, 2  # words, half keys on either side, hashes in a half key
PERCENT = 85
SLICE_CHARS, BLOCK_CHARS, BUCKET_CHARS, BLOCK_ROWS = 1 << 20, 4 << 20, 16 << 20, 20_000
ADDED = ("n_shingles", "component_id", "kept")
SKETCH = 8  # longs
_HASHES = 2 * SIDE * ROWS
_SKETCH = [f"s{i}" for i in range(SKETCH)]
_RANDOM = np.random.default_rng(20240611)
_TURN = _RANDOM.integers(1, 2**63, _HASHES, dtype=np.uint64)
_TIMES = _RANDOM.integers(1, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _RANDOM.integers(1, 2**63, (SIDE, SIDE), dtype=np.uint64)


def shingle_set(text: bytes, held: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; fewer words are one run; none, none."""
    words = words_of(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(hashes_of(words, held), SHINGLE))


def half_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Half keys (a row each) of several non-empty sets laid end to end."""
    least = [np.minimum.reduceat((shingles ^ turn) * times, starts) for turn, times in zip(_TURN, _TIMES)]
    halves = [mixed(np.uint64(31) * a + b) for a, b in zip(least[::2], least[1::2])]
    return np.stack(halves, axis=1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 64 * SKETCH bits, as longs."""
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def table_keys(halves: np.ndarray) -> np.ndarray:
    """The 64 keys of each row of half keys, all pairs of the two sides."""
    first, second = halves[:, :SIDE, None], halves[:, None, SIDE:]
    return mixed((first * _TIMES[0] + second * _TIMES[1]) ^ _TABLE).reshape(len(halves), SIDE * SIDE)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n, digest of the set, half keys (empty for an empty set), sketch."""

    def run(batches):
        held = WordHashes()
        for batch in batches:
            texts = raw_texts(pa.chunked_array([batch.column(1)]))
            for first, last in _slices(list(map(len, texts)), SLICE_CHARS):
                if len(held) > 400_000:
                    held.clear()
                sets = [shingle_set(x, held) for x in texts[first:last]]
                sizes = np.array(list(map(len, sets)))
                filled = np.flatnonzero(sizes)
                halves = [b""] * len(sets)
                if len(filled):
                    starts = np.cumsum(sizes[filled]) - sizes[filled]
                    for row, keys in zip(filled, half_keys(np.concatenate([sets[i] for i in filled]), starts)):
                        halves[row] = keys.tobytes()
                sketches = np.stack([sketch(x) for x in sets])
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(halves, pa.binary()),
                     *(pa.array(column) for column in sketches.T)],
                    names=["doc_id", "n", "digest", "halves", *_SKETCH],
                )

    schema = "doc_id long, n long, digest binary, halves binary, " + ", ".join(f"{name} long" for name in _SKETCH)
    return docs.select(key, text).mapInArrow(run, schema)


class _Keys:
    """Table keys of one block of signatures."""

    def __init__(self, table: pa.Table, buckets: int):
        self.ids = table["doc_id"].to_numpy()
        halves = np.frombuffer(b"".join(table["halves"].to_pylist()), np.uint64).reshape(-1, 2 * SIDE)
        keys = table_keys(halves).ravel()
        self.keys, self.key_of, held = np.unique(keys, return_inverse=True, return_counts=True)
        bucket = X.bucket_of(self.keys, buckets)
        self.order = np.lexsort((self.keys, bucket))
        self.bucket, self.local = bucket[self.order], held > 1

    def questions(self):
        residues = self.keys[self.order].astype(np.uint32)
        return [(b, residues[i:j].tobytes()) for b, i, j in X.bounds(self.bucket)]

    def shared(self, elsewhere: np.ndarray) -> np.ndarray:
        """Ids of the sets that share a key."""
        shared = self.local.copy()
        shared[self.order] |= elsewhere
        return self.ids[shared[self.key_of].reshape(len(self.ids), -1).any(1)]


def _held_twice(payloads: list[bytes]) -> list[bytes]:
    lists = [np.frombuffer(p, np.uint32) for p in payloads]
    _, place, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    return [X.pack_bits(part) for part in np.split(held[place] > 1, np.cumsum([len(x) for x in lists])[:-1])]


def candidates(sets: DataFrame) -> DataFrame:
    """Ids of ``sets`` (doc_id, halves; none empty) that share a table key with another."""
    rows = sets.count()
    buckets = X.parts(rows, BLOCK_ROWS)
    blocked = X.with_blocks(sets.select("doc_id", "halves"), X.parts(rows, BLOCK_ROWS), ["doc_id"])
    asks = X.ask(blocked, lambda table: _Keys(table, buckets).questions())

    def finish(table, replies):
        return pa.table({"doc_id": pa.array(_Keys(table, buckets).shared(X.flags_of(replies)), pa.int64())})

    return X.tagged(blocked, X.answer(asks, _held_twice), finish, "doc_id long").distinct()


class _Rarity:
    """Shingles of one block of candidate texts and how many of its sets hold each."""

    def __init__(self, table: pa.Table, buckets: int):
        held = WordHashes()
        self.ids = table["doc_id"].to_pylist()
        self.sets = [shingle_set(x, held) for x in raw_texts(table["text"])]
        self.keys, self.key_of, self.counts = np.unique(
            np.concatenate([np.empty(0, np.uint64), *self.sets]), return_inverse=True, return_counts=True
        )
        bucket = X.bucket_of(self.keys, buckets)
        self.order = np.lexsort((self.keys, bucket))
        self.bucket = bucket[self.order]

    def questions(self):
        keys, counts = self.keys[self.order].astype(np.uint32), self.counts[self.order].astype(np.uint32)
        return [(b, keys[i:j].tobytes() + counts[i:j].tobytes()) for b, i, j in X.bounds(self.bucket)]

    def prefixes(self, totals: np.ndarray, percent: int):
        """(shingle, doc_id, share of shingles no other set holds) of the rarest shingles.

        Only of those that another set holds too.
        """
        total = np.empty(len(self.keys), np.int64)
        total[self.order] = totals
        end = 0
        for doc_id, shingles in zip(self.ids, self.sets):
            start, end = end, end + len(shingles)
            held = total[self.key_of[start:end]]
            n = len(shingles)
            rarest = np.lexsort((shingles, held))[: n - -(-percent * n // 100) + 1]
            own = int((held == 1).sum()) * 1000 // n
            for shingle in shingles[rarest[held[rarest] > 1]].view(np.int64).tolist():
                yield shingle, doc_id, own


def _added(payloads: list[bytes]) -> list[bytes]:
    sizes = [len(p) // 8 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes)])
    counts = np.concatenate([np.frombuffer(p, np.uint32, n, 4 * n) for p, n in zip(payloads, sizes)])
    _, place = np.unique(keys, return_inverse=True)
    total = np.minimum(np.bincount(place, counts)[place], 2**32 - 1).astype(np.uint32)
    return [part.tobytes() for part in np.split(total, np.cumsum(sizes)[:-1])]


_PREFIX = "shingle long, doc_id long, own int"


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of candidate texts (doc_id, text) that other candidates hold too."""
    chars = X.total_chars(texts)
    buckets = X.parts(chars, BUCKET_CHARS)
    blocked = X.with_blocks(texts, X.parts(chars, BLOCK_CHARS), ["doc_id"])
    asks = X.ask(blocked, lambda table: _Rarity(table, buckets).questions())

    def finish(table, replies):
        totals = [np.frombuffer(p, np.uint32) for p in X.replies_of(replies)]
        rows = list(_Rarity(table, buckets).prefixes(np.concatenate(totals), percent))
        columns = list(zip(*rows)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.int32())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("shingle", "doc_id", "own"), columns, kinds)})

    return X.tagged(blocked, X.answer(asks, _added), finish, _PREFIX)


def _may_link(percent: int):
    """Whether the sizes and sketches of sets a and b allow the similarity.

    Similarity at least p means that they differ in at most (1 - p) / (1 + p) of both sizes.
    """
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    bits = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in _SKETCH), F.lit(0))
    return sizes & ((100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _side(sets: DataFrame, name: str) -> DataFrame:
    """``sets`` with its columns named for side ``name`` of a pair."""
    return sets.select(*(F.col(c).alias(name if c == "doc_id" else f"{c}_{name}") for c in sets.columns))


def hub_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: each set with the best hub of its groups that it may link with."""
    hubs = rows.groupBy("shingle").agg(F.min(F.struct("own", "doc_id")).alias("hub"), F.count(F.lit(1)).alias("sets"))
    met = rows.join(hubs.where("sets > 1"), "shingle").where(F.col("doc_id") != F.col("hub.doc_id"))
    met = met.select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"), F.col("hub.own").alias("own")).distinct()
    near = met.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").where(_may_link(percent))
    return near.groupBy("a").agg(F.min(F.struct("own", "b"))["b"].alias("b"))


def apart_rows(rows: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the groups that ``found`` (node, component) does not put in one component."""
    named = rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "shingle", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    spread = named.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return named.join(spread.where("least < most").select("shingle"), "shingle").join(sets, "doc_id")


def apart_pairs(named: DataFrame, percent: int) -> DataFrame:
    """a, b: sets of one group that may link and are in different components (``apart_rows``)."""
    left, right = _side(named, "a"), _side(named, "b")
    on = (F.col("shingle_a") == F.col("shingle_b")) & (F.col("a") > F.col("b")) & (F.col("component_a") != F.col("component_b"))
    return left.join(right, on & _may_link(percent)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are similar enough."""
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        held = WordHashes()
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0))
        for batch in batches:
            keep = []
            if len(held) > 400_000:
                held.clear()
            for x, y in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns[2:])):
                one = shingle_set(x, held)
                if last[0] != y:
                    last = (y, shingle_set(y, held))
                common = len(np.intersect1d(one, last[1], assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(last[1]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union of their sets; a
    component is what links reach, named by its smallest id, whose rows are kept.  A text
    without words (null too) is linked with nothing.  Rows that share an id are one
    document with several texts, linked through any of them.  A null id is linked with
    nothing: its component is null, and it is kept.
    """
    scratch = Scratch()
    made = scratch.table(signatures(docs, key, text), "signatures")
    filled = made.where("n > 0 and doc_id is not null")
    first = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = scratch.table(filled.join(first, "digest").select("doc_id", "digest", "rep"), "members")
    own = filled.join(first, "digest").where("doc_id = rep").select("doc_id", "halves")
    alike = scratch.table(candidates(own), "candidates")
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = whole.where("text is not null").join(alike.hint("shuffle_hash"), "doc_id")
    texts = scratch.table(whole, "candidate-texts")
    rows = scratch.table(prefixes(texts, percent), "prefixes")
    sets = scratch.table(made.join(alike, "doc_id").select("doc_id", "n", *_SKETCH), "sketches")
    links = scratch.table(confirmed(hub_pairs(rows, sets, percent), texts, percent), "links")
    apart = scratch.table(apart_rows(rows, sets, components(links)), "apart")
    more = scratch.table(confirmed(apart_pairs(apart, percent), texts, percent), "links")
    scratch.drop(alike, texts, rows, sets, apart)
    # Ids with several different texts tie the sets of these together.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    ties = several.select(F.col("least").alias("b"), "doc_id").join(member, "doc_id").select(F.col("rep").alias("a"), "b")
    found = components(links.unionByName(more).unionByName(ties))
    scratch.drop(links, more)
    named = member.join(found, member["rep"] == found["node"], "left").select(
        "doc_id", "digest", F.coalesce("component", "rep").alias("found")
    )
    named = named.groupBy("doc_id").agg(F.min("found").alias("found"))
    return (
        made.select("doc_id", "n")
        .join(named, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
