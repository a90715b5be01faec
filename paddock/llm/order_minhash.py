"""Order MinHash fingerprints, in DataFrame functions only.

A text is the sequence of its k-mers of words, each numbered by how often it has occurred
before.  The numbered k-mers are hashed onto a ring.  For each of ``ENTRIES`` evenly spaced
points the ``LENGTH`` k-mers that follow the point are the minimal ones under a hash that
starts there; they are put back in the order of the text, and the hash of that tuple is one
entry.  Two texts share an entry if they share its k-mers and have them in the same order,
which is what small edit distance keeps and a mere exchange of parts does not.

A numbered k-mer is one long: 39 bits of hash above 24 bits of place, so that plain sorting
of numbers orders the ring.  Every step is one projection, since an array that the next step
uses more than once must not be computed again for each use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.session import store

from .scratch import Scratch

#: Words in a k-mer, entries of a fingerprint, k-mers in an entry's tuple.
KMER, ENTRIES, LENGTH = 3, 64, 2
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
_HASH = (1 << 63) - 1 - _PLACE
_RING_BITS = 63 - (ENTRIES.bit_length() - 1)
_NULL_KEY = -(2**63)


def _kmer(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _point(x: Column) -> Column:
    """The last of the evenly spaced points at or before a numbered k-mer."""
    return F.shiftright(x, _RING_BITS).cast("int")


def _placed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(_HASH)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``, an array of ENTRIES numbers below 2 ** 16.

    Texts of fewer than KMER words are one k-mer.  Without words all entries are 0.  Places
    are counted modulo 2 ** 24: in a text of more k-mers (over 33 MB) two k-mers that lie
    further apart than that may change their order in a tuple; equal texts still give equal
    numbers.
    """
    words, kmers, repeats, starts, ring, picked = (f"__{step}_{name}" for step in ("w", "k", "r", "s", "o", "c"))
    c = F.col

    rows = rows.withColumn(words, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    size = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(size - KMER, F.lit(0))),
        lambda i: _placed(F.xxhash64(*(F.get(c(words), i + j) for j in range(KMER))), i),
    )
    rows = rows.withColumn(kmers, F.when(size > 0, F.sort_array(hashes)).otherwise(F.array().cast("array<bigint>")))
    # Occurrences after a k-mer's first; a run of them is numbered by its distance from the
    # run's start, which each finds by following ever longer steps back.
    rows = rows.withColumn(
        repeats, F.filter(c(kmers), lambda x, i: (i > 0) & (_kmer(x) == _kmer(F.get(c(kmers), i - 1))))
    )
    back = F.transform(
        c(repeats),
        lambda x, i: F.when((i > 0) & (_kmer(x) == _kmer(F.get(c(repeats), i - 1))), i - 1).otherwise(i),
    )
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(repeats) + F.lit(1))).cast("int"))
    followed = F.aggregate(rounds, back, lambda held, _: F.transform(held, lambda at: F.get(held, at)))
    # Occurrence numbers meet the k-mers element by element: the planner may put them in
    # place here, where they are still computed once.
    number = F.transform(followed, lambda at, i: i - at + 1)
    numbered = F.zip_with(repeats, number, lambda x, n: _placed(F.xxhash64(_kmer(x), n), x))
    firsts = F.filter(c(kmers), lambda x, i: (i == 0) | (_kmer(x) != _kmer(F.get(c(kmers), i - 1))))
    rows = rows.withColumn(
        ring, F.when(F.size(repeats) > 0, F.sort_array(F.concat(firsts, numbered))).otherwise(c(kmers))
    )
    # Only the first LENGTH after each point can be in a tuple.
    rows = rows.withColumn(
        picked,
        F.filter(c(ring), lambda x, i: (i < LENGTH) | (_point(x) != _point(F.get(c(ring), i - LENGTH)))),
    )
    count = F.size(picked)
    # For each point the place of the first k-mer after it, round the ring.
    firsts_after = F.flatten(
        F.transform(
            c(picked),
            lambda x, i: F.array_repeat(i, _point(x) - F.when(i > 0, _point(F.get(c(picked), i - 1))).otherwise(-1)),
        )
    )
    at = F.concat(firsts_after, F.array_repeat(F.lit(0), ENTRIES - 1 - _point(F.element_at(picked, -1))))
    rows = rows.withColumn(starts, F.when(count > 0, at))

    def entry(i: Column) -> Column:
        tuple_ = F.array_sort(
            F.array(*(F.get(c(picked), (i + j) % count) for j in range(LENGTH))),
            lambda a, b: (a.bitwiseAND(F.lit(_PLACE)) - b.bitwiseAND(F.lit(_PLACE))).cast("int"),
        )
        return F.xxhash64(F.transform(tuple_, _kmer)).bitwiseAND(F.lit(0xFFFF)).cast("int")

    rows = rows.withColumn(
        name, F.when(count > 0, F.transform(c(starts), entry)).otherwise(F.array_repeat(F.lit(0), ENTRIES))
    )
    return rows.drop(words, kmers, repeats, starts, ring, picked)


def written(fingerprint: str) -> Column:
    """Four hexadecimal digits for each entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 4, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of entries on which two written fingerprints agree; null if one is null."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(ENTRIES - 1)),
        lambda i: F.substring(left, i * 4 + 1, F.lit(4)) == F.substring(right, i * 4 + 1, F.lit(4)),
    )
    return F.size(same) / ENTRIES


def neighbours(docs: DataFrame) -> DataFrame:
    """A stored table of k, before, before_chars: each key and the one before it in ascending order.

    The first key has the last before it.  Keys are ordered in range partitions; only a row
    for each partition is looked at across them.
    """
    keys = docs.groupBy("k").agg(F.max(F.length("text")).alias("chars"))
    scratch = Scratch()
    ordered = keys.repartitionByRange("k").sortWithinPartitions("k")
    placed = scratch.table(ordered.withColumn("part", F.spark_partition_id()), "ordered-keys")
    last = F.max_by(F.struct("k", "chars"), "k").alias("last")
    parts = placed.groupBy("part").agg(last, F.lit(0).alias("all"))
    ends = Window.partitionBy("all").orderBy("part")
    round_ = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.lag("last").over(ends), F.last("last").over(round_)).alias("last"))
    inside = Window.partitionBy("part").orderBy("k")
    before = F.coalesce(F.lag(F.struct("k", "chars")).over(inside), F.col("last"))
    found = placed.join(F.broadcast(parts), "part").select(
        "k", before["k"].alias("before"), before["chars"].alias("before_chars")
    )
    found = store(found, "neighbours")
    scratch.drop(placed)
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text's digest, both fingerprints, and their likenesses.

    ``edited``: the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's text.  Null text: empty.  A null id comes before all others.
    Rows that share an id each give a row; the next document of the id before them is then
    the least of their texts' heads, or the least fingerprint.  Other columns are not used.
    """
    # The id is taken from the key again, so that both uses of the texts are one shuffle.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_KEY)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    order = neighbours(texts)
    heads = (
        texts.join(order, "k")
        .select(F.col("before").alias("k"), F.expr("substring(text, 1, cast(before_chars / 2 as int))").alias("head"))
        .groupBy("k")
        .agg(F.min("head").alias("head"))
    )
    rows = texts.join(heads, "k", "left").withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn(
        "edited",
        F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(head, 1, cast(n_chars div 2 as int)))"),
    ).drop("head")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(rows, "text", "own").drop("text")
    rows = with_fingerprint(rows, "edited", "other").drop("edited")
    made = store(
        rows.select("k", "n_chars", "edited_sha256", written("own").alias("fingerprint"), written("other").alias("edited_fingerprint")),
        "fingerprints",
    )
    nexts = (
        made.groupBy("k").agg(F.min("fingerprint").alias("next"))
        .join(order, "k")
        .select(F.col("before").alias("k"), "next")
    )
    return made.join(nexts, "k", "left").select(
        F.nullif("k", F.lit(_NULL_KEY)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
