"""Scores of documents under word counts and under the mixed model of :mod:`context_mixing`.

Blocks of documents ask buckets of words how often training documents hold each of their
words; a bucket adds up what its blocks tell, and spells the words that the training
documents hold once or never.  A text then is a row of symbols: a word that makes up at least
a ``COMMON``-th of the training tokens is its own, others have the symbol of their count's
size, where the counts tell which word it is, and words met once or never have that of a word
to be spelled.  Which word of a symbol it is also heeds the text's own earlier words of that
symbol, since rare words come again in the text that holds them.  The bits of these symbols are scored in the order of the text, after the
symbols before.  The tables and weights are added up from the training documents of all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.session import store

from . import context_mixing as M
from . import exchange as X
from . import wire
from .scratch import Scratch
from .texts import raw_texts, words_of

END_WORD = b"\n"  # no word holds white space
BLOCK_CHARS, BUCKET_CHARS = 12 << 20, 16 << 20
#: Words that make up this share of the training tokens and are not longer are symbols of their own.
COMMON, LONGEST = 1 << 14, 64
#: Symbols of counts by their highest bit; the first is that of words met once or never.
CLASSES = 64
TEXT_ORDERS, SPELLING_ORDERS = (1, 2, 3), (1, 2, 4)
END = 256  # of a word's bytes
#: Numbers in one row of tables that are added up, and groups that are added up first.
RANGE, FIRST = 1 << 18, 16
#: Weight of the corpus against that of one earlier word of the text, for words to be spelled and others.
SPELLED_TRUST, COUNTED_TRUST = 10.0, 1000.0
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
KEY, SYMBOLS, TAIL = "__key", "__symbols", "__tail"


class _Words:
    """The distinct lower-cased words of a block by bucket, and the words of each text in order."""

    def __init__(self, table: pa.Table, text: str, buckets: int):
        texts = [words_of(x.lower()) + [END_WORD] for x in raw_texts(table[text])]
        words = sorted(set().union(*texts))
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        self.words = [words[i] for i in order.tolist()]
        self.bucket = bucket[order]
        place = dict(zip(self.words, range(len(words))))
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ids = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64, int(self.sizes.sum()))

    def questions(self, learn: list[bool | None]) -> list[tuple[int, bytes]]:
        """Words with how often the texts to learn from hold them."""
        wanted = np.repeat(np.array([bool(x) for x in learn], bool), self.sizes)
        held = np.bincount(self.ids[wanted], minlength=len(self.words))
        return [(bucket, _packed(self.words[i:j], held[i:j])) for bucket, i, j in X.bounds(self.bucket)]


def _packed(words: list[bytes], counts: np.ndarray) -> bytes:
    names = wire.pack_words(words)
    return len(names).to_bytes(8, "little") + names + zlib.compress(wire.wide_columns(np.asarray(counts, np.int64)), 1)


def _read(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    end = 8 + int.from_bytes(payload[:8], "little")
    words = wire.unpack_words(payload[8:end])
    return words, wire.wide_uncolumns(zlib.decompress(payload[end:]), len(words))


class _Bucket:
    """All words of a bucket with their counts, and the places of each block's own."""

    def __init__(self, payloads: list[bytes]):
        read = list(map(_read, payloads))
        self.words = sorted(set().union(*(words for words, _ in read)))
        place = dict(zip(self.words, range(len(self.words)))).__getitem__
        self.counts = np.zeros(len(self.words), np.int64)
        self.asked = []
        for words, counts in read:
            own = np.fromiter(map(place, words), np.int64, len(words))
            self.counts[own] += counts
            self.asked.append(own)


def vocabulary(asks: DataFrame) -> DataFrame:
    """Each training word with its count, by bucket."""

    def run(table):
        bucket = _Bucket(table["payload"].to_pylist())
        kept = np.flatnonzero(bucket.counts)
        words = pa.array([bucket.words[i] for i in kept.tolist()], pa.binary())
        numbers = pa.array(np.full(len(kept), table["__bucket"][0].as_py()), pa.int64())
        return pa.table({"bucket": numbers, "word": words, "c": pa.array(bucket.counts[kept], pa.int64())})

    return asks.groupBy("__bucket").applyInArrow(run, "bucket long, word binary, c long")


def bytes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each with its end, and their sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    symbols = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)
    symbols[np.cumsum(sizes) - 1] = END
    return symbols, sizes


def _spellings(batch: pa.RecordBatch):
    return (batch["bucket"].to_numpy(), *bytes_of(batch["word"].to_pylist()))


def _streams(batch: pa.RecordBatch):
    texts = batch[SYMBOLS].to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
    return batch[X.BLOCK].to_numpy(), np.frombuffer(b"".join(texts), "<u2").astype(np.int64), sizes


def _added(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]], sizes: list[int]) -> list[np.ndarray]:
    """The sum over all tasks of the arrays that ``task`` makes of its rows."""

    def run(batches):
        part = TaskContext.get().partitionId() % FIRST
        for number, values in enumerate(task(batches)):
            pieces = [zlib.compress(values[i : i + RANGE].tobytes(), 1) for i in range(0, len(values), RANGE)]
            columns = [number] * len(pieces), range(len(pieces)), [part] * len(pieces), pieces
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def add(table):
        # np.frombuffer gives read-only memory, hence the sum from zero
        total = 0
        for data in table["data"]:
            total = total + np.frombuffer(zlib.decompress(data.as_py()))
        return table.slice(0, 1).set_column(3, "data", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    kind = "number int, range int, part int, data binary"
    schema = pa.schema([("number", pa.int32()), ("range", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
    parts = rows.mapInArrow(run, kind)
    for keys in (("number", "range", "part"), ("number", "range")):
        parts = parts.groupBy(*keys).applyInArrow(add, kind)
    totals = [np.zeros(size) for size in sizes]
    for row in parts.collect():
        data = np.frombuffer(zlib.decompress(row.data))
        totals[row.number][row.range * RANGE : row.range * RANGE + len(data)] = data
    return totals


def trained(rows: DataFrame, read, weights: np.ndarray, orders: tuple[int, ...]) -> tuple[M.Model, M.Mixer]:
    """Tables and mixer learnt from ``rows``, of which ``read`` gives groups, symbols and sizes.

    Each group of rows (a block of texts, a bucket of words) teaches a mixer of its own; their
    mean, by symbols, is the model's.
    """
    context = rows.sparkSession.sparkContext
    empty = M.Model.empty(weights, orders)
    shared = context.broadcast((empty.code, empty.log_slots))

    def counted(batches):
        code, log_slots = shared.value
        model = M.Model(code, orders, log_slots, [np.zeros(2 << log_slots) for _ in orders])
        for batch in batches:
            M.count(model, *read(batch)[1:])
        return model.counts

    counts = _added(rows, counted, [2 << empty.log_slots] * len(orders))
    model = M.Model(empty.code, orders, empty.log_slots, [table.astype(np.float32) for table in counts])
    told = context.broadcast(model)

    def learnt(batches):
        model = told.value
        group, mixer, share = None, M.Mixer.new(model.inputs), 0
        total = mixer.state(0)
        for batch in batches:
            groups, symbols, sizes = read(batch)
            ends = np.cumsum(sizes)
            for found, i, j in X.bounds(groups):
                if found != group:
                    total = total + mixer.state(share)
                    group, mixer, share = found, M.Mixer.new(model.inputs), 0
                first = int(ends[i] - sizes[i])
                M.learn(mixer, model, symbols[first : int(ends[j - 1])], sizes[i:j])
                share += int(ends[j - 1]) - first
        return [total + mixer.state(share)]

    state = _added(rows, learnt, [len(M.Mixer.new(model.inputs).state(0))])[0]
    shared.unpersist()
    told.unpersist()
    return model, M.Mixer.of_state(state, model.inputs)


def _byte_weights(words: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(END + 1)
        for batch in batches:
            total += np.bincount(_spellings(batch)[1], minlength=END + 1)
        return [total]

    return _added(words, run, [END + 1])[0]


class _Symbols:
    """Which symbol a word has, and how probable the word is there."""

    def __init__(self, stored: DataFrame):
        sums = F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.count(F.when(F.col("c") == 1, 1))
        self.total, self.distinct, single = stored.agg(*sums).first()
        # The least count and greatest length of a word with a symbol of its own.
        self.least, self.longest = max(2, -(-self.total // COMMON)), LONGEST
        common = (F.col("c") >= self.least) & (F.length("word") <= self.longest)
        words = sorted((bytes(r.word), r.c) for r in stored.where(common).select("word", "c").collect())
        self.place = {word: i for i, (word, _) in enumerate(words)}
        self.masses = np.zeros(CLASSES)
        self.masses[0] = single
        size = F.length(F.bin("c")) - 1
        for row in stored.where(~common & (F.col("c") > 1)).groupBy(size.alias("k")).agg(F.sum("c").alias("mass")).collect():
            self.masses[row.k] = row.mass
        self.weights = np.r_[[float(c) for _, c in words], self.masses]

    def of(self, words: list[bytes], counts: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of ``words``, and log10 of each word's probability given its symbol."""
        known = np.maximum(counts, 1)
        kind = np.frexp(known.astype(np.float64))[1] - 1
        symbols = len(self.place) + kind.astype(np.int64)
        tail = np.where(counts > 1, np.log10(known / np.maximum(self.masses[kind], 1)), spelled * np.log10(2))
        for i in np.flatnonzero(counts >= self.least).tolist():
            if len(words[i]) <= self.longest:
                symbols[i], tail[i] = self.place[words[i]], 0
        return symbols, tail


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key stands before its place."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]] if len(keys) else np.empty(0, bool)
    places = np.arange(len(keys))
    found = np.empty(len(keys), np.int64)
    found[order] = places - np.maximum.accumulate(np.where(first, places, 0))
    return found


def _tails(doc: np.ndarray, ids: np.ndarray, symbols: np.ndarray, tail: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """log10 of each token's probability given its symbol, after the earlier ones of its text."""
    words = _earlier(doc * (int(ids.max(initial=0)) + 1) + ids)
    total = _earlier(doc * CLASSES + symbols)
    new = tail + np.log10(trust)
    again = np.log10(np.maximum(words, 1) + 10.0 ** np.maximum(new, -300))
    return np.where(words > 0, again, new) - np.log10(total + trust)


def lm_scores(docs: DataFrame, train: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``train`` names a boolean column: rows to learn from (null: not).  Tokens are the words
    (A-Z lower-cased) and one end; null text: only the end.  ``base_score`` and ``score`` are
    log10 probabilities.  Without training rows every base probability is 1 and words are
    spelled by an untrained model.  Input columns named like an added one are replaced;
    ``keep_text=False`` leaves the text out of the result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    chars = X.total_chars(docs, text)
    buckets = X.parts(chars, BUCKET_CHARS)
    key = F.xxhash64(*[c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")])
    blocked = docs.withColumn(KEY, key).withColumn(X.BLOCK, F.pmod(KEY, F.lit(X.parts(chars, BLOCK_CHARS))))

    def words_in(table):
        return _Words(table, text, buckets)

    asks = store(X.ask(blocked, lambda table: words_in(table).questions(table[train].to_pylist())), "block-words")
    scratch = Scratch()
    stored = scratch.table(vocabulary(asks), "word-counts")
    names = _Symbols(stored)
    spelling, spelling_mixer = trained(stored, _spellings, _byte_weights(stored), SPELLING_ORDERS)
    scratch.drop(stored)
    spelled = spark.sparkContext.broadcast((spelling_mixer, _bare(spelling), M.Evidence.of(spelling)))
    named = spark.sparkContext.broadcast(names)

    def reply(payloads):
        bucket = _Bucket(payloads)
        rare = np.flatnonzero(bucket.counts <= 1)
        logs = np.zeros(len(bucket.words), np.float32)
        if len(rare):
            symbols, sizes = bytes_of([bucket.words[i] for i in rare.tolist()])
            logs[rare] = np.add.reduceat(M.scored(*spelled.value, symbols, sizes), np.cumsum(sizes) - sizes)
        return [zlib.compress(bucket.counts[own].tobytes() + logs[own].tobytes(), 1) for own in bucket.asked]

    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    numbers = [T.StructField(n, T.LongType()) for n in ADDED[:3]] + [T.StructField(ADDED[3], T.DoubleType())]
    streams = [T.StructField(TAIL, T.DoubleType()), T.StructField(X.BLOCK, T.LongType()), T.StructField(SYMBOLS, T.BinaryType())]

    def finish(table, replies):
        table = table.sort_by(KEY)
        names, block = named.value, words_in(table)
        count, logs = [], []
        for payload, (_, i, j) in zip(X.replies_of(replies), X.bounds(block.bucket)):
            data = zlib.decompress(payload)
            count.append(np.frombuffer(data, np.int64, j - i))
            logs.append(np.frombuffer(data, np.float32, offset=8 * (j - i)))
        count, logs = np.concatenate(count), np.concatenate(logs).astype(np.float64)
        symbols, tail = names.of(block.words, count, logs)
        base = np.log10((count + 0.1) / (names.total + 0.1 * (names.distinct + 1)))
        starts = np.cumsum(block.sizes) - block.sizes
        data = symbols.astype("<u2")[block.ids].tobytes()
        kind = symbols[block.ids] - len(names.place)
        rare = np.flatnonzero(kind >= 0)
        doc, kind = np.repeat(np.arange(len(starts)), block.sizes)[rare], kind[rare]
        trust = np.where(kind == 0, SPELLED_TRUST, COUNTED_TRUST)
        tails = _tails(doc, block.ids[rare], kind, tail[block.ids[rare]], trust)
        columns = [
            block.sizes,
            np.add.reduceat((count > 0)[block.ids].astype(np.int64), starts),
            np.full(len(starts), names.total, np.int64),
            np.add.reduceat(base[block.ids], starts),
            np.bincount(doc, tails, len(starts)),
            table[X.BLOCK],
            [data[2 * i : 2 * (i + n)] for i, n in zip(starts.tolist(), block.sizes.tolist())],
        ]
        table = table.select([f.name for f in kept])
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.binary()]
        for field, values, kind in zip([*numbers, *streams], columns, kinds):
            table = table.append_column(field.name, values if field.name == X.BLOCK else pa.array(values, kind))
        return table

    rows = store(X.tagged(blocked, X.answer(asks, reply), finish, T.StructType([*kept, *numbers, *streams])), "text-symbols")
    learnt = rows.where(F.col(train)).select(X.BLOCK, SYMBOLS)
    model, mixer = trained(learnt, _streams, names.weights, TEXT_ORDERS)
    mixed = spark.sparkContext.broadcast((mixer, _bare(model), M.Evidence.of(model)))

    def score(batches):
        for batch in batches:
            _, symbols, sizes = _streams(batch)
            bits = np.add.reduceat(M.scored(*mixed.value, symbols, sizes), np.cumsum(sizes) - sizes) if len(sizes) else sizes
            whole = pa.array(bits * np.log10(2) + batch[TAIL].to_numpy(), pa.float64())
            arrays = [batch[f.name] for f in [*kept, *numbers]]
            yield pa.RecordBatch.from_arrays([*arrays, whole], [f.name for f in [*kept, *numbers]] + [ADDED[4]])

    return rows.mapInArrow(score, T.StructType([*kept, *numbers, T.StructField(ADDED[4], T.DoubleType())]))


def _bare(model: M.Model) -> M.Model:
    """The model without its counts, for tasks that have its evidence."""
    return M.Model(model.code, model.orders, model.log_slots, [])


def op9(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learning from those outside the held-out tenth.

    A null doc_id has the text '' and is held out.
    """
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    rows = docs.select("doc_id", "text", (remainder != 0).alias("learn"))
    scores = lm_scores(rows, "learn", keep_text=False)
    return scores.select("doc_id", (~F.col("learn")).alias("held_out"), *ADDED)
