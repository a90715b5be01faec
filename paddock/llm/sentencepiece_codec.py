"""SentencePiece encoding through a table of distinct marked words.

The library puts a mark before a text and turns each space into one.  If no piece of the
model has a mark after another character, pieces never reach across the place before a
mark, so a text is the sequence of its marked words (a run of marks with what follows).
Each block of documents sends its distinct marked words; each word of the corpus is
segmented once, where it is asked for; the block puts the ids together by position.  These
are the rounds of :mod:`exchange`.  Decoding puts the bytes of pieces together.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import wire

MARK = "▁"
#: Characters in a block of documents and in the documents that share a bucket of words.
BLOCK_CHARS, BUCKET_CHARS = 16 << 20, 48 << 20
_WORD = re.compile(r" +[^ ]*")
_LOADED: dict[str, object] = {}


def processor(path: str):
    """The model, loaded once for each worker process and checked for the table's condition."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
            raise ValueError(f"{path}: a piece crosses a whitespace marker")
        if model.encode("a  ") != model.encode("a") + model.encode(" ") or not model.encode(" "):
            raise ValueError(f"{path}: white space is changed before pieces are found")
        _LOADED[path] = model
    return _LOADED[path]


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first mark, other marks as spaces.

    That is what makes the library see just this word, since it adds the first mark.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [word[1:] for word in _WORD.findall(" " + text)]


class _Words:
    """The distinct marked words of a block, in the order of their buckets."""

    def __init__(self, table: pa.Table, text: str, buckets: int):
        self.column = table[text]
        distinct: set[str] = set()
        for x in self.texts():
            distinct.update(marked_words(x))
        words = sorted(distinct)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        bucket = X.bucket_of(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        self.words = [words[i] for i in order.tolist()]
        self.bucket = bucket[order]

    def texts(self):
        for first in range(0, len(self.column), 64):
            yield from (x or "" for x in self.column.slice(first, 64).to_pylist())

    def questions(self):
        return [(b, wire.pack_words([word.encode() for word in self.words[i:j]])) for b, i, j in X.bounds(self.bucket)]


def _segment(path: str, payloads: list[bytes]) -> list[bytes]:
    """For each question the ids of its words, each word segmented once."""
    model = processor(path)
    mark = [model.piece_to_id(MARK)]
    asked = [wire.unpack_words(payload) for payload in payloads]
    words = sorted(set().union(*asked))
    ids: dict[bytes, bytes] = {}
    for first in range(0, len(words), 10_000):
        some = words[first : first + 10_000]
        for word, found in zip(some, model.encode([w.decode() for w in some], num_threads=1)):
            ids[word] = np.array(found if word else mark, "<u4").tobytes()
    return [_pack_ids([ids[word] for word in question]) for question in asked]


def _by_place(sizes: np.ndarray) -> np.ndarray:
    """Order that puts the first ids of all words first, then the second ones, and so on.

    The words are sorted, so neighbours begin with the same ids; side by side these
    compress to next to nothing.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    # Of two bytes numpy sorts by digits.
    return np.argsort(place.astype(np.uint16) if len(sizes) and sizes.max() < 1 << 16 else place, kind="stable")


def _pack_ids(ids: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, ids), "<u4", len(ids)) // 4
    values = np.frombuffer(b"".join(ids), "<u4")
    head = np.array([len(ids), len(values)], "<u4").tobytes()
    return zlib.compress(head + wire.columns(sizes) + wire.columns(values[_by_place(sizes)]), 6)


def _unpack_ids(payload: bytes) -> list[bytes]:
    data = zlib.decompress(payload)
    count, total = np.frombuffer(data, "<u4", 2).tolist()
    sizes = wire.uncolumns(data, count, 8)
    values = np.empty(total, "<u4")
    values[_by_place(sizes)] = wire.uncolumns(data, total, 8 + 4 * count)
    ends = np.cumsum(sizes, dtype=np.int64) * 4
    starts = [0, *ends.tolist()]
    data = values.tobytes()
    return [data[i:j] for i, j in zip(starts, starts[1:])]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``, an array of the ids of each whole text.

    Equal to the library's ``encode`` without begin and end ids.  Null text: empty, no ids.
    An input column named like ``ids`` is replaced; repeated rows each give a row; an empty
    table gives an empty one.
    """
    docs = docs.drop(ids)
    chars = X.total_chars(docs, text)
    buckets = X.parts(chars, BUCKET_CHARS)
    key = F.xxhash64(*[c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")])
    blocked = docs.withColumn(X.BLOCK, F.pmod(key, F.lit(X.parts(chars, BLOCK_CHARS))))
    asks = X.ask(blocked, lambda table: _Words(table, text, buckets).questions())
    replies = X.answer(asks, lambda payloads: _segment(model, payloads))

    def finish(table, replies):
        block = _Words(table, text, buckets)
        found = [x for payload in X.replies_of(replies) for x in _unpack_ids(payload)]
        held = dict(zip(block.words, found)).__getitem__
        parts = [b"".join(map(held, marked_words(x))) for x in block.texts()]
        del block, found, held
        ends = np.cumsum([0, *(len(part) // 4 for part in parts)])
        values = np.frombuffer(b"".join(parts), "<i4")
        del parts
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return table.drop_columns([X.BLOCK]).append_column(ids, column)

    fields = [*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return X.tagged(blocked, replies, finish, T.StructType(fields))


class _Decoder:
    """Texts of ids, put together from the bytes of their pieces.

    A byte piece is its byte, any other its characters with spaces for marks; the first mark of
    a text is left out.  Rows with ids that are no ordinary pieces, and those whose bytes are no
    UTF-8 (byte pieces that make no whole character), are left to the library as a whole.
    """

    def __init__(self, path: str):
        self.model = processor(path)
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        self.marked = np.array([name.startswith(MARK) for name in names])
        special = (self.model.is_control, self.model.is_unknown, self.model.is_unused)
        self.special = np.array([any(test(i) for test in special) for i in range(count)])
        single = [self.model.is_byte(i) for i in range(count)]
        # A byte piece is written <0xHH>.
        self.pieces = pa.array(
            [bytes([int(name[3:5], 16)]) if byte else name.replace(MARK, " ").encode() for name, byte in zip(names, single)],
            pa.binary(),
        )
        plain = [i for i in range(count) if not (self.special[i] or single[i])]
        before = self.model.encode("a")
        # Behind another word nothing is stripped.
        alone = self.model.decode([[*before, i] for i in plain])
        if any(text != "a" + names[i].replace(MARK, " ") for i, text in zip(plain, alone)):
            raise ValueError(f"{path}: a piece is changed when it is decoded")

    def texts(self, column: pa.ListArray) -> list[str]:
        lengths = np.array([x or 0 for x in pc.list_value_length(column).to_pylist()], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        values = column.flatten().to_numpy().astype("<i4")
        first_marked = np.zeros(len(lengths), np.int64)
        first_marked[lengths > 0] = self.marked[values[starts[lengths > 0]]]
        offsets = pa.array(np.r_[0, ends].astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, self.pieces.take(pa.array(values))), b"")
        odd = np.flatnonzero(self.special[values])
        whole = set(np.searchsorted(ends, odd, side="right").tolist())
        texts = []
        for row, (data, cut) in enumerate(zip(joined.to_pylist(), first_marked.tolist())):
            try:
                text = None if row in whole else data[cut:].decode()
            except UnicodeDecodeError:
                text = None
            if text is None:
                text = self.model.decode(values[starts[row] : ends[row]].tolist())
            texts.append(text)
        return texts


def decode(encoded: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: what the library's ``decode`` gives for each row's ids.

    Null or no ids: an empty text.  An input column named like ``decoded`` is replaced.
    """
    encoded = encoded.drop(decoded)
    place = encoded.columns.index(ids)

    def run(batches):
        reader = _Decoder(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = pa.array(reader.texts(part.column(place)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, decoded])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded, T.StringType())]))


def op2(docs: DataFrame, model: str) -> DataFrame:
    """Digests of ids and decoded text."""
    rows = decode(encode(docs.select("doc_id", "text"), model).select("doc_id", "ids"), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
