"""Tokens of two tokenizers aligned by bytes, with corpus-wide counts of linked id pairs.

Both tokenizers part a text before a space that follows something else, so a text is a
sequence of words (a run of spaces and what follows) that are aligned each for itself: a
block of documents aligns each distinct word once.

First pass: each block counts in how many of its documents an id pair is linked, and sends
its distinct pairs by bucket of their hash.  A bucket numbers its pairs by a minimal perfect
hash and adds the blocks' counts up in a dense vector indexed by it: sums go from documents
to blocks to buckets, and no vector is longer than a bucket.  A pair that a third of all
documents hold is one entry for each block.  Second pass: blocks are aligned again, and
get the counts of their pairs, verified against the hash's keys, in the order they asked.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .byte_bpe import PATTERN, load_ranks
from .perfect_hash import PerfectHash
from .scratch import Scratch
from .sentencepiece_codec import MARK, processor
from .texts import mixed

#: Characters in a block of documents, and in the documents that share a bucket of pairs.
BLOCK_CHARS, BUCKET_CHARS = 6 << 20, 48 << 20
#: Links expanded at once, and words whose tokens are looked up at once.
EXPANDED, LEARNT = 2 << 20, 20_000
#: Bits of a token id in a pair.
BITS = 20
_LOW = np.uint64((1 << BITS) - 1)
_WHITE_THEN_SPACE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, byte_bpe: str, pieces: str):
        ranks = load_ranks(byte_bpe)
        self.a = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = processor(pieces)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.a_sizes[rank] = len(token)
        self.b_bytes = [self._bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_sizes = np.array([len(token) for token in self.b_bytes], np.int64)
        if max(len(self.a_sizes), len(self.b_sizes)) > 1 << BITS:
            raise ValueError(f"a vocabulary has more than {1 << BITS} ids")
        self.mark = [self.b.piece_to_id(MARK)]
        # An id as text and what stands behind it: of A ',' or '|' at the group's end, of B ',' or ';'.
        self.shown = [b"%d%c" % (i, end) for ends in (b",|", b",;") for i in range(self._most()) for end in ends]

    def _most(self) -> int:
        return max(len(self.a_sizes), len(self.b_sizes))

    def _bytes(self, piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def a_ids(self, rests: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and ``rest`` for each rest, and how many each has.

        Rests that end in no white space are encoded in one text and parted by their ``sizes``
        in bytes.
        """
        apart = [i for i, rest in enumerate(rests) if not rest or rest[-1].isspace()]
        single = [np.array(self.a.encode_ordinary(" " + rests[i]), np.int32) for i in apart]
        joined = np.ones(len(rests), bool)
        joined[apart] = False
        text = " " + " ".join(rest for rest, one in zip(rests, joined.tolist()) if one) if joined.any() else ""
        ids = np.array(self.a.encode_ordinary(text), np.int32)
        cuts = np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum(sizes[joined])) + 1
        counts = np.zeros(len(rests), np.int64)
        counts[joined] = np.diff(cuts, prepend=0)
        counts[apart] = [len(part) for part in single]
        if apart:
            parts = iter(np.split(ids, cuts[:-1])) if len(cuts) else iter(())
            ones = iter(single)
            ids = np.concatenate([np.empty(0, np.int32), *(next(parts) if one else next(ones) for one in joined.tolist())])
        return ids, counts

    def b_ids(self, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each rest, the library puts the space before it; and how many each has."""
        found = [ids if rest else self.mark for rest, ids in zip(rests, self.b.encode(rests, num_threads=1))]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_bpe: str, pieces: str) -> Tokenizers:
    """Those of this worker process."""
    key = (byte_bpe, pieces)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(*key)
    return _LOADED[key]


def words_of(text: str) -> list[str]:
    """The words of a space and ``text``, each without its first space."""
    if not text:
        return []
    if text[0] != " " and not _WHITE_THEN_SPACE.search(text):
        return text.split(" ")
    return [word[1:] for word in _BEFORE_SPACE.split(" " + text)]


class _Numbered(dict):
    """A number for each different word, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _runs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class WordTable:
    """Tokens, groups and links of distinct words; a word whose B bytes are not its own is ``odd`` and has none."""

    def __init__(self, rests: list[str], made: Tokenizers):
        self.made = made
        odd = np.zeros(len(rests), bool)
        sizes = np.zeros(len(rests), np.int64)
        a_parts, b_parts, a_counts, b_counts = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [], []
        for first in range(0, len(rests), LEARNT):
            some = rests[first : first + LEARNT]
            whole = (" " + " ".join(some)).encode()
            size = np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)) + 1
            b, b_count = made.b_ids(some)
            a, a_count = made.a_ids(some, size)
            strange = self._strange(b, b_count, size, whole)
            if strange.any():
                b, a = b[np.repeat(~strange, b_count)], a[np.repeat(~strange, a_count)]
                size, a_count, b_count = (np.where(strange, 0, count) for count in (size, a_count, b_count))
                odd[first : first + len(some)] = strange
            sizes[first : first + len(some)] = size
            a_parts.append(a)
            b_parts.append(b)
            a_counts.append(a_count)
            b_counts.append(b_count)
        self.a_first = _runs(np.concatenate([np.empty(0, np.int64), *a_counts]))
        self.b_first = _runs(np.concatenate([np.empty(0, np.int64), *b_counts]))
        self.a, self.b = np.concatenate(a_parts).astype(np.int64), np.concatenate(b_parts).astype(np.int64)
        self.odd = odd
        a_ends, b_ends = np.cumsum(made.a_sizes[self.a]), np.cumsum(made.b_sizes[self.b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        # Words end in a place of `common`, in their order; odd words are of no size and hold none.
        self.group_word = np.searchsorted(np.cumsum(sizes), common)
        self.n_groups = np.bincount(self.group_word, minlength=len(rests))
        links = np.bincount(self.a_group, minlength=len(common)) * np.bincount(self.b_group, minlength=len(common))
        self.n_links = np.zeros(len(rests), np.int64)
        np.add.at(self.n_links, self.group_word, links)
        self._link(len(rests))

    def _strange(self, b: np.ndarray, counts: np.ndarray, size: np.ndarray, whole: bytes) -> np.ndarray:
        """Which words' B bytes are not their own; ``whole`` are all words' bytes."""
        pieces = self.made.b_bytes
        reach = _runs(self.made.b_sizes[b])[_runs(counts)]
        if (np.diff(reach) == size).all() and b"".join(map(pieces.__getitem__, b.tolist())) == whole:
            return np.zeros(len(size), bool)
        ends, cuts = _runs(size).tolist(), _runs(counts).tolist()
        found = ([pieces[i] for i in b[j:k].tolist()] for j, k in zip(cuts, cuts[1:]))
        return np.array([b"".join(x) != whole[i:j] for x, i, j in zip(found, ends, ends[1:])], bool)

    def _link(self, words: int) -> None:
        """The distinct pairs of all words, and for each word which of them it links how often."""

        def distinct(group, ids):
            keys, times = np.unique((group << BITS) | ids, return_counts=True)
            return keys >> BITS, keys & int(_LOW), times

        a_group, a, a_times = distinct(self.a_group, self.a)
        b_group, b, b_times = distinct(self.b_group, self.b)
        b_first = _runs(np.bincount(b_group, minlength=len(self.group_word)))
        partners = np.diff(b_first)[a_group]
        reach = _runs(partners)
        parts = []
        start = 0
        while start < len(a):
            end = max(start + 1, int(np.searchsorted(reach, reach[start] + EXPANDED, side="right")) - 1)
            count = partners[start:end]
            at = np.repeat(np.arange(start, end), count)
            other = np.arange(len(at)) - np.repeat(reach[start:end] - reach[start], count) + b_first[a_group[at]]
            pair = (a[at].astype(np.uint64) << np.uint64(BITS)) | b[other].astype(np.uint64)
            parts.append(self._summed(self.group_word[a_group[at]], pair, a_times[at] * b_times[other]))
            start = end
        if len(parts) == 1:
            word, pair, self.times = parts[0]
        else:
            empty = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
            word, pair, self.times = self._summed(*(np.concatenate(column) for column in zip(empty, *parts)))
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.word = word
        self.first = _runs(np.bincount(word, minlength=words))

    @staticmethod
    def _summed(word, pair, times):
        """Times added up for each word and pair, in that order."""
        few = len(word) == 0 or int(word.max()) < 1 << (63 - 2 * BITS)
        order = np.argsort((word.astype(np.uint64) << np.uint64(2 * BITS)) | pair, kind="stable") if few else np.lexsort((pair, word))
        word, pair, times = word[order], pair[order], times[order]
        if not len(word):
            return word, pair, times
        new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])])
        return word[new], pair[new], np.add.reduceat(times, new)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """The sum over each word's links of its pairs' values."""
        total = np.zeros(len(self.first) - 1, np.int64)
        np.add.at(total, self.word, self.times * values[self.pair])
        return total

    def texts(self) -> list[bytes]:
        """The groups of each word as text."""
        groups = len(self.group_word)
        a_before = _runs(np.bincount(self.a_group, minlength=groups))
        b_before = _runs(np.bincount(self.b_group, minlength=groups))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[a_before[1:] - 1], b_last[b_before[1:] - 1] = True, True
        codes[np.arange(len(self.a)) + b_before[self.a_group]] = 2 * self.a + a_last
        codes[np.arange(len(self.b)) + a_before[self.b_group + 1]] = 2 * (self.b + self.made._most()) + b_last
        tokens = list(map(self.made.shown.__getitem__, codes.tolist()))
        cut = (self.a_first + self.b_first).tolist()
        return [b"".join(tokens[i:j])[:-1] for i, j in zip(cut, cut[1:])]


class Block:
    """The documents of a block as sequences of words."""

    def __init__(self, column: pa.ChunkedArray, made: Tokenizers):
        numbers, parts = _Numbered(), []
        for first in range(0, len(column), 64):
            for text in column.slice(first, 64).to_pylist():
                words = words_of(text or "")
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.table = WordTable(list(numbers), made)
        if self.table.odd.any():
            # A text with such a word is looked at as a whole: what counts is all its bytes.
            for i, part in enumerate(parts):
                if self.table.odd[part].any():
                    parts[i] = np.array([numbers[column[i].as_py()]], np.int64)
            self.table = WordTable(list(numbers), made)
            parts = [part[:0] if self.table.odd[part].any() else part for part in parts]
        self.first = _runs(np.fromiter(map(len, parts), np.int64, len(parts)))
        self.words = np.concatenate([np.empty(0, np.int64), *parts])

    @cached_property
    def pair_documents(self) -> np.ndarray:
        """In how many documents of the block each of the table's pairs is linked."""
        table = self.table
        total = np.zeros(len(table.pairs), np.int64)
        seen = np.zeros(len(table.pairs), bool)
        used = np.diff(table.first)[self.words]
        reach = _runs(used)[self.first]
        start = 0
        while start < len(self.first) - 1:
            # As many documents at once as have EXPANDED links, or one that has more.
            end = max(start + 1, int(np.searchsorted(reach, reach[start] + EXPANDED, side="right")) - 1)
            some = slice(self.first[start], self.first[end])
            count = used[some]
            at = np.arange(int(count.sum())) - np.repeat(_runs(count)[:-1] - table.first[self.words[some]], count)
            held = table.pair[at]
            cut = (reach[start : end + 1] - reach[start]).tolist()
            for i, j in zip(cut, cut[1:]):
                if 64 * (j - i) < len(total):
                    total[np.unique(held[i:j])] += 1
                else:
                    seen[:] = False
                    seen[held[i:j]] = True
                    total += seen
            start = end
        return total

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs in the order of their buckets, and the buckets."""
        bucket = X.bucket_of(mixed(self.table.pairs), buckets)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def questions(self, buckets: int) -> list[tuple[int, bytes]]:
        order, bucket = self.asked(buckets)
        pairs, counts = self.table.pairs[order], self.pair_documents[order]
        return [(b, pack(pairs[i:j], counts[i:j])) for b, i, j in X.bounds(bucket)]

    def by_document(self, by_word: np.ndarray) -> np.ndarray:
        total = _runs(by_word[self.words])
        return np.diff(total[self.first])


def pack(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers and their counts; bytes of equal weight side by side."""
    steps = np.diff(pairs, prepend=np.uint64(0)).astype("<u8")
    data = [np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes() for v in (steps, counts.astype("<u8"))]
    return zlib.compress(np.int64(len(pairs)).tobytes() + b"".join(data), 1)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(payload)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    stacked = np.frombuffer(data, np.uint8, 16 * count, 8).reshape(2, 8, count)
    steps, counts = (np.ascontiguousarray(part.T).view("<u8").reshape(-1) for part in stacked)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def count_bucket(payloads: list[bytes]) -> tuple[list[bytes], bytes]:
    """For each question the counts of its pairs over all blocks; and the highest count of each A id here."""
    asked = [unpack(payload) for payload in payloads]
    distinct = np.unique(np.concatenate([pairs for pairs, _ in asked]))
    hashed = PerfectHash(distinct)
    vector = np.zeros(len(hashed), np.int64)
    for pairs, counts in asked:
        vector[hashed(pairs)] += counts  # a question's pairs are all different
    replies = []
    for pairs, _ in asked:
        number = hashed(pairs)
        if (number < 0).any():
            raise ValueError("a pair is not among the keys of its hash")
        replies.append(zlib.compress(vector[number].astype("<u8").tobytes(), 1))
    ids, place = np.unique(hashed.keys >> np.uint64(BITS), return_inverse=True)
    highest = np.zeros(len(ids), np.int64)
    np.maximum.at(highest, place, vector)
    return replies, pack(ids, highest)


def _counted(asks: DataFrame) -> DataFrame:
    """Replies to the blocks as round 0, and each bucket's highest counts as round 1."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blocks = table["__bucket"][0].as_py(), table["__block"].to_pylist()
        replies, highest = count_bucket(table["payload"].to_pylist())
        rows = [(bucket, block, 0, reply) for block, reply in zip(blocks, replies)]
        return X.message([*rows, (bucket, -1, 1, highest)])

    return asks.groupBy("__bucket").applyInArrow(run, X.ASKS)


def _highest(replies: DataFrame) -> dict[int, int]:
    """The highest count of each A id: no more entries than the vocabulary has."""

    def rows(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                ids, counts = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(counts)], ["id", "n"])

    found = replies.where("__round = 1").select("payload").mapInArrow(rows, "id long, n long")
    return {row[0]: row[1] for row in found.groupBy("id").agg(F.max("n")).collect()}


def cross_alignment(
    docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", groups: str = "groups", digest: bool = False
) -> DataFrame:
    """``docs`` with the six numbers of ``_SUMS`` and ``groups``: ``a1,a2|b1;a3|b2`` of A and B ids.

    With ``digest`` the column holds the SHA-256 of that text instead.  Null and empty texts,
    and texts whose B bytes are not their own (they hold the mark U+2581, say), have no
    tokens: zeros and an empty text.  Repeated rows count as documents each; an empty table
    gives an empty one; input columns of the same names are replaced.
    """
    docs = docs.drop(*_SUMS, groups)
    chars = X.total_chars(docs, text)
    buckets = X.parts(chars, BUCKET_CHARS)
    key = [name for name, kind in docs.dtypes if kind in ("bigint", "int", "string")]
    blocked = X.with_blocks(docs, X.parts(chars, BLOCK_CHARS), key)
    asks = X.ask(blocked, lambda table: Block(table[text], tokenizers(byte_bpe, pieces)).questions(buckets))
    replies = Scratch().table(_counted(asks), "pair-counts")
    best = _highest(replies)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        made = tokenizers(byte_bpe, pieces)
        block = Block(table[text], made)
        order, _ = block.asked(buckets)
        counts = np.zeros(len(order), np.int64)
        found = [np.frombuffer(zlib.decompress(payload), "<u8") for payload in X.replies_of(replies)]
        counts[order] = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64)
        highest = np.zeros(len(made.a_sizes), np.int64)
        highest[list(best.keys())] = list(best.values())
        top = counts == highest[(block.table.pairs >> np.uint64(BITS)).astype(np.int64)]
        words = block.table
        sums = [np.diff(words.a_first), np.diff(words.b_first), words.n_groups, words.n_links]
        sums += [words.by_word(top.astype(np.int64)), words.by_word(counts)]
        columns = [pa.array(block.by_document(values), pa.int64()) for values in sums]
        texts, numbers = words.texts(), block.words.tolist()
        cut = block.first.tolist()
        shown = (b";".join(map(texts.__getitem__, numbers[i:j])) for i, j in zip(cut, cut[1:]))
        if digest:
            shown = (hashlib.sha256(x).hexdigest() if x else "" for x in shown)
            columns.append(pa.array(shown, pa.string()))
        else:
            columns.append(pa.array(shown, pa.binary()).cast(pa.string()))
        kept = table.drop_columns([X.BLOCK])
        return pa.table([*kept.columns, *columns], names=[*kept.column_names, *_SUMS, groups])

    added = [*(T.StructField(name, T.LongType()) for name in _SUMS), T.StructField(groups, T.StringType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return X.tagged(blocked, replies.where("__round = 0"), finish, schema)


def op11(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """The numbers and the digest of the groups for each document."""
    found = cross_alignment(docs.select("doc_id", "text"), byte_bpe, pieces, groups="groups_sha256", digest=True)
    return found.select("doc_id", *_SUMS, "groups_sha256")
