"""Words of whole texts and 64-bit hashes of words and word windows, for use in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# Odd 64-bit multipliers, one for each place in a window.
_PLACES = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each distinct word that a task meets."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def raw_texts(column: pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; a null text counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but space and 0x09 to 0x0D; ``bytes.split`` parts at just these."""
    return text.split()


def hashes_of(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that any bits of the result can serve as a bucket."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values: n - size + 1 of them, none if n < size."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place in range(size):
        total += hashes[place : place + count] * _PLACES[place]
    return mixed(total)


class WordBlock:
    """The words of several documents in one array.

    ``hashes`` holds all words, ``start`` and ``end`` each document's place there, and
    ``doc`` the document of each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        table = WordHashes()
        self.words = [words_of(text.lower() if lower else text) for text in texts]
        lengths = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        self.lengths = lengths
        self.hashes = np.empty(int(lengths.sum()), np.uint64)
        for words, start, end in zip(self.words, self.start, self.end):
            self.hashes[start:end] = hashes_of(words, table)
        self.doc = np.repeat(np.arange(len(texts)), lengths)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words that lie in one document, and their places."""
        found = window_hashes(self.hashes, size)
        place = np.arange(len(found))
        inside = place + size <= self.end[self.doc[: len(found)]]
        return found[inside], place[inside]
