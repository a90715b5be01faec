"""Compact bytes for lists of words and whole numbers."""

from __future__ import annotations

import zlib

import numpy as np


#: Longest beginning that a word takes over from the word before it.
SHARED = 24


def pack_words(words: list[bytes]) -> bytes:
    """``words``, best sorted: of each only what differs from the beginning of the one before."""
    count = len(words)
    sizes = np.fromiter(map(len, words), np.int64, count)
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    # The first bytes of all words, side by side; past its end a word holds no byte.
    heads = np.full((count, SHARED), -1, np.int16)
    for place in range(SHARED):
        long = np.flatnonzero(sizes > place)
        heads[long, place] = data[starts[long] + place]
    shared = np.zeros(count, np.int64)
    same = (heads[1:] == heads[:-1]) & (heads[1:] >= 0)
    shared[1:] = np.logical_and.accumulate(same, axis=1).sum(1)
    rest = np.arange(len(data)) - np.repeat(starts, sizes) >= np.repeat(shared, sizes)
    head = np.array([count], "<u4").tobytes()
    return zlib.compress(head + shared.astype(np.uint8).tobytes() + columns(sizes - shared) + data[rest].tobytes(), 6)


def unpack_words(payload: bytes) -> list[bytes]:
    data = zlib.decompress(payload)
    count = int(np.frombuffer(data, "<u4", 1)[0])
    shared = np.frombuffer(data, np.uint8, count, 4).tolist()
    ends = 4 + 5 * count + np.cumsum(uncolumns(data, count, 4 + count), dtype=np.int64)
    words, word, start = [], b"", 4 + 5 * count
    for taken, end in zip(shared, ends.tolist()):
        word = word[:taken] + data[start:end]
        words.append(word)
        start = end
    return words


def columns(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def uncolumns(data: bytes, count: int, offset: int) -> np.ndarray:
    stacked = np.frombuffer(data, np.uint8, 4 * count, offset).reshape(4, count)
    return np.ascontiguousarray(stacked.T).view("<u4").reshape(-1)


def wide_columns(values: np.ndarray) -> bytes:
    """``columns`` of whole numbers up to 2 ** 63."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def wide_uncolumns(data: bytes, count: int) -> np.ndarray:
    stacked = np.frombuffer(data, np.uint8, 8 * count).reshape(8, count)
    return np.ascontiguousarray(stacked.T).view("<i8").reshape(-1)
