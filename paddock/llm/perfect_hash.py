"""A minimal perfect hash of whole numbers, with the keys kept to verify an answer.

Keys that meet no other at their place of a level's bit table get that place; the others go
on to the next, smaller level.  A key's number is the rank of its bit among all set bits, so
n keys are numbered 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from .texts import mixed

#: Places of a level for each key that comes to it.
ROOM = 2.0
_SEEDS = np.random.default_rng(20240801).integers(1, 2**63, 64, dtype=np.uint64)


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        """``keys``: distinct uint64 numbers."""
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        numbered, left = 0, keys
        while len(left):
            size = int(len(left) * ROOM) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.zeros(-(-size // 64) * 8, np.uint8)
            packed = np.packbits(alone, bitorder="little")
            words[: len(packed)] = packed
            words = words.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, numbered + np.cumsum(ones) - ones, size))
            numbered += int(ones.sum())
            left = left[~alone[place]]
        self.keys = np.zeros(numbered, np.uint64)
        self.keys[self._numbers(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        scrambled = mixed(keys ^ _SEEDS[level % len(_SEEDS)]) if level < len(_SEEDS) else mixed(mixed(keys) + np.uint64(level))
        return (scrambled % np.uint64(size)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        numbers = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, before, size) in enumerate(self.levels):
            place = self._place(keys[open_], level, size)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            held = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            numbers[open_[held]] = (before[word] + below)[held]
            open_ = open_[~held]
            if not len(open_):
                break
        return numbers

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that was not among those given."""
        numbers = self._numbers(keys)
        known = numbers >= 0
        known[known] = self.keys[numbers[known]] == keys[known]
        return np.where(known, numbers, -1)

    def __len__(self) -> int:
        return len(self.keys)
