"""A bitwise model of symbols in order: hashed contexts whose log odds are mixed online.

Symbols are coded by a prefix code; each bit of a symbol is predicted at its node of the code
by how often either value followed there, and by what followed there after the last one, two,
three (or more) symbols of its sequence, counted in hashed tables.  The predictors' log odds
are added up with weights that an online logistic mixer learns, one set of weights for each
degree of evidence (the gate); an adaptive map then corrects the mixed probability by what
came of similar ones.

All of it works on numpy arrays of the bits of many symbols.  :mod:`lm_scoring` uses it twice:
for the words of texts and for the bytes of words that were never learnt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: log2 of the slots of a table: as many as the learnt symbols ask for, between these.
LEAST_SLOTS, MOST_SLOTS = 12, 21
GATES, STEPS, NODES = 64, 24, 512
#: Symbols whose bits are at hand at once.
STEP = 1 << 13
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xC2B2AE3D27D4EB4F)
_RATE = 0.02


def _paths(weights: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Inner nodes and bits on the way to each symbol of a Huffman code."""
    heap = [(float(w) + 1.0, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children = {}
    while len(heap) > 1:
        (w0, _, left), (w1, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        node = len(weights) + len(children)
        children[node] = (left, right)
        heapq.heappush(heap, (w0 + w1, node, node))
    paths, stack = {}, [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node in children:
            for bit, child in enumerate(children[node]):
                stack.append((child, [*path, (node - len(weights), bit)]))
        else:
            paths[node] = path
    return paths


@dataclass
class Code:
    """A prefix code: each symbol's nodes and bits side by side, and each node's log odds of a one."""

    lengths: np.ndarray
    offsets: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Code:
        """The code of symbols that were met ``weights`` times."""
        paths = _paths(weights)
        lengths = np.array([len(paths[s]) for s in range(len(weights))])
        steps = np.array([step for s in range(len(weights)) for step in paths[s]])
        nodes, bits = steps[:, 0], steps[:, 1].astype(np.int8)
        weight = np.repeat(np.asarray(weights, np.float64), lengths)
        ones, all_ = (np.bincount(nodes, w, len(weights)) for w in (weight * bits, weight))
        odds = np.log((ones + 0.4) / (all_ - ones + 0.4)).astype(np.float32)
        return cls(lengths, np.cumsum(lengths) - lengths, nodes.astype(np.uint64), bits, odds)


@dataclass
class Model:
    """A code, the lengths of contexts, and for each the counts of zeros and ones in each slot."""

    code: Code
    orders: tuple[int, ...]
    log_slots: int
    counts: list[np.ndarray]

    @classmethod
    def empty(cls, weights: np.ndarray, orders: tuple[int, ...], kind=np.float64) -> Model:
        log_slots = int(np.clip(np.ceil(np.log2(weights.sum() * 2 + 1)), LEAST_SLOTS, MOST_SLOTS))
        return cls(Code.of(weights), orders, log_slots, [np.zeros(2 << log_slots, kind) for _ in orders])

    @property
    def inputs(self) -> int:
        return len(self.orders) + 2


@dataclass
class Bits:
    """The bits of some symbols in order: value, code node, a slot in each table; each symbol's first."""

    value: np.ndarray
    node: np.ndarray
    slots: list[np.ndarray]
    starts: np.ndarray


def _scattered(values: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64 bits (the last steps of splitmix64)."""
    values = (values + _ODD) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def steps(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> Iterator[Bits]:
    """The bits of sequences of ``sizes`` symbols, ``STEP`` symbols at a time.

    A context reaches over the edges of steps, but not over those of sequences.
    """
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # 0 stands before the first symbol
    symbol = symbols.astype(np.uint64) + np.uint64(1)
    context, contexts = np.zeros(len(symbols), np.uint64), []
    for back in range(1, max(model.orders) + 1):
        before = np.zeros(len(symbols), np.uint64)
        before[back:] = symbol[:-back]
        before[place < back] = 0
        context = _scattered(context * _NODE + before)
        if back in model.orders:
            contexts.append(context)
    code, shift = model.code, np.uint64(64 - model.log_slots)
    for first in range(0, len(symbols), STEP):
        some = symbols[first : first + STEP]
        length = code.lengths[some]
        starts = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(code.offsets[some] - starts, length)
        node = code.nodes[at]
        salt = node * _NODE
        slots = [((np.repeat(c[first : first + STEP], length) ^ salt) * _ODD >> shift).astype(np.int64) for c in contexts]
        yield Bits(code.bits[at], node.astype(np.int64), slots, starts)


def count(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> None:
    for bits in steps(model, symbols, sizes):
        for table, slot in zip(model.counts, bits.slots):
            np.add.at(table, 2 * slot + bits.value, np.ones(len(slot), table.dtype))


@dataclass
class Mixer:
    """Weights of the predictors (and a bias) for each gate, and the adaptive map."""

    weights: np.ndarray
    squares: np.ndarray
    seen: np.ndarray
    ones: np.ndarray

    @classmethod
    def new(cls, inputs: int) -> Mixer:
        cells = NODES * STEPS
        shape = (inputs, GATES)
        return cls(np.full(shape, 0.3, np.float32), np.zeros(shape, np.float32), np.zeros(cells), np.zeros(cells))

    def state(self, share: float) -> np.ndarray:
        """What is added up to get the weighted mean of mixers learnt apart."""
        return np.concatenate([self.weights.ravel() * np.float64(share), self.seen, self.ones, [share]])

    @classmethod
    def of_state(cls, state: np.ndarray, inputs: int) -> Mixer:
        mixer = cls.new(inputs)
        if state[-1]:
            size, cells = mixer.weights.size, len(mixer.seen)
            mixer.weights = (state[:size] / state[-1]).reshape(inputs, GATES).astype(np.float32)
            mixer.seen, mixer.ones = state[size : size + cells], state[size + cells : -1]
        return mixer


def _levels(total: np.ndarray) -> np.ndarray:
    return (total > 0).view(np.int8) + (total > 3) + (total > 31)


@dataclass
class Evidence:
    """Log odds of every slot, worked out once; the last two of their bits are the degree of evidence."""

    odds: list[np.ndarray]

    @classmethod
    def of(cls, model: Model) -> Evidence:
        odds = []
        for pairs in (table.reshape(-1, 2) for table in model.counts):
            plain = np.log((pairs[:, 1] + 0.4) / (pairs[:, 0] + 0.4)).astype(np.float32).view(np.int32)
            odds.append((plain & ~3 | _levels(pairs[:, 0] + pairs[:, 1])).view(np.float32))
        return cls(odds)


def _mixed(mixer: Mixer, rows: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    odds = mixer.weights[-1][gate]
    for weights, row in zip(mixer.weights, rows):
        odds += weights[gate] * row
    return np.clip(odds, np.float32(-14), np.float32(14))


def _gate(levels: list[np.ndarray]) -> np.ndarray:
    """From the degrees of evidence of the three longest contexts."""
    gate = levels[-1]
    for place, level in enumerate(levels[-3:-1], 1):
        gate = gate + (level << 2 * place)
    return gate.astype(np.int64)


def _cells(odds: np.ndarray, node: np.ndarray, symbols: int) -> np.ndarray:
    # Nodes near the root have the highest numbers.
    near = np.minimum(symbols - 2 - node, NODES - 1)
    return near * STEPS + np.clip(odds * np.float32(1.2) + np.float32(STEPS / 2), 0, STEPS - 1).astype(np.int64)


def learn(mixer: Mixer, model: Model, symbols: np.ndarray, sizes: np.ndarray) -> None:
    """Online steps over sequences that the tables have counted, each bit's own count left out."""
    for bits in steps(model, symbols, sizes):
        rows, levels, value = [model.code.odds[bits.node]], [], bits.value.astype(np.float32)
        for table, slot in zip(model.counts, bits.slots):
            zeros, ones = table[2 * slot], table[2 * slot + 1]
            ones = np.maximum(ones - value, np.float32(0))
            zeros = np.maximum(zeros - (1 - value), np.float32(0))
            rows.append(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))))
            levels.append(_levels(zeros + ones))
        gate = _gate(levels)
        odds = _mixed(mixer, rows, gate)
        chance = 1 / (1 + np.exp(-odds))
        cells = _cells(odds, bits.node, len(model.code.lengths))
        mixer.seen += np.bincount(cells, minlength=len(mixer.seen))
        mixer.ones += np.bincount(cells, value, len(mixer.ones))
        error = value - chance
        total = np.bincount(gate, minlength=GATES) + 1
        for i, row in enumerate([*rows, np.float32(1)]):
            slope = np.bincount(gate, error * row, GATES) / total
            mixer.squares[i] += slope**2
            mixer.weights[i] += _RATE * slope / np.sqrt(mixer.squares[i] + 1e-8)


def scored(mixer: Mixer, model: Model, evidence: Evidence, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log2 of the probability of each symbol after those before it in its sequence."""
    logs = [np.empty(0)]
    adapted = ((mixer.ones + 0.4) / (mixer.seen + 0.8)).astype(np.float32)
    trust = (mixer.seen / (mixer.seen + 8) / 2).astype(np.float32)
    for bits in steps(model, symbols, sizes):
        rows = [model.code.odds[bits.node], *(table[slot] for table, slot in zip(evidence.odds, bits.slots))]
        gate = _gate([row.view(np.int32) & 3 for row in rows[1:]])
        odds = _mixed(mixer, rows, gate)
        chance = 1 / (1 + np.exp(-odds))
        cells = _cells(odds, bits.node, len(model.code.lengths))
        chance += trust[cells] * (adapted[cells] - chance)
        # A bit's chances are within 1e-6 of 0 and 1, and add up to 1.
        chance = np.clip(np.where(bits.value == 1, chance, 1 - chance), np.float32(1e-6), np.float32(1 - 1e-6))
        logs.append(np.add.reduceat(np.log2(chance), bits.starts, dtype=np.float64))
    return np.concatenate(logs)
