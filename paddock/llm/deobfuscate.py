"""Restoring words written in leetspeak, spaced out, or with drawn-out letters.

The writer meant a word and a channel changed it: letters became look-alike signs,
separators or spaces came between letters, letters were repeated.  A suspicious token is a
lattice of what each sign may stand for (a letter, or nothing); the Viterbi search finds
the readings that are most probable under a character trigram model of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

#: Letters of the model: 0 edge, then a-z and U+00DF to U+00FF, last any other sign.
LETTERS = [*range(0x61, 0x7B), *range(0xDF, 0x100)]
SIZE = len(LETTERS) + 2
OTHER = SIZE - 1
CLASS = np.full(0x180, OTHER, np.int64)
CLASS[LETTERS] = np.arange(1, OTHER)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS_OF = {chr(code): i + 1 for i, code in enumerate(LETTERS)}

# What look-alike signs stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
SEPARATORS = ".-_*·~/\\ "
#: Natural logarithms of the channel: a look-alike, a dropped repeat, a separator that
#: stands in a word, a space that ends one, any other dropped sign.
LOOK, REPEAT, WITHIN, BETWEEN, DROP = -1.5, -1.0, -0.1, -3.0, -6.0
#: Tokens that stay longer with each run of a sign as one (keys, digests) are not words and
#: are not read, unless separators part their signs or words; readings kept for each state.
LONGEST, READINGS = 32, 4
#: Signs of a spaced run that are read at once; parts overlap by half, so that a word of up
#: to that many letters is whole in one of them.
PART = 64

_EDGES = re.compile(r"^[^\w$@!|+€£(]+|([^\w])\1+$|[^\w$@€£+]+$")
_LEET = re.compile(r"^(?=.*[^\W\d_])(?=.*[0-9@$!|+€£(])[\w@$!|+€£(]+$")
_SPLIT = re.compile(r"^(?:[\w@$!|+€£(][.\-_*·~/\\ ]){2,}[\w@$!|+€£(]$")
_DRAWN = re.compile(r"(.)\1\1|(.)\2.*(.)\3.*(.)\4")
_BETWEEN = re.compile(r"[.\-_*·~/\\]+")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Single signs with spaces between them.
SPACED = re.compile(r"(?<!\S)(?:[\w@$!|+€£(] ){2,}[\w@$!|+€£(](?!\S)")


def char_counts(text: str) -> np.ndarray:
    """Counts of all letter trigrams of ``text``, one flat array."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kinds = np.where(codes < len(CLASS), CLASS[np.minimum(codes, len(CLASS) - 1)], OTHER)
    kinds = np.concatenate([[0, 0], kinds, [0]])
    # Behind an edge the letter before it says nothing.
    first = np.where(kinds[1:-1] == 0, 0, kinds[:-2])
    return np.bincount((first * SIZE + kinds[1:-1]) * SIZE + kinds[2:], minlength=SIZE**3)


class Letters:
    """Log probability of a letter after two others, from trigram counts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).astype(np.float32)


def plain(token: str) -> str:
    """A token without the punctuation around it."""
    return _EDGES.sub("", _EDGES.sub("", token))


def suspicious(token: str) -> bool:
    if " " in token:
        return True
    if len(token) < 3 or token.isalpha() and not _DRAWN.search(token):
        return False
    if _SPLIT.match(token):
        return True
    if len(_RUN.sub(r"\1", token)) > LONGEST:
        return False
    digits = sum(map(str.isdigit, token))
    return bool(_LEET.match(token)) and digits <= 0.6 * len(token) or token.isalpha()


def readings(token: str, letters: Letters) -> list[str]:
    """The most probable readings of a suspicious token, best first."""
    log = letters.log.item
    # state: last two classes -> the best (score, text) that end so
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for sign in token:
        options = [(LOOK, x) for x in LOOKALIKE.get(sign, "")]
        if sign in _CLASS_OF:
            options.append((0.0, sign))
        grown: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for score, text in paths:
                for cost, letter in options:
                    kind = _CLASS_OF[letter]
                    grown.setdefault((b, kind), []).append((score + cost + log(a, b, kind), text + letter))
                    if text and text[-1] == letter:
                        grown.setdefault((a, b), []).append((score + cost + REPEAT, text))
                if sign not in _CLASS_OF:
                    cost = WITHIN if sign in SEPARATORS else DROP
                    grown.setdefault((a, b), []).append((score + cost, text))
                if sign == " " and text and text[-1] != " ":
                    grown.setdefault((0, 0), []).append((score + BETWEEN + log(a, b, 0), text + " "))
        states = {state: _best(paths) for state, paths in grown.items()}
        if not states:
            return []
    ended = [(score + log(a, b, 0), text) for (a, b), paths in states.items() for score, text in paths if text]
    return [text for _, text in _best(ended)]


def _best(paths: Iterable[tuple[float, str]]) -> list[tuple[float, str]]:
    best: dict[str, float] = {}
    for score, text in paths:
        if score > best.get(text, -1e30):
            best[text] = score
    return sorted(((score, text) for text, score in best.items()), reverse=True)[:READINGS]


def restored(token: str, letters: Letters) -> list[str]:
    """What a token may mean: itself, and the words of its readings if it looks obfuscated."""
    word = plain(token)
    if not word:
        return []
    # No word has a sign four times in a row; what a longer run adds is the same for all readings.
    short = _LONG_RUN.sub(r"\1\1\1", word) if len(word) > LONGEST else word
    if len(short) > LONGEST and not _SPLIT.match(short) and " " not in short:
        # Words with separators between them: each is read for itself.
        parts = [part for part in _BETWEEN.split(short) if part]
        if len(parts) > 1:
            return [word, *(reading for part in parts for reading in restored(part, letters))]
    if not suspicious(short):
        return [word]
    return [word, *(part for piece in _pieces(short) for reading in readings(piece, letters) for part in reading.split())]


def _pieces(token: str) -> list[str]:
    """Overlapping parts of a long token of single signs and separators, else the token."""
    step = PART  # signs and separators of half a part
    if len(token) <= 2 * PART or not (" " in token or _SPLIT.match(token)):
        return [token]
    return [token[first : first + 2 * step - 1] for first in range(0, len(token) - step, step)]


def tokens_of(text: str) -> list[str]:
    """Lower-cased tokens, with spaced-out words as one token each."""
    text = text.lower()
    tokens = text.split()
    for run in SPACED.findall(text):
        tokens += _pieces(run)
    return tokens
