"""Token ids of a byte-level BPE, segmenting each distinct chunk of text once a task.

The tokenizer file is the JSON of the ``tokenizers`` library.  Its merges stand in the
order of the ids they make, which is what a rank table says too, so the ids can come from
``tiktoken``; loading checks that order.  Added tokens of the file are found in texts first,
as the library does, and what lies between two of them is a text of its own.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: What the file's pre-tokenizer parts texts at (a fixed value of byte-level BPE).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks held at most; beyond, the table starts anew.
HELD = 400_000
_WHITE_THEN_SPACE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def _bytes_by_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], _bytes_by_letter()
    if model["type"] != "BPE" or content["pre_tokenizer"]["type"] != "ByteLevel" or content.get("normalizer"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    special = {token["content"] for token in content.get("added_tokens", ())}
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    ids = [model["vocab"][left + right] for left, right in merges]
    if ids != list(range(256, 256 + len(ids))):
        raise ValueError(f"merges of {path} are not in the order of their ids")
    return {
        bytes(letters[letter] for letter in token): rank
        for token, rank in model["vocab"].items()
        if token not in special
    }


def load_added(path: str) -> dict[str, int]:
    """The added tokens, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", ())
    if any(token.get(flag) for token in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has added tokens that take or need what is around them")
    return {token["content"]: token["id"] for token in added}


class ChunkTable:
    """ids of texts as little-endian unsigned 32-bit bytes.

    Tokens never cross from a character that is not white space to a space after it, so a
    text is the sequence of its chunks, parted there.
    """

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.held: dict[str, bytes] = {}
        added = load_added(path)
        self.added = {content: np.array([id_], "<u4").tobytes() for content, id_ in added.items()}
        # Of tokens that begin at one place the longest counts.
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(longest)})") if added else None

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, rests: list[str]) -> None:
        """Encode ' ' + rest for each rest; those in one text part again by their sizes."""
        apart = [rest for rest in rests if not rest or rest[-1].isspace()]
        for rest in apart:
            self.held[rest] = self._ids(" " + rest)
        joined = [rest for rest in rests if rest and not rest[-1].isspace()]
        if not joined:
            return
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(joined)), "<u4")
        reach = np.cumsum(self.sizes[ids])
        ends = np.cumsum(np.fromiter((len(rest.encode()) + 1 for rest in joined), np.int64, len(joined)))
        cuts = np.searchsorted(reach, ends) + 1
        data = ids.tobytes()
        start = 0
        for rest, cut in zip(joined, (cuts * 4).tolist()):
            self.held[rest] = data[start:cut]
            start = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.at_added is None:
            return self._encode(texts)
        # Odd places of a split text are added tokens.
        split = {i: self.at_added.split(text) for i, text in enumerate(texts) if self.at_added.search(text)}
        plain = self._encode([text for i, text in enumerate(texts) if i not in split])
        between = iter(self._encode([text for parts in split.values() for text in parts[::2]]))
        rest = iter(plain)
        return [
            b"".join(self.added[part] if k % 2 else next(between) for k, part in enumerate(split[i])) if i in split else next(rest)
            for i in range(len(texts))
        ]

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [
            text.split(" ") if not _WHITE_THEN_SPACE.search(text) else self._parted(text) for text in texts
        ]
        new = set()
        for part in parts:
            new.update(part[1:])
        if len(self.held) > HELD:
            self.held.clear()
        self._learn([rest for rest in new if rest not in self.held])
        held = self.held.__getitem__
        return [self._ids(part[0]) + b"".join(map(held, part[1:])) if part else b"" for part in parts]

    @staticmethod
    def _parted(text: str) -> list[str]:
        first, *others = _BEFORE_SPACE.split(text)
        return [first, *(chunk[1:] for chunk in others)]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """The table of this worker process."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]
