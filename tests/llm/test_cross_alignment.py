import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts_helper import ODD_ROWS, documents, frame
from tokenizers import Tokenizer

from paddock.llm import cross_alignment as cross
from paddock.llm.perfect_hash import PerfectHash

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    letters = {}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    letters.update({chr(b): b for b in printable})
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    a_bytes = {i: token for token, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(letters[c] for c in a_bytes[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
            return [], []
        return left, right

    return tokens


def groups_of(left, right):
    def ends(tokens):
        reach, found = 0, []
        for _, data in tokens:
            reach += len(data)
            found.append(reach)
        return found

    a_ends, b_ends = ends(left), ends(right)
    cuts = sorted(set(a_ends) & set(b_ends))
    found = []
    for start, end in zip([0, *cuts], cuts):
        found.append(
            ([i for (i, _), e in zip(left, a_ends) if start < e <= end], [i for (i, _), e in zip(right, b_ends) if start < e <= end])
        )
    return found


def expected(rows, tokens):
    aligned = [(doc_id, *(sides := tokens(text)), groups_of(*sides)) for doc_id, text in rows]
    counts = Counter()
    for _, _, _, groups in aligned:
        counts.update({(a, b) for left, right in groups for a in left for b in right})
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    found = []
    for doc_id, left, right, groups in aligned:
        links = [counts[a, b] - 0 for x, y in groups for a in x for b in y]
        tops = sum(counts[a, b] == best[a] for x, y in groups for a in x for b in y)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
        found.append((doc_id, len(left), len(right), len(groups), len(links), tops, sum(links), digest))
    return sorted(found, key=repr)


def result(docs):
    return sorted(map(tuple, cross.op11(docs, BYTE_BPE, PIECES).collect()), key=repr)


TEXTS = [
    "plain words here", "a ▁ mark", "▁", "tail space ", " lead", "two  spaces   three", "tab\tand\nline \n end", "\n x", "a\n b",
    "<|endoftext|> stays text", "<s> </s> <unk>", "café naïve 漢字漢字 \U0001f600\U0001f600", "x y 　 z", "\x1c a\x1d b \x85c",
    "\x00 nul \x01", "word word word", "''s 're", "1234567 12", "a" * 300, "漢" * 200, "ﬁne Ａ", "é ẞ", "​ ‍", "   ",
]


@pytest.mark.parametrize("rows", [ODD_ROWS + list(enumerate(TEXTS, 100)) + list(enumerate(TEXTS[:9], 100)), []], ids=["odd", "none"])
def test_odd_texts(spark, library, rows):
    assert result(frame(spark, rows, extra=True)) == expected(rows, library)


def test_all_documents_in_several_blocks(spark, sf_dir, library, monkeypatch):
    monkeypatch.setattr(cross, "BLOCK_CHARS", 50_000)
    monkeypatch.setattr(cross, "BUCKET_CHARS", 100_000)
    monkeypatch.setattr(cross, "EXPANDED", 5_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = result(docs)
    assert got == expected(documents(spark, sf_dir), library)
    assert sum(row[4] for row in got) > 10_000


def test_groups_as_text(spark, library):
    rows = [(1, "some words"), (2, None), (3, "other 漢 words")]
    found = cross.cross_alignment(frame(spark, rows).selectExpr("*", "'old' as groups", "1 as n_a"), BYTE_BPE, PIECES)
    for row in found.collect():
        text = dict(rows)[row.doc_id]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_of(*library(text)))
        assert row.groups == shown


def test_random_texts(library):
    """Words of odd letters and white space, aligned in one table of words."""
    draw = random.Random(8)
    letters = ["a", "the", " ", "  ", "\n", "\t", "漢", "é", "'", "9", "\U0001f600", " ", "\x1f", "un", " ", ".", "▁"]
    texts = ["".join(draw.choices(letters, k=draw.randrange(1, 30))) for _ in range(400)]
    made = cross.tokenizers(BYTE_BPE, PIECES)
    import pyarrow as pa

    block = cross.Block(pa.chunked_array([texts]), made)
    shown = block.table.texts()
    for i, text in enumerate(texts):
        numbers = block.words[block.first[i] : block.first[i + 1]].tolist()
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_of(*library(text)))
        assert b";".join(shown[k] for k in numbers).decode() == want, repr(text)


def test_a_pair_met_very_often_is_counted_whole():
    pairs = np.array([3, 1 << 39, (1 << 40) - 1], np.uint64)
    counts = np.array([1, 2**32 + 5, 7], np.int64)
    payload = cross.pack(pairs, counts)
    assert [x.tolist() for x in cross.unpack(payload)] == [pairs.tolist(), counts.tolist()]
    replies, highest = cross.count_bucket([payload, payload])
    import zlib

    assert np.frombuffer(zlib.decompress(replies[1]), "<u8").tolist() == [2, 2**33 + 10, 14]
    assert cross.unpack(highest)[1].tolist() == [2, 2**33 + 10, 14]


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(count):
    keys = np.unique(np.random.default_rng(count).integers(0, 2**63, count, dtype=np.uint64))
    hashed = PerfectHash(keys)
    numbers = hashed(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys))) and len(hashed) == len(keys)
    others = np.random.default_rng(99).integers(2**63, 2**64 - 1, 5000, dtype=np.uint64)
    assert (hashed(others) == -1).all()
