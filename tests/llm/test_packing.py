import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from texts_helper import ODD_ROWS, documents, frame

from paddock.llm import packing
from paddock.llm.byte_bpe import ChunkTable

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def check(library, rows, got, capacity):
    wanted = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        start, edge, piece = 0, len(ids) % capacity or capacity, 0
        while start < len(ids):
            part = np.array(ids[start:edge], "<u4").tobytes()
            wanted[(doc_id, piece, start, edge - start, zlib.crc32(part))] += 1
            start, edge, piece = edge, edge + capacity, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    sequences = {}
    for row in got:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("rows, capacity", [(ODD_ROWS, 16), (ODD_ROWS, 2048), ([], 2048)])
def test_odd_texts(spark, library, rows, capacity):
    got = packing.best_fit_packing(frame(spark, rows, extra=True), PATH, capacity).collect()
    check(library, rows, got, capacity)


def test_added_tokens_in_texts(spark):
    """As the library finds them by default."""
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    rows = [(1, f"a{end}b"), (2, end), (3, f" {end} x  {end}{end}\n\n{end} y "), (4, f"<|endof{end}text|>"), (5, "no token"), (6, None)]
    got = packing.best_fit_packing(frame(spark, rows), PATH, 4).collect()
    check(Tokenizer.from_file(PATH), rows, got, 4)
    assert ChunkTable(PATH).encode([f"a{end}b"]) == [np.array([64, 50256, 65], "<u4").tobytes()]


def test_all_documents_near_the_bound(spark, library, sf_dir):
    got = packing.best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()
    used, bound = check(library, documents(spark, sf_dir), got, 2048)
    assert used <= bound * 1.03 + 1


def test_ids_of_any_text(library):
    draw = random.Random(4)
    signs = " \n\t ab'sé1!  漢\x1c\x85<|endoftext|>"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    ids = [np.frombuffer(found, "<u4").tolist() for found in ChunkTable(PATH).encode(texts)]
    assert ids == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 20, 100])
    counts = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(draw.randint(0, 25))}
    made = packing.plan(counts, capacity)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= capacity and times > 0
        for length in lengths:
            used[length] += times
    assert used == Counter(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)  # no two of these share a sequence
    assert sum(times for _, times in made) <= 1.25 * max(bound, large) + 2


def test_exact_complements_come_first():
    assert sorted(packing.plan({60: 3, 40: 3}, 100)) == [((60, 40), 3)]
    assert sorted(packing.plan({50: 2, 30: 2, 20: 2}, 100)) in ([((50, 30, 20), 2)], [((30, 30, 20, 20), 1), ((50, 50), 1)], [((50, 50), 1), ((30, 30, 20, 20), 1)])
    assert sum(t for _, t in packing.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100)) == 1


def test_ranks_of_a_hot_length_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rows = [(i, 0, 0, 10 if i % 3 else 7, i) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    ranks = {}
    for row in packing.ranked(pieces, {10: 400, 7: 200}).collect():
        ranks.setdefault(row.length, []).append(row["rank"])
    assert all(sorted(found) == list(range(len(found))) for found in ranks.values())
