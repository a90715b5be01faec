import hashlib
import random

import pytest
from texts_helper import ODD_ROWS, documents, frame, words

from paddock.llm import substring_dedup as dedup

LEAST = -(2**63)


def expected(rows, size=13):
    first = {}
    for doc_id, text in rows:
        found, key = words(text), LEAST if doc_id is None else doc_id
        for i in range(len(found) - size + 1):
            window = tuple(found[i : i + size])
            first[window] = min(first.get(window, key), key)
    out = []
    for doc_id, text in rows:
        found, key = words(text), LEAST if doc_id is None else doc_id
        gone = [False] * len(found)
        for i in range(len(found) - size + 1):
            if first[tuple(found[i : i + size])] < key:
                gone[i : i + size] = [True] * size
        kept = " ".join(w for w, g in zip(found, gone) if not g)
        out.append((doc_id, len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted(map(tuple, dedup.op3(frame).collect()), key=repr)


@pytest.mark.parametrize("rows", [ODD_ROWS, []])
def test_odd_texts(spark, rows):
    assert result(frame(spark, rows, extra=True)) == expected(rows)


def test_all_documents(spark, sf_dir):
    assert result(spark.read.parquet(f"{sf_dir}/documents.parquet")) == expected(documents(spark, sf_dir))


def test_matches_at_every_shift_over_many_blocks(spark, monkeypatch):
    """Passages of 11 to 16 words at all shifts, in blocks and buckets of a few words."""
    monkeypatch.setattr(dedup, "BLOCK_CHARS", 400)
    monkeypatch.setattr(dedup, "BUCKET_CHARS", 300)
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for doc_id in range(120):
        size = draw.randint(11, 16)
        at = draw.randint(0, 20 - size)
        head = [f"h{doc_id}_{i}" for i in range(draw.randint(0, 9))]
        rows.append((doc_id, " ".join([*head, *passage[at : at + size], f"t{doc_id}"])))
    assert result(frame(spark, rows)) == expected(rows)


def test_other_columns_stay(spark):
    got = dedup.substring_dedup(frame(spark, ODD_ROWS, extra=True))
    assert got.columns == ["doc_id", "text", "score", "findings", "ids", "lang", "n_words", "n_removed", "kept_text"]
    with pytest.raises(ValueError):
        dedup.substring_dedup(frame(spark, []), cover=(0, 1))
