import hashlib
import random

import pytest
from texts_helper import ODD_ROWS, documents, frame

from paddock.llm import order_minhash as omh


def by_id(frame):
    return {row.doc_id: row for row in omh.fingerprints(frame).collect()}


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, text), (next_id, after) in zip(order, [*order[1:], order[0]]):
        text, after, row = text or "", after or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        pairs = [(row.fingerprint[i : i + 4], got[next_id].fingerprint[i : i + 4]) for i in range(0, 256, 4)]
        assert row.near_next == sum(a == b for a, b in pairs) / 64
        assert 0 <= row.near_edited <= 1 and len(row.fingerprint) == len(row.edited_fingerprint) == 256
        if edited == text:
            assert row.near_edited == 1


def test_all_documents(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check(rows, got)
    same = {}
    for doc_id, text in rows:
        assert same.setdefault(text, got[doc_id].fingerprint) == got[doc_id].fingerprint
    long = [i for i, text in rows if text and len(text.split()) > 100]
    assert sum(got[i].near_edited > got[i].near_next for i in long) > 0.95 * len(long)


def test_odd_texts(spark):
    rows = [row for row in ODD_ROWS if row[0] != 5] + [(5, "one")]
    check(rows, by_id(frame(spark, rows, extra=True)))


@pytest.mark.parametrize("rows, count", [([], 0), ([(1, "a b c")], 1), ([(5, "x y"), (5, "x y"), (5, None)], 3)])
def test_empty_single_and_shared_ids(spark, rows, count):
    assert omh.fingerprints(frame(spark, rows)).count() == count


def reference(text):
    """Tuples of the numbered k-mers after each point, by plain loops; places tell the order."""
    import re

    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def test_order_and_repetition_count(spark):
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 400)}" for _ in range(600)]
    swapped = base[300:] + base[:300]
    changed = [w if i % 60 else "new" for i, w in enumerate(base)]
    doubled = ["a b c d e"] * 40
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(swapped)), (4, " ".join(doubled)), (5, " ".join(doubled[:20]))]
    got = by_id(frame(spark, rows))

    def near(a, b):
        x, y = got[a].fingerprint, got[b].fingerprint
        return sum(x[i : i + 4] == y[i : i + 4] for i in range(0, 256, 4)) / 64

    assert near(1, 2) > 0.6  # a tenth of the k-mers differ
    assert near(1, 3) < 0.75 < near(1, 1)  # same k-mers but three, halves exchanged
    assert near(4, 5) < 0.7  # same k-mers, other numbers of them
    assert reference(" a  b ") == ["a", "b"]


def test_plan_has_no_python(spark, sf_dir):
    frame = omh.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = frame._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow", "CartesianProduct"))
