import itertools
import random

import numpy as np
import pytest
from texts_helper import ODD_ROWS, documents, frame, words

from paddock.llm import minhash_dedup as near
from paddock.llm.components import components


def shingles(text):
    found = ["".join(c.lower() if c.isascii() else c for c in w) for w in words(text)]
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def expected(rows, percent=85):
    """Per row: ids, set size and component; rows that share an id are one node."""
    sets = [(doc_id, shingles(text)) for doc_id, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is None or b is None or not x or not y:
            continue
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=repr)


def result(frame):
    return sorted(map(tuple, near.op7(frame).collect()), key=repr)


@pytest.mark.parametrize("rows", [ODD_ROWS + [(5, "now different"), (30, "now different"), (4, "ONE")], []])
def test_odd_texts(spark, rows):
    assert result(frame(spark, rows, extra=True)) == expected(rows)


def test_all_documents(spark, sf_dir):
    assert result(spark.read.parquet(f"{sf_dir}/documents.parquet")) == expected(documents(spark, sf_dir))


def test_loose_copies_and_chains(spark, monkeypatch):
    """Copies of one text at all distances, and a chain whose ends are far apart, in small blocks."""
    monkeypatch.setattr(near, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(near, "BUCKET_CHARS", 5000)
    monkeypatch.setattr(near, "BLOCK_ROWS", 20)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(1000 + i, " ".join(w if draw.random() > share else f"e{i}_{k}" for k, w in enumerate(base)))
            for i, share in enumerate(np.linspace(0, 0.08, 80))]
    chain = list(base)
    for step in range(12):
        chain = [f"c{step}_{k}" if step * 3 <= k - 10 < step * 3 + 3 else w for k, w in enumerate(chain)]
        rows.append((500 - step, "chain start " + " ".join(chain)))
    draw.shuffle(rows)
    assert result(frame(spark, rows)) == expected(rows)


def test_tensored_tables_find_links_and_save_hashes():
    """64 tables of four hashes from 32, and at similarity 0.85 next to no pair without a common key."""
    draw = np.random.default_rng(1)
    common, other = 850, 75
    missed = 0
    for _ in range(300):
        pool = draw.integers(0, 2**63, common + 2 * other, dtype=np.uint64)
        one, two = pool[: common + other], np.r_[pool[:common], pool[common + other :]]
        halves = near.half_keys(np.concatenate([one, two]), np.array([0, len(one)]))
        keys = near.table_keys(halves)
        missed += not np.isin(keys[0], keys[1]).any()
    assert missed <= 2 and keys.shape == (2, 64) and halves.shape == (2, 16)


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200, 202: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
