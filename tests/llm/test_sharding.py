import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from texts_helper import ODD_ROWS, documents, frame

from paddock.llm import sharding
from paddock.session import store


def keyed(spark, rows, label="keys"):
    return store(sharding.with_key(frame(spark, rows)).select("doc_id", "size", *sharding._KEY), label)


def by_rule(rows, shards, whole=sharding.WHOLE):
    """(doc_id, size, shard, slot) from the sorted table: a row goes where its middle lies."""
    order = sorted(rows, key=lambda r: (r["__group"], r["__second"], r["__place"]))
    total = sum(r["size"] for r in order)
    starts, reach = [], 0
    middles = []
    for r in order:
        middles.append(2 * reach + r["size"])
        reach += r["size"]
    group_bytes = Counter()
    for r in order:
        group_bytes[r["__group"]] += r["size"]
    for s in range(1, shards):
        edge = -(-s * total // shards)
        at = next((i for i, m in enumerate(middles) if m >= 2 * edge), len(order))
        if at < len(order):
            group = order[at]["__group"]
            first = next(i for i, r in enumerate(order) if r["__group"] == group)
            after = next((i for i in range(first, len(order)) if order[i]["__group"] != group), len(order))
            left = sum(r["size"] for r in order[first:at])
            if left and group_bytes[group] <= whole * total / shards:
                at = after if 2 * left >= group_bytes[group] else first
        starts.append(at)
    found, slots = [], Counter()
    for i, r in enumerate(order):
        shard = sum(start <= i for start in starts)
        found.append((r["doc_id"], r["size"], shard, slots[shard]))
        slots[shard] += 1
    return sorted(found, key=repr)


@pytest.mark.parametrize("full, aim", [(sharding.FULL, sharding.AIM), (40, 10)])
@pytest.mark.parametrize("shards", [1, 5, 24])
def test_against_rule(spark, shards, full, aim):
    draw = random.Random(3)
    rows = [(i, "copy of one page " * 9 if i % 3 == 0 else "w " * draw.randrange(400)) for i in range(600)]
    rows += [(7, "again")] * 50 + ODD_ROWS
    table = keyed(spark, rows)
    got = sharding.assign_shards(table, shards, full, aim).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == by_rule(table.collect(), shards)


def test_no_range_is_overfull(spark):
    """Tiny rows beside giant ones, and one row repeated: the ranges are split until they fit."""
    rows = [(1, "same")] * 300 + [(i, "x" * (100_000 if i < 3 else i % 5)) for i in range(700)]
    splitters, counts, sizes = sharding.sampled_splitters(keyed(spark, rows), 4, full=25, aim=10)
    assert counts.max() <= 25 and counts.sum() == 1000
    assert sizes.sum() == sum(len(t) + 8 for _, t in rows)
    assert (splitters[1:] > splitters[:-1]).all()


def test_query(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = sharding.op13(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 24
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    mean, largest = sum(sizes.values()) / 24, max(len((t or "").encode()) + 8 for t in text.values())
    assert max(abs(sizes[s] - mean) for s in range(24)) <= largest + 2 * sharding.WHOLE * mean


def test_odd_tables(spark):
    assert sharding.op13(frame(spark, [])).collect() == []
    got = sharding.op13(frame(spark, ODD_ROWS, extra=True)).collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 8) for i, t in ODD_ROWS if i is not None
    )
    assert [r["size"] for r in got if r.doc_id is None] == [len("no id here at all") + 8]


def test_small_groups_stay_together(spark):
    """A group that is small beside a shard is not parted, a hot one is split."""
    rows = [(i, f"text number {i // 3} " + "z" * 40) for i in range(3000)] + [(9000 + i, "hot " * 15) for i in range(1500)]
    got = sharding.op13(frame(spark, rows), 6).collect()
    text = dict(rows)
    places = defaultdict(set)
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    assert len(places["hot " * 15]) >= 2
    assert all(len(found) == 1 for t, found in places.items() if t != "hot " * 15)


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 17)) for i in range(300)] + [(1, "text 1 ")] * 3 + [(None, None)]
    path = str(tmp_path / "shards")
    docs = frame(spark, rows).selectExpr("*", "'old' as shard", "doc_id as slot")
    back = sharding.write_shards(docs, path, 7).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(rows, key=repr)
    for shard in range(7):
        slots = [r.slot for r in back if r.shard == shard]
        assert sorted(slots) == list(range(len(slots)))


def test_keys_compare_like_their_parts():
    draw = np.random.default_rng(5)
    parts = draw.integers(-3, 3, (400, 3))
    parts[:50] = draw.integers(-(2**63), 2**63 - 1, (50, 3))
    keys = sharding.joined_keys(*parts.T)
    assert sorted(range(400), key=lambda i: (keys[i], i)) == sorted(range(400), key=lambda i: (*parts[i].tolist(), i))
