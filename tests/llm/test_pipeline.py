import itertools

import numpy as np
import public_tokenizers
import pytest
from test_minhash import expected as components_of
from test_minhash import shingles
from test_secrets import expected as secrets_of
from test_substring_dedup import expected as passages_of
from texts_helper import words

import __spark_entry__ as app
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(corpus_pipeline.store(stage(spark, made[-1], sf_dir), f"test-{name}"))
    return made


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    for made in stages[:-1]:
        assert made.dtypes == stages[0].dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "secret_scan", "packing"]


def test_toxic_documents_go(spark, stages, sf_dir):
    before, after = texts(stages[0]), texts(stages[1])
    scores = {r.doc_id: r.score for r in app.queries()["op10_toxicity"](spark, sf_dir).collect()}
    assert set(after) == {i for i in before if scores[i] < 0.7}


def test_one_of_each_group_stays(stages):
    rows = list(texts(stages[1]).items())
    assert set(texts(stages[2])) == {i for i, _, _, kept in components_of(rows, corpus_pipeline.ALIKE) if kept}


def test_copies_of_four_fifths_go(spark, tmp_path):
    """A copy between 0.80 and 0.85 goes, one below 0.80 stays, by brute force on five-word sets."""
    base = [f"w{i}" for i in range(200)]

    def altered(places):
        return " ".join(f"x{i}" if i in places else w for i, w in enumerate(base))

    rows = [(1, " ".join(base)), (2, altered({20, 90, 150, 199})), (3, altered({10, 50, 90, 130, 170}))]
    sets = {i: shingles(text) for i, text in rows}
    alike = {i: len(sets[1] & sets[i]) / len(sets[1] | sets[i]) for i in (2, 3)}
    assert 0.80 <= alike[2] < 0.85 and alike[3] < 0.80
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i, text in rows], SCHEMA)
    assert set(texts(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)))) == {1, 3}


def test_near_dedup_stage_against_brute_force(spark, sf_dir):
    rows = list(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).items())
    sets = [(i, shingles(text)) for i, text in rows]
    root = {i: i for i, _ in rows}

    def named(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        common = len(x & y)
        if common and 100 * common >= 80 * (len(x) + len(y) - common):
            low, high = sorted((named(a), named(b)))
            root[high] = low
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert set(texts(kept)) == {i for i, _ in rows if named(i) == i}


def test_passages_go(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    for doc_id, _, removed, _ in passages_of(list(before.items())):
        assert removed == len(words(before[doc_id])) - len(words(after[doc_id]))
        assert removed or before[doc_id] == after[doc_id]


def test_secrets_go(stages):
    before, after = texts(stages[3]), texts(stages[4])
    for doc_id, *counts, _, _ in secrets_of(list(before.items())):
        assert (before[doc_id] != after[doc_id]) >= (sum(counts) > 0)
    assert sum(sum(row[1:4]) for row in secrets_of(list(after.items()))) == 0


def test_everything_is_packed(stages):
    from paddock.llm.byte_bpe import ChunkTable

    table = ChunkTable(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for row in stages[5].collect():
        tokens[row.doc_id] = tokens.get(row.doc_id, 0) + row.length
    for doc_id, text in texts(stages[4]).items():
        assert tokens[doc_id] == len(np.frombuffer(table.encode([text])[0], "<u4")) + 1


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, "a " * 4000, "en", "s", 8000)]
    for name, table in (("documents", spark.createDataFrame(rows, SCHEMA)), ("labels", spark.createDataFrame([], "doc_id long, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, None}


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", SCHEMA), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
