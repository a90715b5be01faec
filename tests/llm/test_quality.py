import numpy as np
import pytest
from texts_helper import ODD_ROWS, documents, frame, words

from paddock.llm import quality_rules as quality


def expected(rows):
    out = []
    for doc_id, text in rows:
        text, found = text or "", words(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if words(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        marks = [False] * len(found)
        for i, window in enumerate(windows):
            if windows.count(window) > 1:
                marks[i : i + 5] = [True] * 5
        n, repeated = len(found), sum(marks)
        failed = n < 10 or 100 * repeated > 20 * n
        out.append((doc_id, n, sum(map(len, found)), sum(text.count(s) for s in "#*$%&|<>"), again, repeated, failed))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(row)[:-1] for row in quality.op5(frame).collect()), key=repr)


@pytest.mark.parametrize("rows", [ODD_ROWS, []])
def test_odd_texts(spark, rows):
    rows = [row for row in rows if row[0] != 8] + [(8, "a b " * 30)] * bool(rows)
    assert result(frame(spark, rows, extra=True)) == expected(rows)


def test_all_documents_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [row for row in documents(spark, sf_dir) if len(row[1] or "") < 4000]
    assert result(docs.where("coalesce(length(text), 0) < 4000")) == expected(rows)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg({"quality": "max"})
    judged = quality.op5(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [row.kept for row in judged if row["max(quality)"] == 1]
    assert sum(good) >= 0.97 * len(good)


def test_em_finds_accuracies():
    """Votes drawn from known rates: EM recovers them and beats the plain majority."""
    draw = np.random.default_rng(2)
    truth = draw.random(20000) < 0.8
    rates = [0.9, 0.85, 0.6, 0.55, 0.8]
    votes = np.stack([np.where(draw.random(20000) < r, truth, ~truth) * 2 - 1 for r in rates], 1)
    votes[draw.random(votes.shape) < 0.1] = 0
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    for rule, rate in enumerate(rates):
        good = model.rates[rule, 1]
        assert abs(good[2] / (good[0] + good[2]) - rate) < 0.05
    chosen = (model.posterior(patterns) >= 0.5)[place.ravel()]
    majority = votes.sum(1) > 0
    assert (chosen == truth).mean() >= (majority == truth).mean()


def test_no_rows_fit():
    model = quality.fit(np.empty((0, 3), int), np.empty(0))
    assert model.posterior(np.array([[1, 1, 1]]))[0] > 0.5 > model.posterior(np.array([[-1, -1, -1]]))[0]
