import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from texts_helper import ODD_ROWS, documents, frame, words

from paddock.llm import context_mixing as mixing
from paddock.llm import lm_scoring


def tokens(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in words(text)] + ["\n"]


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for doc_id, text in rows:
        found = tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found)
        held = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0
        out.setdefault(doc_id, []).append((held, len(found), sum(counts[t] > 0 for t in found), total, score))
    return out


def check(rows, got):
    want = expected(rows)
    assert len(got) == len(rows)
    for row in got:
        held, n, known, total, score = want[row.doc_id][0]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held, n, known, total)
        assert row.base_score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert math.isfinite(row.score) and row.score <= 1e-6


@pytest.mark.parametrize("rows", [ODD_ROWS, [], [(None, "only a held out text")]])
def test_odd_texts(spark, rows):
    check(rows, lm_scoring.op9(frame(spark, rows, extra=True)).collect())


def test_all_documents(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = lm_scoring.op9(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    check(rows, got)


def test_several_blocks_agree_with_one(spark, monkeypatch, sf_dir):
    """Counts do not depend on how documents are blocked."""
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 5000)
    monkeypatch.setattr(lm_scoring, "BUCKET_CHARS", 7000)
    rows = documents(spark, sf_dir)[:60]
    check(rows, lm_scoring.op9(frame(spark, rows)).collect())


def test_scores_do_not_depend_on_tasks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    one, seven = (
        {r.doc_id: r.score for r in lm_scoring.op9(docs.repartition(tasks)).collect()} for tasks in (1, 7)
    )
    assert one.keys() == seven.keys()
    for doc_id, score in one.items():
        assert seven[doc_id] == pytest.approx(score, rel=1e-4)


PARTS = ["the", "ing", "er", "on", "an", "re", "sh"]


def learnt(sequences, alphabet, orders=(1, 2, 4)):
    """Model, mixer and evidence of sequences of numbers."""
    symbols, sizes = np.concatenate(sequences).astype(np.int64), np.array(list(map(len, sequences)))
    model = mixing.Model.empty(np.bincount(symbols, minlength=alphabet).astype(float), orders)
    mixing.count(model, symbols, sizes)
    mixer = mixing.Mixer.new(model.inputs)
    for _ in range(10):
        mixing.learn(mixer, model, symbols, sizes)
    return mixer, model, mixing.Evidence.of(model)


def spelled(model, some):
    symbols, sizes = lm_scoring.bytes_of(some)
    return np.add.reduceat(mixing.scored(*model, symbols, sizes), np.cumsum(sizes) - sizes)


def spelling(some):
    symbols, sizes = lm_scoring.bytes_of(some)
    return learnt(np.split(symbols, np.cumsum(sizes)[:-1]), 257)


def test_model_prefers_what_it_read():
    draw = random.Random(1)
    read = ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 4))).encode() for _ in range(8000)]
    model = spelling(read)
    unseen = ["".join(draw.choice(PARTS) for _ in range(5)).encode() for _ in range(200)]
    noise = [bytes(draw.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(len(w))) for w in unseen]
    alike = spelled(model, unseen).sum()
    assert alike > 0.6 * spelled(model, noise).sum()
    bits = -alike / sum(len(w) + 1 for w in unseen)
    assert bits < 2.5  # total bits per byte; 4.7 for letters drawn evenly


def test_probabilities_of_all_spellings_sum_to_at_most_one():
    model = spelling([b"a", b"ab", b"b", b"ba"] * 50)
    every = [b""] + [bytes(w) for n in (1, 2, 3) for w in product(b"abc", repeat=n)]
    total = sum(2**x for x in spelled(model, every))
    assert 0.5 < total <= 1 + 1e-4
    assert mixing.scored(*model, np.empty(0, np.int64), np.empty(0, np.int64)).size == 0


def test_symbols_after_a_text_sum_to_one():
    """What may come next adds up to 1 for any beginning."""
    draw = random.Random(5)
    model = learnt([[draw.randrange(9) for _ in range(draw.randint(1, 30))] for _ in range(200)], 9, (1, 2, 3))
    for size in (0, 1, 2, 7):
        begun = [draw.randrange(9) for _ in range(size)]
        texts = np.array([[*begun, last] for last in range(9)])
        logs = mixing.scored(*model, texts.ravel(), np.full(9, size + 1)).reshape(9, -1)[:, -1]
        assert (2**logs).sum() == pytest.approx(1, abs=1e-4)


def brute_force(mixer, model, sequences):
    """log2 of each symbol, bit by bit, with counts kept by whole contexts."""
    code = model.code

    def path(symbol):
        first = code.offsets[symbol]
        return [(int(code.nodes[i]), int(code.bits[i])) for i in range(first, first + code.lengths[symbol])]

    counts = defaultdict(lambda: [0, 0])
    for sequence in sequences:
        for at, symbol in enumerate(sequence):
            for order in model.orders:
                for node, bit in path(symbol):
                    counts[order, at < order, tuple(sequence[max(0, at - order) : at]), node][bit] += 1
    logs = []
    for sequence in sequences:
        for at, symbol in enumerate(sequence):
            total = 0.0
            for node, bit in path(symbol):
                inputs, gate = [float(code.odds[node])], 0
                for order in model.orders:
                    zeros, ones = counts[order, at < order, tuple(sequence[max(0, at - order) : at]), node]
                    inputs.append(math.log((ones + 0.4) / (zeros + 0.4)))
                    met = zeros + ones
                    gate = gate * 4 + (met > 0) + (met > 3) + (met > 31)
                # The longest context's degree of evidence is the lowest digit, the others' follow.
                digits = [gate >> 4 & 3, gate >> 2 & 3, gate & 3]
                gate = digits[2] + 4 * digits[0] + 16 * digits[1]
                weights = mixer.weights[:, gate].astype(float)
                odds = max(-14, min(14, weights[-1] + sum(w * x for w, x in zip(weights, inputs))))
                chance = 1 / (1 + math.exp(-odds))
                near = min(len(code.lengths) - 2 - node, mixing.NODES - 1)
                cell = near * mixing.STEPS + int(max(0, min(mixing.STEPS - 1, odds * 1.2 + mixing.STEPS / 2)))
                seen, ones = mixer.seen[cell], mixer.ones[cell]
                chance += seen / (seen + 8) / 2 * ((ones + 0.4) / (seen + 0.8) - chance)
                total += math.log2(max(1e-6, min(1 - 1e-6, chance if bit else 1 - chance)))
            logs.append(total)
    return logs


def test_scores_equal_brute_force(monkeypatch):
    """Same log probabilities as a plain loop over bits; steps cut texts without a trace."""
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 20)  # so that contexts rarely share a slot
    draw = random.Random(3)
    sequences = [[draw.choice((0, 1, 2, 2, 3, 4)) for _ in range(draw.randint(1, 40))] for _ in range(60)]
    mixer, model, evidence = learnt(sequences, 5, (1, 2, 3))
    symbols, sizes = np.concatenate(sequences), np.array(list(map(len, sequences)))
    want = np.array(brute_force(mixer, model, sequences))
    for step in (mixing.STEP, 7):
        monkeypatch.setattr(mixing, "STEP", step)
        got = mixing.scored(mixer, model, evidence, symbols, sizes)
        # Odds on the edge of a map's cell may fall to either side.
        assert np.mean(np.abs(got - want) < 1e-3) > 0.99
        assert got.sum() == pytest.approx(want.sum(), rel=1e-3)


def test_earlier_words_of_a_text():
    keys = np.array([5, 3, 5, 5, 3, 9])
    assert lm_scoring._earlier(keys).tolist() == [0, 0, 1, 2, 1, 0]
    assert lm_scoring._earlier(np.empty(0, np.int64)).size == 0
    # Two words of one symbol, each half of it: a, b, a in one text, then a in another.
    doc, ids = np.array([0, 0, 0, 1]), np.array([0, 1, 0, 0])
    tails = lm_scoring._tails(doc, ids, np.zeros(4, np.int64), np.log10(np.full(4, 0.5)), np.full(4, 10.0))
    assert (10**tails).tolist() == pytest.approx([0.5, 5 / 11, 6 / 12, 0.5])


def test_order_of_words_counts(spark):
    """A text in the order that was read is more probable than its words in another."""
    draw = random.Random(4)
    phrases = ["red fox jumps", "old dog sleeps", "big cat eats", "sad owl sings"]
    rows = [(i, " ".join(draw.choice(phrases) for _ in range(20))) for i in range(300)]
    rows.append((1000, " ".join(phrases * 3)))
    rows.append((1001, " ".join(sorted(rows[-1][1].split()))))
    docs = frame(spark, rows).selectExpr("*", "doc_id < 1000 as learn")
    found = lm_scoring.lm_scores(docs, "learn").collect()
    score = {r.doc_id: r.score for r in found}
    assert score[1000] > 0.5 * score[1001] and score[1000] < 0
    # Better than the words' own counts on the text that was not read.
    assert score[1000] > next(r.base_score for r in found if r.doc_id == 1000)


def test_two_words_back_count(spark):
    """What comes after a word depends on the word before that one."""
    draw = random.Random(6)
    pairs = ["ada sees rain", "bob sees snow"]
    rows = [(i, " ".join(draw.choice(pairs) for _ in range(20))) for i in range(300)]
    rows += [(1000, " ".join(pairs * 4)), (1001, " ".join(["ada sees snow", "bob sees rain"] * 4))]
    docs = frame(spark, rows).selectExpr("*", "doc_id < 1000 as learn")
    score = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, "learn").collect()}
    assert score[1000] > score[1001] + 5


def test_counts_beyond_what_single_floats_hold():
    model = mixing.Model.empty(np.ones(257), (1, 2))
    model.counts[0][:] = 2**24
    for _ in range(2):
        mixing.count(model, *lm_scoring.bytes_of([b"a"]))
    assert model.counts[0].max() == 2**24 + 2


def test_unseen_words_of_a_doubled_table_are_not_certain(spark):
    """No training word occurs once; a held-out text of unseen words must not get the best score."""
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (4, "zzq xxj qqv kkw")]
    docs = frame(spark, rows).selectExpr("*", "doc_id < 3 as learn")
    score = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, "learn").collect()}
    assert score[4] < score[3] < 0 and score[4] < -8


def test_words_met_more_than_2_to_the_32_times_are_packed_whole():
    many = 2**32 + 5
    names, counts = lm_scoring._read(lm_scoring._packed([b"a", b"b"], np.array([many, 1])))
    assert names == [b"a", b"b"] and counts.tolist() == [many, 1]


def test_words_without_a_symbol_of_their_own(spark, monkeypatch):
    """Words under the share, and long ones, are told apart by counts; all texts have scores."""
    monkeypatch.setattr(lm_scoring, "COMMON", 4)
    monkeypatch.setattr(lm_scoring, "LONGEST", 3)
    rows = [(i, "aa bb bb cc cc cc " + "long" * 9 + " " + "w%d" % i) for i in range(40)]
    check(rows, lm_scoring.op9(frame(spark, rows)).collect())
