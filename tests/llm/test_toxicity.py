import random
import zlib

import pytest
from texts_helper import ODD_ROWS, frame

from paddock.llm import toxicity as tox
from paddock.llm.deobfuscate import Letters, char_counts, restored

BAD = ["idiot", "moron", "loser", "stupid", "worthless", "pathetic"]
PARTS = ["the", "ing", "er", "on", "an", "re", "sh", "in", "to", "of", "mor", "lo", "id", "st", "path"]


def prose(draw, size):
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 3))) for _ in range(size)]


def corpus(count, seed=1, disguise=lambda w, draw: w):
    draw = random.Random(seed)
    docs, labels = [], []
    for doc_id in range(count):
        words = prose(draw, draw.randint(30, 80))
        toxic = int(draw.random() < 0.15)
        for _ in range(3 * toxic):
            words.insert(draw.randint(0, len(words)), disguise(draw.choice(BAD), draw))
        docs.append((doc_id, " ".join(words)))
        labels.append((doc_id, toxic))
    return docs, labels


LEET = str.maketrans("oies", "0135")


def leet(word, draw):
    return draw.choice([word.translate(LEET), "-".join(word), word.replace(word[1], word[1] * 4)])


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = corpus(900)
    return tox.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")), docs, labels


def test_held_out_labels(spark, learnt):
    _, docs, labels = learnt
    rows = tox.op10(frame(spark, docs, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    out = [r for r in rows if r.held_out]
    assert len(rows) == 900 and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.98 * len(out)


def test_held_out_labels_are_never_read(spark, learnt):
    _, docs, labels = learnt
    turned = [(i, 1 - t if held(i) else t) for i, t in labels]
    model = tox.fit(frame(spark, docs), spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert (model.weights, model.offset, model.slope) == (learnt[0].weights, learnt[0].offset, learnt[0].slope)


def test_obfuscated_words_count(spark, learnt):
    docs, labels = corpus(300, seed=7, disguise=leet)
    rows = {r.doc_id: r.score for r in tox.toxicity(frame(spark, docs), learnt[0]).collect()}
    found = [rows[i] >= 0.7 for i, t in labels if t]
    clean = [rows[i] >= 0.7 for i, t in labels if not t]
    assert sum(found) >= 0.85 * len(found) and sum(clean) <= 0.02 * len(clean)


def test_odd_texts_and_missing_labels(spark, learnt):
    rows = {}
    for row in tox.toxicity(frame(spark, ODD_ROWS, extra=True), learnt[0]).collect():
        rows.setdefault(row.doc_id, row)
    assert rows[1].score == rows[2].score < 0.5 and rows[1].text is None and rows[1].lang == "en"
    odd = [(None, 1), (1, None), (2, 7), (5, 0), (5, 1), (10**9, 1)]
    for labels in (odd, []):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert tox.op10(frame(spark, ODD_ROWS), table).count() == len(ODD_ROWS)
    assert tox.op10(frame(spark, []), spark.createDataFrame(odd, "doc_id long, toxic int")).count() == 0


def test_readings():
    draw = random.Random(2)
    letters = Letters(char_counts(" ".join(prose(draw, 20000) + BAD * 50)))
    for written, meant in [("1d10t", "idiot"), ("m0r0n", "moron"), ("s-t-u-p-i-d", "stupid"), ("l0oooser", "loser"), ("p@th3tic!!", "pathetic")]:
        assert meant in restored(written, letters)
    assert restored("plain", letters) == ["plain"] and restored("&&&", letters) == [] and restored("", letters) == []
    assert restored("0123456789abcdef0123456789abcdef01234567", letters) == ["0123456789abcdef0123456789abcdef01234567"]


@pytest.mark.parametrize("written", [
    "i" * 40 + "diot", "m" + "o" * 50 + "r" * 9 + "on", "-".join("iiiiiiddddddiiiiiiooooootttttt"), ".".join("worthless" * 3 + "moron"),
    "1" + "d" * 40 + "10t", "-".join("idiot" * 30 + "moron"),
])
def test_words_drawn_out_or_split_beyond_32_signs(written):
    letters = Letters(char_counts(" ".join(BAD + ["an idiot", "a moron", "the loser"]) * 200))
    meant = [word for word in restored(written, letters)[1:] if any(bad in word for bad in BAD)]
    assert len(written) > 32 and meant


def test_spaced_words_of_three_signs_and_across_parts():
    from paddock.llm.deobfuscate import tokens_of

    letters = Letters(char_counts("bad dog idiot an " * 300))
    assert "b a d" in tokens_of("it is b a d here")
    assert "bad" in restored("b a d", letters)
    for shift in range(0, 130):
        found = tokens_of(" ".join("z" * shift + "idiot" + "z" * 100))
        assert any(" ".join("idiot") in token for token in found if " " in token)
    assert tokens_of("a b") == ["a", "b"]
    # A run of up to 64 signs is one token, as it was.
    assert [len(t) for t in tokens_of(" ".join("ab" * 32)) if " " in t] == [127]
    assert max(map(len, tokens_of("a b " * 3000))) == 127


def test_long_tokens_of_several_words_are_read_word_by_word():
    letters = Letters(char_counts(" ".join(BAD + ["you are an idiot", "a moron", "the loser", "worthless"]) * 200))
    written = "b4d.1d10t.y0u.4r3.w0rthl355.and.a.m0r0n"
    assert len(written) > 32
    found = restored(written, letters)
    assert found[0] == written and {"idiot", "worthless", "moron"} <= set(found)


def test_letters_do_not_depend_on_how_rows_are_dealt(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(prose(draw, draw.randint(1, 4000)))) for i in range(120)] + [(500, None), (501, "")]
    found = [tox.letters_of(frame(spark, rows).repartition(n)).log for n in (1, 7)]
    assert (found[0] == found[1]).all()
    assert (found[0] == Letters(sum(char_counts(text) for _, text in rows if text)).log).all()
