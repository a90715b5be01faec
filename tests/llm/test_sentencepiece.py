import hashlib
import random

import public_tokenizers
import pytest
from texts_helper import ODD_ROWS, documents, frame

from paddock.llm import sentencepiece_codec as codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        out.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ODD_ROWS, []])
def test_odd_texts(spark, library, rows):
    got = codec.op2(frame(spark, rows, extra=True), MODEL).collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, rows)


def test_all_documents(spark, library, sf_dir):
    got = codec.op2(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL).collect()
    assert sorted(map(tuple, got), key=repr) == expected(library, documents(spark, sf_dir))


def test_any_text_and_any_ids(spark, library):
    draw = random.Random(5)
    signs = "   ▁▁\n\t ab'sé1!  漢\x00 "
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    got = codec.encode(frame(spark, list(enumerate(texts))), MODEL).collect()
    assert all(list(r.ids) == library.encode(r.text) for r in got)
    lists = [[draw.choice([draw.randrange(32000), draw.randrange(259), 28705, 259]) for _ in range(draw.randint(0, 9))] for _ in range(1500)]
    rows = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id int, ids array<int>")
    for row in codec.decode(rows, MODEL).collect():
        assert row.decoded == (library.decode(list(row.ids)) if row.ids else "")


def test_marked_words():
    assert codec.marked_words("a b  c ") == ["a", "b", " c", ""]
    assert codec.marked_words(" ") == [" "] and codec.marked_words("") == []


def test_whole_pieces_are_not_left_to_the_library(library, monkeypatch):
    import pyarrow as pa

    reader = codec._Decoder(MODEL)
    texts = ["", "two words", "  dög\n\t漢字 ", "a" * 50]
    ids = pa.array([library.encode(text) for text in texts], pa.list_(pa.int32()))
    monkeypatch.setattr(reader, "model", None)
    assert reader.texts(ids) == [library.decode(found) for found in ids.to_pylist()]
