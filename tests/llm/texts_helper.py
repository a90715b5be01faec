"""Small frames that the tests of this folder share."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, extra=False):
    """(doc_id, text) rows; ``extra`` adds columns whose names operators also use."""
    kind = "doc_id long, text string"
    if extra:
        kind += ", n_words string, score string, findings string, ids string, lang string, kept_text string"
        rows = [(*row, "w", "s", "f", "i", "en", "k") for row in rows]
    return spark.createDataFrame(rows, kind)


ODD_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all"),
    (6, "A b c éß 漢字 \U0001f600"), (7, "x" * 5000), (8, "a b " * 3000),
    (9, "the quick brown fox jumps over the lazy dog and runs off into the dark wood again"),
    (10, "The Quick brown fox jumps over the lazy dog and runs off into the dark wood again"),
    (11, "the quick brown fox jumps over the lazy dog and runs off into the dark wood again"),
    (-3, "line\nline\nline\n\nother line\n"), (2**40, "far id"),
]


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
