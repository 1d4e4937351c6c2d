import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept string, h int, pos int, hits string,"
    " n_words string, label string, spans string, bucket string, score string, node int, _row int"
)


def _frame(spark, rows):
    wide = [(i, t, x, s, len(t or ""), "r", "k", 1, 2, "x", "w", "l", "s", "b", "o", 3, 4) for i, t, x, s in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def frame(spark):
    """Builds documents with extra columns of clashing names from (doc_id, text, lang, source)."""
    return lambda rows: _frame(spark, rows)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(8)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(vocabulary):
    """Null, empty, blank, very long, repeated and non-ASCII rows."""
    rng = random.Random(9)
    long = " ".join(rng.choice(vocabulary) for _ in range(30000))
    plain = " ".join(rng.choice(vocabulary) for _ in range(60))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n ", "en", None), (4, plain, "en", "a"), (4, plain, "en", "a"),
        (5, plain, None, "b"), (6, long, "en", "b"), (7, "x" * 50000, "en", "c"), (8, "Ünïcödé ñandú 日本語 " * 30, "de", "c"),
        (None, "no id here but some words stand", "en", "d"), (9, "12345 67890 !!", "en", "d"),
    ]


@pytest.fixture(scope="session")
def no_rows(frame, odd_rows):
    return frame(odd_rows).filter("doc_id > 10 and doc_id < 0")
