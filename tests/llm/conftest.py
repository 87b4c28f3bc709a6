import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names clash with what operators use inside
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("t", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("entities", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents_of(spark):
    """Build a documents table from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (None, "a row without an id but with some words in it", "en", None),
    (4, LONG, "en", "a"),
    (5, "the same row twice, the same words twice", "en", "b"),
    (5, "the same row twice, the same words twice", "en", "b"),
    (6, " \t\n\u000b\f\r ", "de", "b"),
    (7, "ünïcödé 漢字 \U0001f600 emoji", "de", "c"),
]


@pytest.fixture
def odd(documents_of):
    return documents_of(ODD)


@pytest.fixture
def none(documents_of):
    return documents_of([])
