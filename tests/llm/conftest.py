import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators could clash with
    T.StructField("id", T.LongType()), T.StructField("size", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text, lang, source)`` rows, with further columns."""

    def of(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", None, "y") for r in rows], COLUMNS)

    return of


ODD = [
    (1, "the cat sat on the mat and looked at the dog near the old house by the sea", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog near the old house by the sea", "en", None),
    (2, "the cat sat on the mat and looked at the dog near the old house by the sea", "en", None),
    (3, None, None, "b"), (4, "", "en", "b"), (None, "a text without id", "en", "a"), (5, " \t\n ", None, "c"), (6, "12345 67890", "en", "c"),
    (7, "word " * 5000, "en", "a"), (8, "Ärger über die Straße und das Haus", "de", "a"), (9, "\x1e odd   marks \U0001f600", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
