from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n bigint"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents, as rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows; `kept` and `n` clash with names in use."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (8, long), (9, long + " end"), (10, "tab\there  <|endoftext|> x y z"), (11, "é日本語\U0001f600 ﬁ Σίσυφος ΟΔΟΣ"), (None, "no id at all"), (None, None), (12, "don't we'll I'm 12345 it's\n\n  x  \n")]
    return [(i, t, None if i == 4 else "en", None if i == 5 else "s", None if i == 6 else len(t or ""), True, 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
