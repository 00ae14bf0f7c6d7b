from __future__ import annotations

import pytest

from tests.conftest import spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, __x int"

# Nulls in any column, empty and blank texts, ties, repeated rows, extra columns with clashing names, and a long text.
ODD = [
    (1, "the cat sat on the mat and then the dog came in", "en", "a", 5, "x", 1),
    (2, "the cat sat on the mat and then the dog came in", "en", "a", 5, None, 1),
    (2, "the cat sat on the mat and then the dog came in", "en", "a", 5, None, 1),
    (3, "", "en", None, None, None, None),
    (4, None, None, "b", None, None, None),
    (5, " \n\t ", "de", "b", 3, None, None),
    (6, "12 345 --", None, "é", 9, None, None),
    (None, "der hund und die katze", "de", "b", 1, None, None),
    (None, None, None, None, None, None, None),
    (7, "wort " * 40_000, "de", "b", 200_000, None, None),
    (8, "Der Hund und die Katze sind im Haus", "de", "a", 1, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):  # noqa: F811
    rows = [(i, i % 2, 1 if i % 3 == 0 else 0) for i in range(9)] + [(None, 1, None), (3, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
