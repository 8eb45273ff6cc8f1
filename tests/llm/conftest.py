"""Fixtures of the corpus operators: a small real corpus and one of edge cases."""

import pytest

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, "the same text again", "en", "b", 19, 7), (1, "the same text again", "en", "b", 19, 7), (2, " the same\ttext  again\n", "en", "a", 22, 7),
    (3, None, None, None, None, None), (4, "", "en", "a", 0, 1), (5, " \t\n", "en", None, 3, 1), (None, "a row without an id", "en", "b", 19, 2), (None, "the same text again", "en", "c", 19, 2),
    (6, "x", "en", "c", 1, 3), (7, "w" * 200_000, "en", "a", 200_000, 3), (8, "one two three four five six seven " * 4_000, "en", "b", 1, 3),
    (9, "ünï cödé \U0001f600 text\r\nwith\x0bcontrols\x0c", "de", "é", 1, 3), (10, "The SAME Text again", "en", "z", 19, 3), (-5, "negative id", "en", "b", 11, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept long"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, and a column whose name clashes."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(EDGE, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
