import pytest

ODD = "doc_id long, text string, n_lines string, ids string, spans string, score string, kept string, node string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    x = ("a", "b", "c", "d", "e", "f")
    rows = [(1, "Same Line\nother one", *x), (2, "same line\nOTHER one", *x), (2, "same line\nOTHER one", *x), (3, None, *x), (4, "", *x), (None, "no id", *x), (5, "word " * 30_000, *x), (6, "é 漢字 \x85 tail", *x), (7, "Same Line\nother one", *x), (8, " \n\n ", *x)]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
