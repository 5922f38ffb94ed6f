import pytest

#: Nulls in every column, blank and long texts, ties, repeated rows, and a column whose name is used inside.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1, 5),
    (2, "alpha  beta gamma delta\tepsilon zeta.", "en", "a", None, 5),
    (3, None, None, None, None, None),
    (4, "", "de", "b", 0, 5),
    (5, " \t\n\x0b\x0c\r", "de", "b", 0, 5),
    (6, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1, 5),
    (6, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1, 5),
    (None, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1, 5),
    (-7, "line of text one\nline of text two\nline of text one", "fr", "c", 9, 5),
    (8, "x\nLINE OF TEXT ONE \nother words here", "fr", "c", 9, 5),
    (9, "wörd \U0001f600 größe naïve\x00 ▁ end  ", "de", "c", 9, 5),
    (10, "long words again " * 20000, "en", "c", 9, 5),
    (11, "y" * 50000, "en", "c", 9, 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
