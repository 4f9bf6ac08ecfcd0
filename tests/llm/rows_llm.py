"""Tables that the tests of the training-data operators share."""

import pytest

DATA = "/root/testdata/sf0.001"
NASTY = "doc_id long, text string, lang string, source string, n_chars long, ID long, fp string, Key string, tie int, part string, found int, rank string, node string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) in order."""
    return [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]


def _rows():
    long_text = "the whole of erand thesh " * 12000
    own = [
        (1, "The erand of thesh in the onre of that, and ereand. Call +1 988 555 2485 or a@b.cd now"),
        (1, "The erand of thesh in the onre of that, and ereand. Call +1 988 555 2485 or a@b.cd now"),
        (1, "another text under the same id, which is not equal to the first one by any means"),
        (None, "no id but some words that stand here for a while and then end"),
        (None, None),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, long_text),
        (6, long_text),
        (7, "x" * 150000),
        (8, "12345 678 +++"),
        (9, "漢字 текст é 😀"),
        (10, "one"),
    ]
    fill = (7, "fp", "k", 3, "p", 1, "r", "n")
    return [(i, t, None if i is None or i > 8 else "en", None, None if t is None else len(t), *(fill if i != 3 else (None,) * 8)) for i, t in own]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names."""
    return spark.createDataFrame(_rows(), NASTY)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NASTY)
