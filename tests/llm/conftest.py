import pytest

from tests.llm.brute import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with names that operators use inside."""
    rows = [(i, t, "xx", "src", 1, 7, "z", 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, run int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)
