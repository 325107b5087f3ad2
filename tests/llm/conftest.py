import pytest
from llm_cases import ODD

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents tables; the last columns clash with names that operators use."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)
