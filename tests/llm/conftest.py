import pytest


@pytest.fixture(scope="session")
def tokenizer():
    from strideframe.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (id, text) pairs, with columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 7, "n") for i, t in rows], "doc_id long, text string, score string, node long, spans string")

    return make
