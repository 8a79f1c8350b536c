import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame with doc_id, text and two columns whose names clash with results."""

    def make(texts, ids=None):
        rows = [(i, t, 1.0, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, score double, spans string")

    return make
