import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with extra, clashing columns from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, None, "s", None if t is None else len(t), 0.5, 7) for i, t in rows], SCHEMA
        )
    return make
