import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A table of (doc_id, text, lang, source) and columns whose names clash with others."""

    def make(rows):
        full = [(i, t, lang, source, "f", 1, "x", "y") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, _id string, _n int, kept string, keep_id string").repartition(3)

    return make
