import pytest


@pytest.fixture
def docs(spark):
    """Rows -> a documents table with every edge: columns doc_id, text, lang, source and one that clashes."""

    def make(rows, lang="en", source="s"):
        data = [(d, t, lang, source, "clash") for d, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, ids string")

    return make
