import pytest


@pytest.fixture
def documents(spark):
    """Rows -> a table of documents with columns whose names clash with inner ones."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, key string, row int, _doc int, pos int, size int"
        return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], schema)

    return make
