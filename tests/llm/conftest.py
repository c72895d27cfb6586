import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and blank texts, a very long one, repeated rows, and columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in rows], "doc_id long, text string, lang string, source string, size long, spans long, component string")

    return make
