import pytest

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns that clash with an operator's own names."""

    def make(rows, schema="doc_id bigint, text string"):
        from pyspark.sql import functions as F

        clashing = ["n", "h", "hash", "row", "pos", "x", "n_words", "n_tokens", "key", "word", "value", "score", "start"]
        frame = spark.createDataFrame(rows, schema)
        return frame.withColumns({c: F.lit("clash") for c in clashing if c not in frame.columns})

    return make
