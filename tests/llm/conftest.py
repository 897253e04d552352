import pytest


@pytest.fixture
def table(spark):
    """Small documents table from (doc_id, text[, lang, source]) tuples."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string"):
        width = len(schema.split(","))
        return spark.createDataFrame([(*r, *(["en", "s"][: width - len(r)])) for r in rows], schema)

    return make
