import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string"):
        return spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(", ")) - len(r)) for r in rows], schema)

    return make
