import pytest
from pyspark.sql import functions as F

# Columns of the input that a careless operator would trip over.
CLASHING = ["row", "item", "n", "place", "size", "p", "component", "n_words", "host", "kept", "words",
            "print", "id", "_source", "c0"]


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts or (doc_id, text, source) rows, with clashing columns."""
    def make(*rows):
        rows = [(i, row, "s") if row is None or isinstance(row, str) else row
                for i, row in enumerate(rows)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        return docs.withColumns({name: F.lit("x") for name in CLASHING})
    return make


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()),
                  key=lambda r: tuple((v is not None, v) for v in r))
