import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, as columns a caller might have.
CLASHES = ["row", "rep", "stamp", "score", "label", "kept", "host", "path", "at", "n_words", "component_id", "e", "w", "_id", "bucket", "doc"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, source[, lang]]) rows, with columns whose names clash with inner ones."""

    def make(rows, clashes=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit(None).cast("int") for c in CLASHES}) if clashes else df

    return make


@pytest.fixture(scope="session")
def pages_of(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        return df.withColumns({c: F.lit(None).cast("int") for c in CLASHES})

    return make
