import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs."""

    def build(pairs, schema=DOCS):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """A given table at the smallest scale."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
