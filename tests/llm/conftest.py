import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, schema=DOCS):
        return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], schema)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, ties, non-ASCII, and a very long text."""
    return [None, "", " \n\t", "one", "one", "ünï cödé 漢字 😀", "a b c d e f", "a b c d e f", "word " * 30_000, "x" * 60_000]
