import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in every column, empty and repeated rows, ties, one long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "x y z", "en", "a"), (3, "same text here", "en", "b"), (3, "same text here", "en", "b"), (4, "same text here", None, "b"), (5, long, "en", "a"), (6, "\t \n", "en", None), (None, None, None, None), (7, "é 腾讯 😀", "zh", "a")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
