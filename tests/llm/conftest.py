import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)

    return make
