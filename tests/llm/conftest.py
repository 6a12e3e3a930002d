import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts; ids count from 0."""

    def make(texts, **columns):
        rows = [(i, t, None, None, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """A fresh folder name that does not exist yet."""
    root = tmp_path_factory.mktemp("llm")
    return lambda name: f"{root}/{name}"
