import pytest


@pytest.fixture()
def docs_of(spark):
    """(texts, ids) -> documents with an extra column whose name clashes with the operators' own."""

    def of(texts, ids=None):
        rows = [(i, t, "en", "s", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")

    return of
