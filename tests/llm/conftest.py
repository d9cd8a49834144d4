import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Build a documents table from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows, schema=DOCS):
        full = [(*r, *[None, None][: 4 - len(r)], len(r[1] or "")) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make
