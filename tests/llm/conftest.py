import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs; the language may be a third value."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def folder(spark, documents, tmp_path):
    """A folder with a documents table, as queries read it."""

    def make(*rows, **others):
        documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
        for name, df in others.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
