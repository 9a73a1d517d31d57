import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) or (id, text, lang) rows, with columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    """id -> text of the test documents."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


#: Null, empty, blank, wordless, one letter, long, tied and repeated texts.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ??? ..."), (5, "a"), (6, "word " * 20_000), (7, "x" * 30_000), (8, "same text here"), (9, "same text here"), (9, "same text here"), (None, "no id"), (10, "é é Ａ 日本 \U0001f600 \x00 ﬁ")]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
