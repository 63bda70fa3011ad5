import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, size string"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (id, text, lang, source) rows; two more columns clash with names the operators use."""
    return lambda rows: spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
