import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names clash with those that the operators make."""

    def make(texts, ids=None):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest synthetic corpus."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
