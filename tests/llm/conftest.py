import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, th long, band long, spans string, score double"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), with extra columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, 8, 9, "x", 0.5) for i, t in rows], SCHEMA)

    return build
