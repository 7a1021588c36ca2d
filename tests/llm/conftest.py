import pytest


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and an extra column with a clashing name."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumn("n_words", df.n_chars).withColumn("component_id", df.source) if extra else df

    return make
