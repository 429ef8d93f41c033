import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "plain text of a few words here", "en", "s", 1.0, "x", 7),
        (1, "plain text of a few words here", "en", "s", 1.0, "x", 7),
        (2, "", "en", None, None, None, None),
        (3, None, None, None, None, None, None),
        (None, "a row without an id has words", "en", "s", 0.0, "x", 1),
        (None, None, None, None, None, None, None),
        (4, long, "en", "s", 0.0, "x", 1),
        (5, " \t\n ", None, "s", 0.0, "x", 1),
        (6, "?!\x00\U0001f600 ́", "de", "s", 0.0, "x", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, fp string, length int")
    # Names that operators use for columns of their own.
    for name in ("_score", "_hit", "_items", "_words", "_changed", "_removed", "_th", "_doc", "_drop", "_bucket", "_shard", "_slot", "_size", "_file", "th", "removed", "node", "shard"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
