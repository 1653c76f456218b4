import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    long = "wordy " * 40_000
    rows = [
        (1, "plain words in one line here", "en", "a", 28),
        (1, "plain words in one line here", "en", "a", 28),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "no id at all for this text", "de", "b", 26),
        (4, long, "fr", "a", len(long)),
        (5, " \t\n ", "en", "b", 4),
        (6, "Ünïcödé 😀 text with ſigns and K", None, "c", 30),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("component_id", "fp", "row", "_tie", "tie", "src", "size", "kept", "score", "label", "words", "runs", "a", "h", "entry"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)
