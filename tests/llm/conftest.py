import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "", "", 4),
        (6, "one two", "en", "b", 7),
        (7, "ONE  two", "en", "b", 7),
        (8, "mot " * 9000, "fr", "c", 1),
        (None, "Released under the MIT License.\nnaïve 😀 été", "en", None, 5),
        (9, "Released under the MIT License.\nnaïve 😀 été", "en", "b", 5),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).select("*", F.lit(7).alias("size"), F.lit("x").alias("ids"), F.lit(True).alias("kept"), F.lit("y").alias("rule"))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
