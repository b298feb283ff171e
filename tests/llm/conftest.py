import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts."""
    plain = "The quick brown fox jumps over the lazy dog while seven wise owls look on from the old oak tree. "
    rows = [
        (1, plain * 3, "en", "a", 1),
        (1, plain * 3, "en", "a", 1),
        (2, plain * 3, "en", "b", 1),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (None, plain + "And then some more words follow here.", "en", None, None),
        (None, None, None, None, None),
        (5, "word " * 40_000 + "x" * 30_000, "en", "a", 230_000),
        (6, "   \n\t  ", "de", "c", 7),
        (7, "Ünïcödé <|endoftext|> 漢字 😀 ² \x1c end", "fr", "c", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
