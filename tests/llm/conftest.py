import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing names."""
    long_text = "wort " * 30_000 + "x" * 5_000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 10, "S", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "S", 2),
        (4, long_text, "de", None, len(long_text), None, None),
        (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 10, "S", 1),
        (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 10, "S", 1),
        (6, " \t\n ", None, "s", 4, "S", 3),
        (7, "été 漢字 тест 😀 ñ", "fr", "s", 15, "S", 3),
        (None, "a null key", "en", "s", 10, "S", 3),
        (8, "one", "en", "s", 3, "S", 3),
        (9, "12 34 !! ??", "en", "s", 11, "S", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
