import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, size string, h string, node string, path string, d string, t string, k string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = "the quick brown fox jumps over the lazy dog near the old river bank. " * 3000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, long, "en", "b"),
        (6, "two words", "de", None),
        (7, "x" * 50_000, "de", "c"),
        (8, "!!! ... ???", "fr", "c"),
        (9, "Größe 日本語 naïve café \U0001f600 end", "de", "a"),
        (None, "no id here at all but some words to count", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 8) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
