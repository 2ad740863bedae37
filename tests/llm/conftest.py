import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, body string, n long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text and clashing names."""
    line = "A line that is long enough to be compared with others"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs into the forest", "en", "s1", 10, "x", 1),
        (1, "the quick brown fox jumps over the lazy dog and runs into the forest", "en", "s1", 10, "x", 1),
        (2, "", "en", "s1", 0, None, None),
        (3, None, None, None, None, None, None),
        (None, "words of a text without an id that nobody else has", "en", None, 5, "y", 2),
        (None, None, None, None, None, None, None),
        (4, " \t\n \n", "fr", "s2", 4, "", 0),
        (5, "le petit chat est dans la maison " * 4000, "fr", "s2", 100, "z", 3),
        (6, "\n".join(["und", line, "der", line]), "de", "s2", 9, "z", 3),
        *[(k, "\n".join([f"document {k}", f"  {line.upper()} \t"]), "de", "s3", 9, "z", 3)
          for k in range(7, 12)],
        (12, "und\r\nder\n", "xx", "s3", 9, "z", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
