import pytest

LONG = " ".join(f"word{i % 977} the of" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "a", 62, 5), (1, base, "en", "a", 62, 5), (2, base, None, None, None, None), (3, None, "en", "a", 0, 1),
        (4, "", "en", "a", 0, 1), (5, " \n\t ", "en", "b", 3, 1), (None, base, "en", "b", 62, 1), (None, None, None, None, None, None),
        (6, LONG, "en", "b", len(LONG), 1), (7, LONG, "en", "b", len(LONG), 1), (8, "!!! 123 ???", "fr", "b", 11, 1),
        (9, base.upper() + " extra", "en", "b", 1, 1), (1, "quite another text under the same id", "en", "a", 1, 1),
        (10, "Ünïcode é 漢字 🙂 mail x.9@site3.example.com", "de", "a", 1, 1),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key long"
    ).selectExpr("*", "n_chars AS n", "key AS component", "source AS a", "source AS class")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
