import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_lines string, line string, key int, block int"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, extra columns with clashing names."""
    long = "The quick brown fox jumps over it. " * 12000
    shared = "this line stands in several documents"
    rows = [
        (1, "Plain words of one document\n" + shared, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, " \t\n ", "de", None),
        (5, long, "en", "a"),
        (6, "Plain words of one document\n" + shared, "en", "a"),
        (6, "Plain words of one document\n" + shared, "en", "a"),
        (7, "  " + shared.upper() + "\t\nshort\nshort\nDer Hund läuft über die Straße", "de", "b"),
        (8, "12345 !!! ###", None, None),
        (None, shared + "\nohne Nummer", "de", "b"),
        (10, "ein anderer Text über Hunde und Katzen 😀 <|endoftext|> it's they'll 's", "de", "c"),
        (11, long + " x", "en", "a"),
        (12, "a" * 5000, "en", "c"),
    ]
    extra = [(*r, 1, 2, "x", "y", 3, 4) for r in rows]
    return spark.createDataFrame(extra, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
