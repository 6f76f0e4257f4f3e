import pytest

ODD = [
    (None, "a text without a key", None, None, 3),
    (1, None, "en", "s", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", "de", "s", 3),
    (4, "The quick brown fox jumps over the lazy dog, then the dog jumps over the quick brown fox again and again.", "en", "s", 0),
    (4, "The quick brown fox jumps over the lazy dog, then the dog jumps over the quick brown fox again and again.", "en", "s", 0),
    (5, "THE quick brown fox jumps over the lazy dog, then the dog jumps over the quick brown fox again and again.", "en", "t", 0),
    (6, "x" * 20_000 + " " + "long words and many of them " * 3_000, "en", "t", 0),
    (7, "1234 5678 !!", "en", "t", 0),
    (8, "été à la plage, naïve 漢字 🙂 <|endoftext|> end  of\n\n it", "fr", "t", 0),
    (9, "one", None, "t", 0),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(*r, 1, 2, "h", [1], 5, "w", 0.5, "k") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k long, n long, hits string, ids array<int>, pid long, words string, score double, label string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
