import pytest

SCHEMA = "doc_id long, text string, source string, lang string, h long, fp string, words int, size string, copies int, members string, whole int, rest int, shard string, row int, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named like the operators' own."""
    extra = (1, "x", 2, "s", 3, "m", 4, 5, "sh", 6, "k")
    rows = [
        (0, "one two three four five", "a", "en", *extra),
        (1, None, "a", None, *extra),
        (2, "", "b", "en", *extra),
        (3, " \t\n ", "b", "en", *extra),
        (4, "lone", None, "en", *extra),
        (5, "one two three four five", "a", "en", *extra),
        (5, "one two three four five", "a", "en", *extra),
        (6, "Ünïcode wörds ÀÉ mail a.b@c.de and +1 (234) 567-8901 日本", "c", "de", *extra),
        (7, " ".join(f"w{i % 5000}" for i in range(60_000)), "c", "en", *extra),
        (None, "no id here", "a", "en", *extra),
        (None, None, None, None, *[None] * len(extra)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
