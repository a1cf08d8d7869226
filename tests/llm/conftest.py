import pytest

LONG = "wort " * 30_000
EDGE = [
    (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "x", None, "a", 1), (4, "x", "en", "b", 1),
    (5, LONG, "de", "a", 5), (6, "é" * 5000 + " " + "ab\ncd\n" * 50, "fr", "b", 5), (7, "\x00\x01 \t\n", "en", "c", 3),
    (8, "one two three four five six seven eight nine ten " * 3, "en", "a", 1), (8, "one two three four five six seven eight nine ten " * 3, "en", "a", 1),
    (9, "😀 😀 text with emoji 12 34", "en", "a", 1),
    (None, "a row without an id, of some words and more than fifty bytes", "en", "a", 1), (None, None, None, None, None), (None, "x", "en", "b", None),
    (2**53 + 1, "ids beyond the floats, of some words and more than fifty bytes", "en", "a", 1), (2**53 + 3, "ids beyond the floats, of some words and more than fifty bytes", "en", "a", 1),
    (-4, "a negative id", "en", "a", 1), (11, "one id with two texts", "en", "a", 1), (11, "another text of this id", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties; extra columns whose names may clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({k: F.lit(7) for k in ("rule", "n_words", "size", "shard", "h", "block", "kept", "start")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
