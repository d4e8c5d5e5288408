import pytest

LONG = "word " * 30_000 + "x" * 50_000


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 7, "p"), (2, "the cat sat on the mat and looked at the dog", "en", "b", 7, None), (3, None, None, None, None, None), (4, "", "en", "a", 0, "q"), (None, "some text without an id here", "en", "a", 1, "r"),
        (5, LONG, "en", "a", len(LONG), "s"), (6, "   \n\t ", "de", "c", 6, "t"), (1, "the cat sat on the mat and looked at the dog", "en", "a", 7, "p"), (7, "Ünïcode “quotes” — 日本語 \U0001f600 \u0000 end", "ja", "d", 3, "u"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").withColumnRenamed("n_chars", "spans")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts_by_id(documents):
    return {r.doc_id: r.text for r in documents.collect()}
