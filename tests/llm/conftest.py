import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, repeated ids, other scripts, columns that clash."""
    long = "one two three four five six seven. " * 3000
    rows = [
        (1, "hello world, this is a text of some words", "en", 0.5, 1), (1, "hello world, this is a text of some words", "en", 0.5, 1), (2, None, None, None, None),
        (3, "", "de", 0.1, 0), (4, " \n\t ", None, 0.2, 1), (5, long, "en", None, 0), (6, "短い文 です 😀 İΣς", "ja", 0.3, None), (None, "no id here at all", "en", 0.1, 1),
        (8, "hello world, this is a text of some words", "en", 0.9, 1), (9, "***", "en", 0.1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int")
