import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeats, a very long text, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, 5, "a"), (2, "", "en", None, "b"), (3, " \n\t ", "en", 0, None), (4, "one two three", None, 1, "d"),
        (4, "one two three", None, 1, "d"), (None, "one two three", "de", 2, "e"), (7, long, "en", 3, "f"), (8, long + " end", "en", 3, "g"),
        (9, "é ñ 漢字 🙂 \x1c nul", "fr", 4, "h"),
    ]
    schema = "doc_id long, text string, lang string, n_words long, start string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
