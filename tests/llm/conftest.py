import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0, letters="abcdefghijklmnop"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, odd characters."""
    base, long = words(120, 1), words(30_000, 2)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, "en", "a", None), (4, "", "de", "b", 0), (5, " \t\n\x0b\x0c\r ", None, None, 3),
            (6, long, "en", None, 2), (7, "Ünï çødé — 漢字 😀 é ǅ", "de", "b", 5), (8, "x", None, "a", 1), (8, "x", None, "a", 1),
            (None, base + " tail", "en", "a", 1), (None, "lonely null id " + words(40, 3), "de", "c", 1), (9, "one two", "en", "c", 2),
            (10, "\n\nsame line here\nsame line here\n\n" * 3, "en", "b", 9), (11, "don't <|endoftext|> STOP. it's 12 o'clock!", "en", "b", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    for name in ("_id", "_rows", "_copies", "_row", "size", "rank", "node", "label", "bands", "host", "score", "n_words", "kept", "_pid", "page_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
