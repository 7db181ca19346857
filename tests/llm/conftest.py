import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null ids and texts, empty and blank texts, repeated rows, ties, every code point length, a text of a million characters
EDGE = [
    (1, None, "en", "web", 0),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "web", 4),
    (4, "one", None, None, 3),
    (5, "naïve 漢字 😀 é x y", "fr", "web", 20),
    (6, "a b c a b c\n\na b c\na b c\n # * $ % & | < >", "en", "web", 40),
    (7, "same text of seven words in all", "en", "books", 31),
    (7, "same text of seven words in all", "en", "books", 31),
    (8, "same text of seven words in all", "en", "books", 31),
    (None, "same text of seven words in all", "en", "books", 31),
    (None, None, None, None, None),
    (9, "long words " * 90_000, "en", "web", 990_000),
    (10, "x" * 300_000, "en", "web", 300_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with further columns whose names clash with those of results (in another case as well)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, DOCS)
    for c in ("n_words", "KEPT", "size", "Shard", "h", "bin", "class_id", "row", "spans"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")
