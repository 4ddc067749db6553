import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog while the sun sets slowly over the quiet hills beyond"),
    (2, "The quick brown fox jumps over the lazy dog while the sun sets slowly over the quiet hills beyond"),
    (3, "Yesterday, the quick brown fox jumps over the lazy dog while the sun sets slowly over the quiet hills beyond us"),
    (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "é ü ▁ 漢字 <|endoftext|> a  b   c \x00 \x1c end "),
    (9, LONG), (10, LONG + " tail"), (11, "a " * 60), (12, "CC-BY and cc by cc by; General Public License, all rights reserved"),
    (None, "no id here but words enough to fill a window of thirteen words and some more of them"),
    (None, None), (7, "one"), (7, "one more under the same id"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and very long texts, ties, repeated rows and extra columns whose names clash with results."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("row", T.IntegerType()), T.StructField("fp", T.IntegerType()), T.StructField("ids", T.StringType()),
        T.StructField("Size", T.IntegerType()), T.StructField("n_words", T.StringType()),
    ])
    rows = [(i, t, None, ["a", "b", None][n % 3], None, "s", n, 1, "x", 2, "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
