import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("row", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("Size", T.LongType()),
    T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("n", T.LongType()),
])


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text and a very long word, equal rows, equal ids."""
    base = " ".join(f"word{i % 97} and{i}" for i in range(60))
    near = base.replace("and30", "or30")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", None), (4, None, "en", "a"), (5, "", None, "b"),
        (6, " \t\n ", "de", "a"), (7, "one", "de", "a"), (7, "one", "de", "a"), (7, "other text here", "de", "b"),
        (None, "no id at all", "fr", "c"), (None, None, None, None), (8, "x" * 70_000, "en", "a"),
        (9, " ".join(f"t{i * 7919 % 5003}" for i in range(40_000)), "en", "a"), (10, "a\nb\na\n\na bé  c d", "en", "c"),
        (11, "same words " * 40, "en", "b"), (12, "# * $ % & | < >", "es", "b"),
    ]
    return [(*r[:4], i if i % 3 else None, "r", 1, 2, 3, "k", 4, "s", 5) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
