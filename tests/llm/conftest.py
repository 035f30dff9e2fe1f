import pytest
from pyspark.sql import types as T

from callsight.llm.common import table

LONG = " ".join(f"word{i % 977} the{i % 13}" for i in range(40_000))
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t \n"),
    (4, "one"),
    (5, "one two three"),
    (6, LONG),
    (7, LONG),
    (8, "Émile’s café — 東京 😀 ñandú  x y z\nline\nline\n"),
    (9, "a b c d e f g h i j k l m n o p q r s t"),
    (9, "a b c d e f g h i j k l m n o p q r s t"),
    (None, "a b c d e f g h i j k l m n o p q r s t u"),
    (None, None),
    (-5, "# # * $ % & | < > <|endoftext|> it's we'll"),
]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with columns whose names clash with those that operators add."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("kept", T.StringType()),
            T.StructField("n_words", T.StringType()),
            T.StructField("toxic", T.StringType()),
            T.StructField("items", T.StringType()),
            T.StructField("ids", T.StringType()),
        ]
    )
    langs = ["en", None, "EN", "xx", ""]
    rows = [(i, t, langs[k % 5], "k", "n", "t", "i", "d") for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
