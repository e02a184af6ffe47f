import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Nulls, empty and very long texts, ties, repeated rows, and a column that an operator might use itself.
HARD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "x" * 20_000, "b"),
    (6, "word " * 5_000, None), (7, "é ü 中文 \U0001f600 " * 50, "c"), (8, "the same line of text\n" * 40, "c"), (9, "one", "c"), (None, "no id at all", "a"),
]


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, _t string")
