import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns that a table may bring along and that operators use as names of their own.
CLASHES = ("block", "order", "fp", "root", "size", "word", "signature", "n_tokens", "n_lines", "n_dropped", "_drop", "_text", "score", "toxicity", "at")


def prose(seed, n, letters="abcdeéß"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and long texts, ties and repeated rows."""
    same = prose(1, 80)
    return [
        (None, prose(2, 60), "en", "a"),
        (None, None, None, None),
        (1, None, "en", "a"),
        (2, "", "de", None),
        (3, " \n\t ", None, "b"),
        (4, same, "en", "a"),
        (4, same, "en", "a"),
        (5, same, "de", "c"),
        (6, prose(3, 90) + "\n" + same, None, "b"),
        (6, prose(4, 3), "fr", "b"),
        (7, prose(5, 40_000), "en", "a"),
        (8, "x" * 50_000, "en", "b"),
        (9, "one", "en", "c"),
        (10, "日本語 \x00 text \U0001f600", "ja", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with the columns that clash."""
    from pyspark.sql import functions as F

    return table(spark, odd_rows).withColumns({c: F.lit("taken") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
