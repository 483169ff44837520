import random

import pytest
from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
          ("source", T.StringType()), ("n_chars", T.LongType()),
          # extra columns whose names clash with outputs and helpers
          ("score", T.StringType()), ("size", T.StringType()), ("row_id", T.StringType()),
          ("key", T.StringType()), ("kept", T.StringType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", "y", "z", "k", "no")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90))
                    for _ in range(30000))
    rows = [row(1, None), row(2, ""), row(3, "  \t\n"), row(4, "One two three four"),
            row(5, "one two three four", None, None), row(5, "one two three four", None, None),
            row(6, "One two three four", "de", "b"), row(7, long), row(8, long + " end"),
            row(None, "a null id", "de", None), row(9, "!!! 123 ???", "fr", "c"),
            row(10, "éàü ñandú Straße 🙂 x" * 20, "fr", "b"), row(11, "x", None, "b"),
            row(12, "y" * 200000, "de", "c"), row(13, "a\x01b \x1cc\x1c <|endoftext|> d", "en", "c"),
            (14, "hello there world", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
