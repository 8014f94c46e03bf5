"""Fixtures that the tests of this folder share."""

import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku ma me mi mo mu".split() for b in "n r s l t".split()]

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(rng, n):
    """Lines of random words."""
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 12]) for i in range(0, n, 12))


def varied(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="session")
def documents(spark):
    def build(texts):
        """Rows of documents from texts in order, or from (doc_id, text)."""
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, repeated rows, a null and a repeated doc_id, a very long text and a very long word."""
    rng = random.Random(5)
    text = prose(rng, 200)
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, text), (3, text), (4, text), (5, varied(rng, text, 3)), (6, "one"), (2**62 + 1, "a large number"),
        (7, prose(rng, 30_000)), (None, text), (None, None), (8, "w" * 20_000), (8, "another text of the same number"),
        (9, "Ünïcödé 日本語 🙂 <|endoftext|> password = 'abcdefghijklmnop'"), (10, text.replace(" ", "  ")),
    ]


@pytest.fixture(scope="session")
def clashing(documents):
    """Adds columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_salt", "_id", "_tie", "_gone", "_found", "rep", "key", "blob", "spans", "bucket", "vector", "toxicity",
             "held_out", "left", "item", "length", "toxic", "ids", "piece", "removed_lines", "score", "text_hash"]

    def add(df):
        return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])

    return add
