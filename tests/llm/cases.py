"""Small awkward tables for all operators of the subpackage."""

import random

from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def docs(spark, rows):
    """``(doc_id, text)`` pairs as documents."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):
    """Nulls, empty and blank texts, a very long one, a repeated row, ties."""
    long_text = " ".join(words(40_000, 5))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "one two"), (5, "one two"), (None, "one two"),
        (6, "x" * 50_000), (7, "12345 !!! ***"), (8, "Grüße, naïve café 日本 😀"), (None, None),
    ]
    return docs(spark, rows)


def clashing(df, names):
    """``df`` with further columns of the given names."""
    return df.withColumns({name: F.lit("own") for name in names})
