"""Small document tables."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def documents(spark, texts, **columns):
    """A table of documents numbered from 0; ``texts`` are texts, or (doc_id, text)."""
    rows = []
    for k, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (k, t)
        rows.append((key, text, columns.get("lang", "en"), columns.get("source", "a"), None if text is None else len(text)))
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns with odd names."""
    from pyspark.sql import functions as F

    long = words(60_000, 1)
    rows = [(1, None, None, None, None), (None, words(30, 2), "en", None, 5), (2, "", "en", "a", 0), (3, "   \n", "en", "a", 4), (4, long, "en", "b", 9), (5, words(40, 3), "en", "a", 7), (5, words(40, 3), "en", "a", 7), (6, words(40, 3), None, "b", 7), (7, words(40, 4), "en", "a", 7), (7, words(50, 5), "en", "a", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "t", "d", "h", "__gone", "__bad", "__text", "position", "component", "jaccard", "a.b"):
        df = df.withColumn(name, F.lit(1))
    return df
