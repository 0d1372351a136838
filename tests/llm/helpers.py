"""Small tables with the awkward cases that every operator must stand."""
from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, lang="en", extra=False):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return clash(df) if extra else df


def clash(df):
    """Extra columns with names that operators might use themselves."""
    from pyspark.sql import functions as F
    for name in ("spans", "score", "node", "label", "count", "part", "rank", "_text", "template", "row", "text_a", "digest"):
        df = df.withColumn(name, F.lit("x"))
    return df


def awkward(spark, word="alpha"):
    """Null, empty, blank and very long texts, repeated rows, a null id."""
    long = " ".join(f"{word}{i % 997}" for i in range(60_000))
    rows = [(0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " \n\t", None, "s", 3), (3, long, "en", None, len(long)),
            (4, "one short text", "en", "s", 14), (4, "one short text", "en", "s", 14), (None, "text without an id", "en", "s", 1),
            (5, "\U0001d4d0é中 \x00́ <|endoftext|>", None, "s", 1)]
    return clash(spark.createDataFrame(rows, DOCS))


def empty(spark):
    return clash(spark.createDataFrame([], DOCS))
