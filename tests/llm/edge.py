"""Rows every operator must take: nulls in any column, empty, blank and very long
texts, ties, repeated rows, and extra columns whose names clash."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
NO_SPACE = "x" * 50_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in (
                          "lang", "source", "id", "u", "v", "key", "c", "quality", "toxicity", "score", "kept",
                          "shard", "slot", "length", "part", "word", "cls", "lid", "rank")])
WIDTH = len(SCHEMA)

TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (5, "one two three four five six"),
    (5, "one two three four five six"), (6, LONG), (7, LONG), (8, NO_SPACE), (None, "no id here at all"),
    (None, None), (9, "Ünï cødé ΑΣ 日本語 👍 <|endoftext|> end"), (10, "the and of " * 40), (100, "one two three four"),
]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, *(["x", None] * WIDTH)[:WIDTH - 2]) for i, t in rows], SCHEMA)


def labels(spark, rows=((4, 1, 0), (6, 1, 0), (10, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
