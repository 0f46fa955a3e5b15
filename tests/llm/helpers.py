"""Small document tables with every awkward row, and brute-force versions of the operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use inside
CLASHES = ("key", "id", "label", "size", "kept", "fp", "copies", "target", "row", "at", "host", "declared", "a.b")


def documents(spark, texts, lang="en", source="s", first=0):
    rows = [(first + i, t, lang, source, len(t) if t else None) for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, SCHEMA))


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(("the", "of", "and", "river", "stone", "Light", "falls", "near", "old", "town", "wind", "sea")) + rng.choice(("", "", "", ",", "ing", "s")) for _ in range(words))
