"""Awkward rows that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(20000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at night"


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, BASE, "en", "a", 5),
        (2, BASE, "en", None, 5),
        (3, None, None, "b", None),
        (4, "", "de", "a", 0),
        (5, " \t\n", "de", "b", 3),
        (6, LONG, "en", "a", len(LONG)),
        (7, "12345 67 !!", None, None, 11),
        (8, "kurz", "de", "c", 4),
        (8, "kurz", "de", "c", 4),
        (None, "a row without an id stays as it is", "en", "c", 9),
        (9, "漢字 と かな é ü", "de", "c", 9),
        (10, BASE.replace("seven", "eight"), "en", "b", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("row", "cuts", "n_entities", "_kept", "_mixed_id", "_mixed_size", "_mixed_times", "contamination", "same", "node", "least", "_same", "_kept_id", "_copy", "_index", "_block", "_before", "_size", "_language", "_contamination", "_words", "_mins", "_filled", "_found", "_row", "key", "size", "id"):
        df = df.withColumn(name, F.lit(name))
    return df
