"""Models that several queries and pipeline stages train in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import language

#: The vocabulary whose pieces language identification weighs.
PIECES = "piece_bpe_32k.model"


def public_file(name: str) -> str:
    """The place of a file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    """Rows that no model learns from: crc32 of doc_id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> language.Model:
    """Trained on the labelled documents of ``docs`` that aren't held out."""
    return language.train(docs.where(~held_out()), language.vocabulary(public_file(PIECES)))
