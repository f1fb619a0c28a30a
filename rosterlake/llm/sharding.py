"""Rendezvous hashing of record keys over weighted shards.

Every key scores every shard with ``-ln(u) / weight`` where ``u`` in (0, 1) is a
hash of key and shard number; the lowest score takes the record. A shard
that is added or whose weight grows only takes records to itself, because the
scores of the others stay as they are. Everything is a Spark expression.

* A null key is hashed as the text ``null``; repeated rows share key and shard.
* An empty table gives an empty result; a weight of 0 gives an empty shard.
* Extra columns pass through; the names of the added columns are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.columns import hash52, unused

#: Rows of one shard that share a numbering block, on average.
BLOCK_ROWS = 4096


def shard_of(key: Column, weights: Sequence[float], salt: str = "") -> Column:
    """The number of the shard that takes ``key``: rendezvous over ``weights``."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one weight must be positive")
    # one expression for all shards; ties (equal scores) go to the lowest number
    scores = [
        F.struct(
            (-F.log((hash52(F.lit(salt + str(j)), key) + F.lit(0.5)) / F.lit(2.0**52)) / F.lit(float(w))).alias("s"),
            F.lit(j).alias("j"),
        )
        for j, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["j"]


def add_shard(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    return df.withColumn(name, shard_of(F.col(key), weights))


def add_slot(df: DataFrame, shard: str, order: Sequence[str], rows: int, name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard may hold a large part of all rows, so no window spans one. Rows
    fall into blocks by a hash of the order columns; blocks are counted, their
    counts summed, and rows numbered within their block. ``rows`` (the size of
    the table) only sets the number of blocks, which the result depends on as
    any numbering does; equal inputs give equal numbers.
    """
    blocks = max(1, rows // BLOCK_ROWS)
    block, before = unused(df, "_block"), unused(df, "_before")
    placed = df.withColumn(block, F.pmod(hash52(F.lit("slot"), *[F.col(c) for c in order]), F.lit(blocks)))
    counts = placed.groupBy(shard, block).agg(F.count("*").alias(before))
    so_far = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(so_far), F.lit(0)))
    within = Window.partitionBy(shard, block).orderBy(*order)
    return (
        placed.withColumn(name, F.row_number().over(within).cast("long") - 1)
        .join(counts, [shard, block])
        .withColumn(name, F.col(name) + F.col(before))
        .drop(block, before)
    )
