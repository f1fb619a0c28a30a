"""The next row in ascending order of an id, for every row, without one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a block. Rows are sorted within blocks only.
BLOCK_IDS = 1024
#: Most blocks whose first ids are sent to all tasks (some tens of megabytes).
BROADCAST_BLOCKS = 500_000


def with_next(df: DataFrame, doc_id: str, columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """``df`` with ``columns`` of the next row as ``prefix`` + name; the
    last row gets the first one's.

    Blocks of consecutive ids are the partitions of a window. The last row of a
    block gets the first row of the next block, of which there is one
    for each ``BLOCK_IDS`` ids. Null ids come first; of rows with one id the order is
    that of ``columns``.
    """
    block = F.coalesce(F.floor(F.col(doc_id) / BLOCK_IDS), F.lit(-(1 << 62)))
    df = df.withColumn("_block", block)
    within = Window.partitionBy("_block").orderBy(doc_id, *columns)
    this = F.struct(*columns)
    led = df.withColumn("_next", F.lead(this).over(within))
    firsts = df.groupBy("_block").agg(F.min(doc_id).alias("_first"))
    ordered = Window.orderBy("_block")
    around = F.coalesce(F.lead(F.struct("_first")).over(ordered), F.first(F.struct("_first")).over(ordered))
    after = firsts.withColumn("_after", around["_first"])
    wanted = after.select(F.col("_after").alias("_id")).distinct()
    if firsts.count() <= BROADCAST_BLOCKS:  # else a shuffle of the rows finds them
        wanted = F.broadcast(wanted)
    heads = df.join(wanted, F.col(doc_id).eqNullSafe(F.col("_id")), "left_semi")
    heads = heads.groupBy(F.col(doc_id).alias("_id")).agg(F.min(this).alias("_head"))
    heads = after.join(heads, F.col("_after").eqNullSafe(F.col("_id"))).select("_block", "_head")
    joined = led.join(heads, "_block", "left")
    following = F.coalesce("_next", "_head")
    return joined.select(
        *[c for c in df.columns if c != "_block"], *[following[c].alias(prefix + c) for c in columns]
    )
