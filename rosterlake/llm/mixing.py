"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents, in an order shuffled by a hash, through a queue.
A document's virtual finish time is the number of its source's words up
to and with it, divided by the source's target. All entries are ranged by finish
time and taken until their words reach the total budget; the entry that
crosses it is cut to fit. A source whose target is above its size queues its
documents again, up to ``repeats`` times; targets above that are cut and the
excess goes to the others by weight.

Sources may hold any part of the rows: running sums are taken over blocks
of the shuffled order, and only the block of finish times in which the
budget ends is ordered row by row.

* Null and empty texts have size 0 and are never taken; null is a source of its own.
* Repeated rows are separate documents. An empty table gives an empty result.
* The order depends on doc_id (and size) alone, so reruns agree.
* Extra columns pass through ``mix``; helper names avoid theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.columns import hash52, unused
from rosterlake.session import StepTables

#: Of the sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
#: Rows in a block of the shuffled order of a source or of a range of finish times, on average.
BLOCK_ROWS = 1024

FIRST = Window.unboundedPreceding


def words_in(text: Column) -> Column:
    """The number of runs of characters other than space and 09-0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of a table of (source, size).

    One row per source. A source is cut to ``repeats`` times its size when the
    rest shared by weight would give it more; going through the sources by
    that ratio settles who is cut in one pass.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(FIRST, -1)
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = rest / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", share)
    # the share rises while sources are cut and is final at the first that isn't
    ratio = F.col("most") / F.col("weight")
    first_open = F.min(F.when(ratio > F.col("share"), F.struct(ratio.alias("ratio"), "share"))).over(Window.partitionBy())
    target = F.least(F.col("most"), F.col("weight") * first_open["share"])
    return per.select("source", "source_size", target.alias("target"))


def _queue(rows: DataFrame, targets: DataFrame, blocks: int) -> DataFrame:
    """Rows with the words of their source before them in the shuffled order."""
    order = ["h", "doc_id", "size", *(c for c in rows.columns if c == "row")]
    block = F.floor(F.col("h") / F.lit(2.0**52 / blocks)).cast("int")
    rows = rows.withColumn("h", hash52(F.lit("mix"), F.col("doc_id"))).withColumn("block", block)
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("block").rowsBetween(FIRST, -1)
    sums = sums.select("source", "block", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("before"))
    offsets = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(
        sums["source"].alias("s"), F.col("block").alias("b"), "before", "source_size", "target"
    )
    within = Window.partitionBy("source", "block").orderBy(*order).rowsBetween(FIRST, 0)
    return (
        rows.withColumn("up_to", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("start", F.col("before") + F.col("up_to") - F.col("size"))
        .drop("s", "b", "before", "up_to", "block", "h")
    )


def _finish(copy: Column) -> Column:
    """Virtual finish time of the entry of ``copy`` (0, 1, ...) of a document."""
    words = copy * F.col("source_size") + F.col("start") + F.col("size")
    return F.when((F.col("target") > 0) & (F.col("size") > 0), words / F.col("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, numbered: bool = False
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (array: words
    taken of each copy of the document) of a table of doc_id, source, size; if that is
    ``numbered``, also its column row, which tells equal rows apart."""
    spark = docs.sparkSession
    # three passes follow: the sizes are counted once and written
    number = ["row"] if numbered else []
    rows = StepTables(spark).write("sizes", docs.select("doc_id", "source", "size", *number))
    n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, n // BLOCK_ROWS)
    queued = _queue(rows, source_targets(rows, weights, repeats), blocks)
    copies = [F.lit(k).cast("long") for k in range(repeats)]
    entries = queued.select("source", "size", F.explode(F.array(*[_finish(c) for c in copies])).alias("finish"))
    entries = entries.where("finish is not null").withColumn("range", F.floor(F.col("finish") * blocks))
    # the range of finish times in which the budget ends, then the entry
    ranges = entries.groupBy("range").agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.orderBy("range").rowsBetween(FIRST, 0))
    last = ranges.withColumn("up_to", up_to).where(F.col("up_to") >= budget).orderBy("range").first()
    if last is None:  # no words at all
        nothing = F.array(*[F.lit(0).cast("long") for _ in copies])
        return queued.select(*number, "doc_id", "source", "size", "source_size", "target", nothing.alias("taken"))
    in_order = Window.orderBy("finish", F.col("source").asc_nulls_last()).rowsBetween(FIRST, 0)
    cut = (
        entries.where(F.col("range") == last["range"])
        .withColumn("up_to", F.lit(last["up_to"] - last["words"]) + F.sum("size").over(in_order))
        .where(F.col("up_to") >= budget)
        .orderBy("up_to", "finish")
        .first()
    )
    at = _place(F.lit(cut["finish"]), F.lit(cut["source"]).cast("string"))
    fits = cut["size"] - (cut["up_to"] - budget)

    def taken(copy: Column) -> Column:
        place = _place(_finish(copy), F.col("source"))
        whole = F.when(place < at, F.col("size")).when(place == at, F.lit(fits))
        return F.coalesce(F.when(_finish(copy).isNotNull(), whole), F.lit(0)).cast("long")

    return queued.select(
        *number, "doc_id", "source", "size", "source_size", "target", F.array(*[taken(c) for c in copies]).alias("taken")
    )


def _place(finish: Column, source: Column) -> Column:
    """Where an entry stands in the global order: two entries of a source never tie."""
    return F.struct(
        finish.alias("finish"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` once for each copy of which the mix takes any word.

    The document at the end of the budget is kept whole. Every row is a document of its own:
    the rows are numbered and written once, and joined by number.
    """
    row, size, copy = (unused(docs, c) for c in ("_row", "_size", "_copy"))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(size, words_in(F.col("text")))
    rows = StepTables(docs.sparkSession).write("rows", rows)
    mixed = mix(rows.select("doc_id", "source", F.col(size).alias("size"), F.col(row).alias("row")), numbered=True, **options)
    times = mixed.select(F.col("row").alias(row), F.size(F.filter("taken", lambda t: t > 0)).alias(copy)).where(F.col(copy) > 0)
    rows = rows.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return rows.select(*docs.columns)
