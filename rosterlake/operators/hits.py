"""Search hits: top n, combined lists, the best listing page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U


def top_hits(hits: DataFrame, n: int, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first ``n`` hits of every query (the limit is the feature)."""
    place = W.partitionBy(query).orderBy(rank, "url")
    return hits.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= n).drop("_rn")


def combine_hits(hits: DataFrame, target: list[str], query: str = "query_no", rank: str = "rank") -> DataFrame:
    """Hits of all queries of a target, each URL once at its first place."""
    return (
        hits.where(F.coalesce("url", F.lit("")) != "")
        .groupBy(*target, "url")
        .agg(F.min(F.struct(query, rank)).alias("_first"))
        .select(*target, "url", F.col(f"_first.{query}").alias(query), F.col(f"_first.{rank}").alias(rank))
    )


def best_listing_url(hits: DataFrame, target: list[str], domain: str, department: str) -> DataFrame:
    """Best listing page per target; targets without a usable hit have no row.

    The highest score wins, then the earlier hit, then the URL; taken as one
    minimum per target, so the hits of a target are reduced before the shuffle.
    """
    scored = hits.withColumn(
        "score", U.listing_score("url", F.col(domain), F.col(department)).cast("bigint")
    )
    place = F.struct((-F.col("score")).alias("neg"), "rank", "url")
    # not a filter before the aggregate: pushed down, it would score every hit twice
    best = F.min(F.when(F.col("score") > 0, place)).alias("_best")
    return (
        scored.groupBy(*target)
        .agg(best)
        .where(F.col("_best").isNotNull())
        .select(*target, F.col("_best.url").alias("listing_url"), (-F.col("_best.neg")).alias("score"))
    )
