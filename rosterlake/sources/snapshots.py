"""Page snapshots: newest content, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page table; ``spark.sql.files.maxPartitionBytes`` sets the size of its splits."""
    return spark.read.format(fmt).load(path)


def latest_pages(
    snapshots: DataFrame, order: str = "run_no", key: str = "url"
) -> DataFrame:
    """The row with the highest ``order`` per URL.

    The maximum is taken map-side first, so a URL with very many snapshots
    sends one row per task. Ties are broken by the other columns, in order.
    """
    rest = [c for c in snapshots.columns if c not in (key, order)]
    newest = F.max(F.struct(order, *rest)).alias("_newest")
    return snapshots.groupBy(key).agg(newest).select(key, "_newest.*")


def save_by_url(pages: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Save pages bucketed by URL.

    Page rows are wide. Tables saved this way with the same number of buckets
    join and group by URL without moving the html over the network again.
    """
    writer = pages.repartition(buckets, "url").write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "url").sortBy("url").saveAsTable(table)


def live_entries(
    entries: DataFrame, as_of: Column, stored_at: str = "stored_at", ttl: str = "ttl_sec"
) -> DataFrame:
    """Entries that have not expired at ``as_of``; a NULL ttl never expires."""
    age = F.unix_micros(as_of) - F.unix_micros(stored_at)
    return entries.where(
        F.col(ttl).isNull() | (age < F.col(ttl) * F.lit(1_000_000))
    )
