"""How run time grows with the data, and with one key holding a third of it.

    python -m checks.growth pages 1 10 50      # page operators on replicated pages
    python -m checks.growth skew 3000000       # keyed operators on rows with a hot key

Replicas get their own URLs, so that every page is work of its own. Scratch data
goes to a new folder each time and is left there.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import functions as F

from rosterlake.operators import dedup, enrichment, lifecycle, links, pages, targets
from rosterlake.operators.listing import listing_rows
from rosterlake.session import local_session
from rosterlake.sinks.tables import merge_by_source_key
from rosterlake.sources.snapshots import latest_pages

from .fixtures import SPEC
from .scratch import with_scratch

SF = "/root/testdata/sf0.1"


def timed(name: str, df) -> None:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    print(f"{name:28s} {time.perf_counter() - start:7.2f} s", flush=True)


def page_growth(factors: list[int]) -> None:
    spark = with_scratch(local_session(8))
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    base = spark.read.parquet(f"{SF}/pages.parquet")
    for n in factors:
        path = f"{root}/x{n}"
        copies = spark.range(n).withColumnRenamed("id", "copy").hint("broadcast")
        base.repartition(8).join(copies).withColumn(
            "url", F.concat("url", F.lit("&c="), F.col("copy"))
        ).write.parquet(path)
        df = spark.read.parquet(path)
        two = df.withColumn("run_no", F.lit(1)).unionByName(df.withColumn("run_no", F.lit(2)))
        print(f"pages x{n}: {df.count()} rows")
        timed("page_fingerprint", pages.fingerprint_snapshots(two))
        timed("page_changes", pages.changes_between(two, 2))
        timed("pages_clean", pages.clean_pages(df))
        timed("page_flags", pages.page_flags(df))
        timed("page_links", links.page_links(df))
        timed("listing_rows", listing_rows(df))
        timed("pages_latest", latest_pages(two))


def skewed_keys(rows: int) -> None:
    spark = with_scratch(local_session(8))
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % (rows // 10))
    for label, key in (("even", F.col("id") % (rows // 10)), ("one key holds a third", hot)):
        k = key.cast("string")
        df = spark.range(rows).select(
            F.col("id").alias("ord"),
            F.col("id").alias("seq"),
            F.lit("U").alias("university"),
            k.alias("department"),
            F.concat(k, F.lit("/U")).alias("_source_key"),
            F.concat(F.lit("u"), k, F.lit("@x.edu")).alias("email"),
            F.when(F.col("id") % 2 == 0, F.lit("Dr.")).alias("title"),
            F.concat(F.lit("https://p/"), k).alias("profile_url"),
            F.concat(F.lit("https://p/"), k).alias("url"),
            F.lit("completed").alias("status"),
            F.lit("https://l").alias("link"),
            F.concat(F.lit("name "), F.col("id")).alias("full_name"),
            F.lit(None).cast("string").alias("remark"),
            F.col("id").alias("run_no"),
            (F.col("id") % 50).alias("rec_run"),
            F.lit("<p>page</p>").alias("html"),
        )
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        df.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        detail = df.select(
            "profile_url", F.lit(False).alias("blocked"), F.lit(False).alias("failed"), F.lit("e").alias("title")
        ).dropDuplicates(["profile_url"])
        keys = df.select("_source_key").where(F.col("ord") % 7 == 0)
        sight = df.select(F.col("rec_run").alias("run_no"), "university", "department", F.col("ord").alias("rec_key"))
        print(f"{rows} rows, {label}")
        timed("merge_duplicates", dedup.merge_duplicates(df.drop("run_no", "rec_run", "html"), SPEC))
        timed("latest_pages", latest_pages(df.select("url", "run_no", "html")))
        timed("apply_status", targets.apply_status(df, df.select("university", "department", "status", "link", "seq")))
        timed("enrich_records", enrichment.enrich_records(df, detail, SPEC, remark="remark"))
        timed("merge_by_source_key", merge_by_source_key(df, keys, df.limit(0)))
        timed("lifecycle_history", lifecycle.lifecycle_history(sight))


def main() -> None:
    what, numbers = sys.argv[1], [int(a) for a in sys.argv[2:]]
    if what == "pages":
        page_growth(numbers or [1, 10, 50])
    else:
        skewed_keys(numbers[0] if numbers else 3_000_000)


if __name__ == "__main__":
    main()
