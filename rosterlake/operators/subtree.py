"""Which pages have nothing changed below them, at any depth.

A page is up to date if no page that it reaches by links has changed, itself included.
That is asked from the changed pages upwards: they are marked, then the pages linking to
them, then those linking to these. Every page is marked once, whatever the number of
targets above it, cycles end by themselves, and the work grows with what has changed
and the pages above it. No set of pages below a page is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import StepTables


def changed_below(changes: DataFrame, links: DataFrame) -> DataFrame:
    """(url, status, links_to_change, can_skip) of every page of ``changes(url, status)``.

    ``links_to_change`` is the fewest links to a changed page: 0 for the page itself,
    NULL if none is reached, and then the page may be skipped. ``links`` holds (src, dst).
    Any status but ``unchanged`` counts as changed, NULL too, and so does a linked page
    that ``changes`` doesn't hold. Links without a source or a target count for nothing.

    It takes a round for each link of the greatest distance. ``changes`` is read three
    times: pass a written table rather than a plan over html.
    """
    steps = StepTables(changes.sparkSession)
    edges = links.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    edges = steps.write("edges", edges.distinct())
    known = changes.select("url")
    changed = changes.where(~F.col("status").eqNullSafe("unchanged")).select("url")
    missing = edges.select(F.col("dst").alias("url")).join(known, "url", "left_anti")
    distance = 0
    level = steps.write("marked", _at(changed.union(missing).distinct(), distance))
    while not level.isEmpty():
        distance += 1
        above = edges.join(level, F.col("dst") == F.col("url")).select(F.col("src").alias("url")).distinct()
        level = steps.write("marked", _at(above.join(steps.union("marked"), "url", "left_anti"), distance))
    return changes.join(steps.union("marked"), "url", "left").select(
        "url", "status", "links_to_change", F.col("links_to_change").isNull().alias("can_skip")
    )


def _at(urls: DataFrame, distance: int) -> DataFrame:
    return urls.select("url", F.lit(distance).cast("bigint").alias("links_to_change"))
