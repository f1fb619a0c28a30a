"""Following links from root pages: closure, ancestors, pagination, visit order.

All functions take ``links(src, dst, kind, pos)`` with kind ``next`` or
``child`` and run level by level as joins. Each level is written to the shared
scratch folder, so plans stay flat and a lost executor re-reads a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import is_http
from ..session import LinkSteps, StepTables


def usable_links(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """http links only; with ``pages`` also only those whose page was fetched."""
    out = links.where(is_http("dst")).select("src", "dst", "kind", F.col("pos").cast("bigint").alias("pos"))
    if pages is None:
        return out
    return out.join(pages.select(F.col("url").alias("dst")), "dst", "left_semi")


def _step_key() -> Column:
    """Orders the links of one page: next first, then children by position."""
    return F.struct(
        F.when(F.col("kind") == "next", 0).otherwise(1).alias("k"), F.col("pos").alias("p")
    )


def crawl_closure(
    roots: DataFrame, links: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """(root, url, depth, ancestors) for all pages that a root reaches.

    ``max_depth`` keeps pages within that many links; without it levels are added
    until one brings nothing new. The result holds each root with all its pages.

    A page gets its smallest depth. Among the paths of that length the first in
    page order (next before children, children by position) gives the ancestors.
    """
    steps = LinkSteps(roots.sparkSession)
    edges = steps.write("edges", links.select("src", "dst", _step_key().alias("_step")))
    frontier = steps.write(
        "level",
        roots.select(F.col("root"), F.col("root").alias("url"))
        .distinct()
        .select(
            "root",
            "url",
            F.lit(0).cast("bigint").alias("depth"),
            F.array().cast("array<string>").alias("ancestors"),
            F.array().cast("array<struct<k:int,p:bigint>>").alias("_path"),
        ),
    )
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(edges, F.col("url") == F.col("src")).select(
            "root",
            F.col("dst").alias("url"),
            F.struct(
                F.array_append("_path", F.col("_step")).alias("_path"),
                F.array_append("ancestors", F.col("src")).alias("ancestors"),
            ).alias("_via"),
        )
        level = (
            reached.groupBy("root", "url")
            .agg(F.min("_via").alias("_via"))
            .join(steps.union("level").select("root", "url"), ["root", "url"], "left_anti")
            .select(
                "root",
                "url",
                F.lit(depth).cast("bigint").alias("depth"),
                "_via.ancestors",
                "_via._path",
            )
        )
        frontier = steps.write("level", level)
        if frontier.isEmpty():
            break
    return steps.union("level").drop("_path")


def pagination_walk(
    starts: DataFrame, links: DataFrame, max_pages: int | None = None
) -> DataFrame:
    """(root, page_no, url): follow next links from every start page.

    A walk ends when there is no usable next page, when the next page was
    visited before, or at ``max_pages`` if a budget is given.
    A page with several next links follows the first by position.

    Every page has one successor, so walks double: knowing the pages up to n and
    where n steps lead from any page gives the pages up to 2n. A walk of n pages
    takes log2(n) rounds. Repeats of a cycle are dropped in each round, since from
    the first repeat on a walk holds nothing new. Start at heads of chains: a
    walk from every page of a chain of n pages has n * n / 2 rows.
    """
    steps = LinkSteps(starts.sparkSession)
    jump = (
        links.where(F.col("kind") == "next")
        .groupBy("src")
        .agg(F.min(F.struct("pos", "dst")).alias("_n"))
        .select("src", F.col("_n.dst").alias("dst"))
    )
    walks = starts.select(
        "root", F.col("root").alias("url"), F.lit(1).cast("bigint").alias("page_no")
    ).distinct()
    reach = 1
    walks = steps.write("walks", walks)
    while max_pages is None or reach < max_pages:
        jump = steps.write("jump", jump)
        further = (
            walks.join(jump, F.col("url") == F.col("src"))
            .select("root", F.col("dst").alias("url"), (F.col("page_no") + reach).alias("page_no"))
            .groupBy("root", "url")
            .agg(F.min("page_no").alias("page_no"))
            .join(walks.select("root", "url"), ["root", "url"], "left_anti")
        )
        further = steps.write("walks", further)
        if further.isEmpty():
            break
        walks = steps.union("walks")
        onward = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = jump.join(onward, "dst").select("src", F.col("far").alias("dst"))
        reach *= 2
    return walks if max_pages is None else walks.where(F.col("page_no") <= max_pages)


def frontier_pruned(
    links: DataFrame, page_records: DataFrame, roots: DataFrame, threshold: int
) -> DataFrame:
    """Drop all links of root pages that already gave ``threshold`` records.

    0 switches the rule off. ``page_records`` holds one row per record.
    """
    if threshold <= 0:
        return links
    full = (
        page_records.groupBy("url")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= threshold)
        .join(roots.select(F.col("root").alias("url")).distinct(), "url", "left_semi")
        .select(F.col("url").alias("src"))
    )
    return links.join(full, "src", "left_anti")


def _expansion_links(links: DataFrame, max_pages: int | None) -> DataFrame:
    """The links a walk of at most ``max_pages`` pages can ever need (None: all).

    Per page: its first next link; its first ``max_pages`` distinct children,
    since the pages already known and those still to be visited add up to no
    more than that; and every child that is a next page somewhere, since a
    queued child keeps a next link to it from jumping ahead.
    """
    nexts = (
        links.where(F.col("kind") == "next")
        .groupBy("src")
        .agg(F.min(F.struct("pos", "dst")).alias("_n"))
        .select("src", F.col("_n.dst").alias("dst"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("p"))
    )
    children = (
        links.where(F.col("kind") == "child")
        .groupBy("src", "dst")
        .agg(F.min("pos").alias("p"))
    )
    if max_pages is None:
        return nexts.unionByName(children.select("src", "dst", F.lit(1).alias("k"), "p"))
    by_place = W.partitionBy("src").orderBy("p", "dst")
    first = (
        children.withColumn("_rn", F.row_number().over(by_place))
        .where(F.col("_rn") <= max_pages)
        .select("src", "dst", F.lit(1).alias("k"), "p")
    )
    shadowing = children.join(
        nexts.select("dst").distinct(), "dst", "left_semi"
    ).select("src", "dst", F.lit(1).alias("k"), "p")
    return nexts.unionByName(first.unionByName(shadowing).distinct())


def crawl_order(
    roots: DataFrame, links: DataFrame, max_pages: int | None = None
) -> DataFrame:
    """(root, visit_no, url, depth, ancestors) in exact visiting order.

    From each root a next page is visited right after its page, children queue
    up behind everything queued before; every URL is queued once, by the page
    that offers it first; with a budget at most ``max_pages`` pages are visited.

    One round handles, for all roots at once, the queue up to and including the
    first page with a usable next link: until there the order is settled. So the
    number of rounds is that of levels plus next links followed. With a budget only
    the front of a queue, as far as it reaches, is ever ordered; that is a top n,
    cut before the shuffle, however long the queue is.
    """
    steps = StepTables(roots.sparkSession)
    edges = steps.write("edges", _expansion_links(links, max_pages))
    no_number = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    first_place = F.struct(
        zero.alias("round"), zero.alias("from"), zero.alias("pos"), F.lit("").alias("url")
    )
    state = steps.write(
        "state",
        roots.select("root").distinct().select(
            "root",
            F.col("root").alias("url"),
            F.array().cast("array<string>").alias("ancestors"),
            first_place.alias("place"),
            no_number.alias("visit_no"),
        ),
    )
    in_line = W.partitionBy("root").orderBy("place")
    is_next = F.col("o.k") == 0
    round_no = 0
    while max_pages is None or round_no < max_pages:
        round_no += 1
        visited = (
            state.where(F.col("visit_no").isNotNull())
            .groupBy("root")
            .agg(F.max("visit_no").alias("visited"))
        )
        front = (
            state.where(F.col("visit_no").isNull())
            .withColumn("rn", F.row_number().over(in_line))
            .where(F.lit(True) if max_pages is None else F.col("rn") <= max_pages)
        )
        ahead = (
            front.join(visited, "root", "left")
            .withColumn("visit_no", F.coalesce("visited", zero) + F.col("rn"))
            .where(F.lit(True) if max_pages is None else F.col("visit_no") <= max_pages)
            .select("root", "url", "ancestors", "visit_no")
        )
        ahead = steps.write("ahead", ahead)
        if ahead.isEmpty():
            break
        offers = (
            ahead.join(edges, F.col("url") == F.col("src"))
            .groupBy("root", "dst")
            .agg(F.min(F.struct("visit_no", "k", "p", "src", "ancestors")).alias("o"))
            .join(state.select("root", F.col("url").alias("dst")), ["root", "dst"], "left_anti")
        )
        offers = steps.write("offers", offers)
        cuts = offers.where(is_next).groupBy("root").agg(F.min("o.visit_no").alias("cut"))
        settled = (
            ahead.select("root", "url", F.col("visit_no").alias("_no"))
            .join(cuts, "root", "left")
            .where(F.col("cut").isNull() | (F.col("_no") <= F.col("cut")))
            .drop("cut")
        )
        added = (
            offers.join(cuts, "root", "left")
            .where(F.col("cut").isNull() | (F.col("o.visit_no") <= F.col("cut")))
            .select(
                "root",
                F.col("dst").alias("url"),
                F.array_append("o.ancestors", F.col("o.src")).alias("ancestors"),
                F.struct(
                    # a next page goes in front of everything, children behind
                    F.when(is_next, -1).otherwise(round_no).cast("bigint").alias("round"),
                    F.col("o.visit_no").alias("from"),
                    F.col("o.p").alias("pos"),
                    F.col("dst").alias("url"),
                ).alias("place"),
                no_number.alias("visit_no"),
            )
        )
        numbered = state.join(settled, ["root", "url"], "left").select(
            "root", "url", "ancestors", "place", F.coalesce("visit_no", "_no").alias("visit_no")
        )
        state = steps.write("state", numbered.unionByName(added))
    return state.where(F.col("visit_no").isNotNull()).select(
        "root",
        "visit_no",
        "url",
        F.size("ancestors").cast("bigint").alias("depth"),
        "ancestors",
    )
