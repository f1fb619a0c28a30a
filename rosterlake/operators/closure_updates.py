"""Keeping a closure up between runs, from the links that changed.

``closure(root, url, depth)`` holds the pages that roots reach and the fewest links to
each. When links come and go, only what they touch is worked out again:

1. A page loses its depth when no page one level up that kept its own still links to it.
   Candidates are the targets of links that are gone, then the pages below those lost,
   level by level.
2. Lost pages, and targets of new links, are offered a depth by the pages that kept theirs.
   Better depths spread from page to page until nothing improves.

Only the closures of roots that reach a changed link are read, once, and every round joins
what changed in the round before. The number of rounds is that of the levels that change.
Steps are counted: small ones go to the pages that they touch, large ones are joined by sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LinkSteps

LINK = ["src", "dst", "kind", "pos"]


def links_after(links: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The links once ``removed`` rows are gone and ``added`` ones are there."""
    same = None
    gone = removed.select(*[F.col(c).alias(f"_{c}") for c in LINK])
    for c in LINK:
        equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = equal if same is None else same & equal
    return links.select(*LINK).join(gone, same, "left_anti").unionByName(added.select(*LINK))


def closure_changes(
    closure: DataFrame, links: DataFrame, added: DataFrame, removed: DataFrame
) -> DataFrame:
    """(root, url, depth_before, depth) of the pages whose depth changes.

    ``links`` are those that the closure was made from. ``depth_before`` is NULL for
    a page that is new to its root, ``depth`` for one that it no longer reaches.
    """
    steps = LinkSteps(closure.sparkSession)
    links = steps.write("links", links.select(*LINK))
    added = steps.write("links_added", added.select(*LINK))
    removed = steps.write("links_removed", removed.select(*LINK))
    after = steps.write("either", links_after(links, added, removed).select("src", "dst").distinct())
    # a link may be given twice, as next and as child: it is gone when no row is left
    pairs = removed.select("src", "dst").distinct()
    gone = steps.write("either", pairs.join(after, ["src", "dst"], "left_anti"))
    new = steps.write("new", added.select("src", "dst").distinct())
    either = steps.union("either")

    sources = steps.write("sources", gone.select("src").union(new.select("src")).distinct().withColumnRenamed("src", "url"))
    roots = steps.write("roots", closure.join(sources, "url", "left_semi").select("root").distinct())
    held = steps.write("held", closure.join(roots, "root", "left_semi").select("root", "url", "depth"))

    below = held.select("root", F.col("url").alias("dst"), (F.col("depth") - 1).alias("depth"))

    def targets(pages: DataFrame, edges: DataFrame) -> DataFrame:
        """Pages that hang on ``pages``: one level further down by one of ``edges``."""
        linked = pages.join(edges, F.col("url") == F.col("src")).select("root", "dst", "depth")
        found = linked.join(below, ["root", "dst", "depth"]).distinct()
        return found.select("root", F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))

    none = held.where("false")
    lost = steps.write("lost", none)
    pending = steps.write("pending", targets(held, gone))
    while (level := pending.agg(F.min("depth")).first()[0]) is not None:
        now = pending.where(F.col("depth") == level)
        parents = now.select("root", F.col("url").alias("dst")).join(after, "dst").select("root", "dst", F.col("src").alias("url"))
        above = held.where(F.col("depth") == level - 1).select("root", "url")
        kept = parents.join(above, ["root", "url"], "left_semi").join(lost.select("root", "url"), ["root", "url"], "left_anti")
        supported = kept.select("root", F.col("dst").alias("url"))
        now = steps.write("lost", now.join(supported, ["root", "url"], "left_anti"))
        lost = steps.union("lost")
        further = pending.where(F.col("depth") > level).unionByName(targets(now, either)).distinct()
        pending = steps.write("pending", further)

    kept = steps.write("kept", held.join(lost.select("root", "url"), ["root", "url"], "left_anti"))
    into_lost = lost.select("root", F.col("url").alias("dst")).join(after, "dst")
    into_lost = into_lost.withColumnRenamed("src", "url").join(kept, ["root", "url"])
    by_new = kept.join(new, F.col("url") == F.col("src"))
    offers = into_lost.select("root", "dst", "depth").unionByName(by_new.select("root", "dst", "depth"))
    better = steps.write("better", none)
    while True:
        offers = offers.groupBy("root", F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        offers = steps.write("offers", offers)
        asked = offers.select("root", "url")  # only pages that are offered a depth are looked up
        known = [pages.join(asked, ["root", "url"], "left_semi") for pages in (kept, better)]
        so_far = known[0].unionByName(known[1]).groupBy("root", "url").agg(F.min("depth").alias("so_far"))
        gains = offers.join(so_far, ["root", "url"], "left").where("so_far is null or depth < so_far").drop("so_far")
        before = steps.rows["better"]
        gains = steps.write("better", gains)
        if steps.rows["better"] == before:
            break
        better = steps.union("better")
        offers = gains.join(after, F.col("url") == F.col("src")).select("root", "dst", "depth")

    now = better.groupBy("root", "url").agg(F.min("depth").alias("depth"))
    touched = lost.select("root", "url").union(now.select("root", "url")).distinct()
    was = held.withColumnRenamed("depth", "depth_before")
    found = touched.join(was, ["root", "url"], "left").join(now, ["root", "url"], "left")
    return found.where(~F.col("depth_before").eqNullSafe(F.col("depth"))).select("root", "url", "depth_before", "depth")


def updated_closure(closure: DataFrame, changes: DataFrame) -> DataFrame:
    """The closure with the changes applied."""
    same = closure.select("root", "url", "depth").join(changes.select("root", "url"), ["root", "url"], "left_anti")
    return same.unionByName(changes.where("depth is not null").select("root", "url", "depth"))
