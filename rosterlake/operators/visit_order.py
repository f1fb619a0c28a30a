"""The order in which all pages of a root are visited, however many there are.

``links(src, dst, kind, pos)`` as in ``traversal``. Pages wait in a queue: a next page
is visited right after its page, children queue up at the end, and a page is queued
once. So a visit is a row of runs, each a queued page with the next links that it
leads to, and a round settles all runs of the queue at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import StepTables

#: monotonically_increasing_id counts within a partition in so many low bits
_ID_BITS = 33


def _first_links(links: DataFrame, kind: str) -> DataFrame:
    """(src, dst, pos): the next link of each page, or its children, each once."""
    own = links.where(F.col("kind") == kind)
    if kind == "child":
        return own.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return own.groupBy("src").agg(F.min(F.struct("pos", "dst")).alias("_n")).select("src", "_n.dst", "_n.pos")


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rising numbers in the given order; sorted in ranges, so no task holds a whole root."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        name, F.monotonically_increasing_id()
    )


class _Jumps:
    """Where 1, 2, 4, ... next links lead from a page, each made when first asked for."""

    def __init__(self, steps: StepTables, links: DataFrame) -> None:
        self._steps = steps
        self._made = [steps.write("jump", _first_links(links, "next").select("src", "dst"))]

    def __getitem__(self, power: int) -> DataFrame:
        while len(self._made) <= power:
            half = self._made[-1]
            onward = half.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
            twice = half.join(onward, "dst").select("src", F.col("far").alias("dst"))
            self._made.append(self._steps.write("jump", twice))
        return self._made[power]


def _runs(steps: StepTables, starts: DataFrame, known: DataFrame, jumps: _Jumps) -> DataFrame:
    """(root, run, step, url): the next links followed from each start, by doubling.

    A run ends before a known page, before a page of an earlier run and before one of its
    own. Where runs meet they go the same way from there on, so the page belongs to
    the earliest of them; a later one that came by first is cut there. A run of n
    pages takes log2(n) rounds, and every page stands in about one run at a time.
    """
    place = F.struct("run", "step")
    first = starts.select("root", "run", F.lit(0).cast("bigint").alias("step"), "url")
    name = f"followed{id(starts)}"
    known = known.select("root", "url", F.lit(True).alias("known"))
    alive, ends, power = first, None, 0
    while True:
        onward = alive.join(jumps[power], F.col("url") == F.col("src")).select(
            "root", "run", (F.col("step") + 2**power).alias("step"), F.col("dst").alias("url")
        )
        onward = steps.write(f"{name}-onward", onward.join(known, ["root", "url"], "left"))
        if onward.isEmpty():
            break
        stops = onward.where("known").groupBy("run").agg(F.min("step").alias("stop"))
        free = onward.join(stops, "run", "left").where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
        free = steps.write(name, free.select("root", "run", "step", "url"))
        followed = steps.union(name)
        owners = followed.groupBy("root", "url").agg(F.min(place).alias("_owner"))
        cut = followed.join(owners, ["root", "url"]).where(place != F.col("_owner"))
        ends = cut.groupBy("run").agg(F.min("step").alias("end"))
        whole = free.where(F.col("step") == 2 ** (power + 1) - 1).select("run").join(ends, "run", "left_anti")
        alive = steps.write(f"{name}-alive", alive.unionByName(free).join(whole, "run", "left_semi").select(*first.columns))
        power += 1
    if ends is None:
        return first
    kept = steps.union(name).join(ends, "run", "left").where(F.col("end").isNull() | (F.col("step") < F.col("end")))
    return first.unionByName(kept.select(*first.columns))


def visit_order(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(root, visit_no, url, depth, parent) of all pages that a root reaches.

    From each root a next page (the first by position) is visited right after its page,
    children queue up behind everything queued before; every URL is queued once, by the
    page that offers it first, its ``parent``. ``depth`` counts the links from the root.
    Roots that are NULL and links without source or target lead nowhere.

    A round takes the whole queue of all roots and follows its runs as if no child
    of theirs stood in the way. What comes before the first next link to a page that
    had been queued as a child meanwhile is settled; the others go on in the next round. So
    rounds count levels of children and such links, not next links: a chain of n pages is
    one run, followed in log2(n) steps.
    """
    steps = StepTables(roots.sparkSession)
    links = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    jumps = _Jumps(steps, links)
    children = steps.write("children", _first_links(links, "child"))
    zero = F.lit(0).cast("bigint")
    queue = roots.select("root").where(F.col("root").isNotNull()).distinct().select(
        "root",
        F.col("root").alias("url"),
        F.lit(None).cast("string").alias("parent"),
        zero.alias("depth"),
        *(zero.alias(c) for c in ("queued_in", "from_run", "from_step", "pos")),
    )
    queue = steps.write("added", queue)
    known = queue.select("root", "url")
    place = F.struct("run", "step")
    round_no = 0
    while True:
        round_no += 1
        starts = _numbered(queue, "run", "root", "queued_in", "from_run", "from_step", "pos", "url")
        starts = steps.write("starts", starts)
        if starts.isEmpty():
            break
        pages = steps.write("pages", _runs(steps, starts, known, jumps))
        offers = (
            pages.join(children, F.col("url") == F.col("src"))
            .groupBy("root", "dst")
            .agg(F.min(F.struct("run", "step", F.col("pos"), F.col("src").alias("parent"))).alias("_o"))
            .join(known.withColumnRenamed("url", "dst"), ["root", "dst"], "left_anti")
        )
        offers = steps.write("offers", offers.select("root", F.col("dst").alias("url"), "_o"))
        offered_by = F.struct(F.col("_o.run").alias("run"), F.col("_o.step").alias("step"))
        before = F.struct(F.col("run").alias("run"), (F.col("step") - 1).alias("step"))
        held_back = (
            pages.where(F.col("step") > 0)
            .join(offers, ["root", "url"])
            .where(offered_by < before)
            .groupBy("root")
            .agg(F.min(place).alias("_stop"))
        )
        reached = pages.join(held_back, "root", "left").where(F.col("_stop").isNull() | (place < F.col("_stop")))
        origin = starts.select("run", "parent", "depth")
        previous = pages.select("run", (F.col("step") + 1).alias("step"), F.col("url").alias("_previous"))
        settled = (
            reached.join(origin, "run")
            .join(previous, ["run", "step"], "left")
            .select(
                "root",
                F.lit(round_no).cast("bigint").alias("round"),
                "run",
                "step",
                "url",
                (F.col("depth") + F.col("step")).alias("depth"),
                F.coalesce("_previous", "parent").alias("parent"),
            )
        )
        settled = steps.write("settled", settled)
        at = settled.select(
            F.col("run").alias("from_run"), F.col("step").alias("from_step"), F.col("depth").alias("_above")
        )
        added = (
            offers.join(settled.select("root", "url"), ["root", "url"], "left_anti")
            .join(at, (F.col("_o.run") == F.col("from_run")) & (F.col("_o.step") == F.col("from_step")))
            .select(
                "root",
                "url",
                "_o.parent",
                (F.col("_above") + 1).alias("depth"),
                F.lit(round_no).cast("bigint").alias("queued_in"),
                "from_run",
                "from_step",
                "_o.pos",
            )
        )
        added = steps.write("added", added)
        visited = steps.union("settled").where(F.col("step") > 0)
        known = visited.select("root", "url").unionByName(steps.union("added").select("root", "url"))
        waiting = starts.join(settled.where(F.col("step") == 0).select("run"), "run", "left_anti").drop("run")
        queue = waiting.unionByName(added)
    if round_no == 1:
        return queue.select("root", F.col("pos").alias("visit_no"), "url", "depth", "parent")
    return _with_visit_numbers(steps, steps.union("settled"))


def _with_visit_numbers(steps: StepTables, settled: DataFrame) -> DataFrame:
    """Gapless numbers per root: sorted in ranges, with the counts of the ranges before."""
    in_order = steps.write("in_order", _numbered(settled, "_id", "root", "round", "run", "step"))
    ranges = in_order.groupBy("root", F.shiftright("_id", _ID_BITS).alias("_range")).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    earlier = W.partitionBy("root").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (
        in_order.withColumn("_range", F.shiftright("_id", _ID_BITS))
        .join(ranges, ["root", "_range"])
        .select("root", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("visit_no"), "url", "depth", "parent")
    )
