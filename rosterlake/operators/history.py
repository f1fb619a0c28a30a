"""Records as of any run, from the intervals in which their states held.

A record is ``active`` from a run that saw it to the next run of its scope that did not,
then ``not_found``, and ``archived`` once ``archive_after`` runs of its scope in a row
missed it; the next sighting starts a new life. Each of these is one interval of runs, from
a sighting on, so a history has no rows for the runs that missed a record.

Intervals meet the runs asked for in a join on equal keys: an interval is cut into blocks
of 1, 2, 4, ... runs that start at a multiple of their length, at most two of each length,
and a run lies in one block of each length. So it meets each interval that holds it once, and neither
side has a row for every run of an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = ("university", "department")


def state_intervals(sightings: DataFrame, archive_after: int) -> DataFrame:
    """(university, department, rec_key, status, first_run, last_run, from_run, to_run).

    ``sightings(run_no, university, department, rec_key)``; a scope was scraped in the
    runs that have a sighting of it. A state holds from ``from_run`` until before
    ``to_run``, which is NULL if it still does. ``first_run`` starts the life and
    ``last_run`` is the last sighting.
    """
    if archive_after < 1:
        raise ValueError("archive_after counts missed runs, from 1 on")
    seen = sightings.select("run_no", *SCOPE, "rec_key").distinct()
    in_scope = W.partitionBy(*SCOPE).orderBy("run_no")  # the runs of a scope, not its records
    runs = seen.select(*SCOPE, "run_no").distinct().select(
        *[F.col(c).alias(f"_{c}") for c in SCOPE],
        F.col("run_no").alias("_run"),
        F.row_number().over(in_scope).alias("place"),
        F.lead("run_no").over(in_scope).alias("missed_in"),
        F.lead("run_no", archive_after).over(in_scope).alias("archived_in"),
    )
    same = F.col("run_no") == F.col("_run")
    for c in SCOPE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = W.partitionBy(*SCOPE, "rec_key").orderBy("run_no")
    gap = F.col("place") - F.lag("place").over(own) - 1
    new_life = F.coalesce(gap >= archive_after, F.lit(True))
    placed = seen.join(runs, same).select(
        *SCOPE,
        "rec_key",
        "run_no",
        "missed_in",
        "archived_in",
        F.lead("run_no").over(own).alias("again"),
        F.when(new_life, F.col("run_no")).alias("start"),
    )
    placed = placed.withColumn("first_run", F.max("start").over(own.rowsBetween(W.unboundedPreceding, 0)))

    def state(name: str, since: str, until: str | None):
        to = F.least("again", until) if until else F.col("again")  # least passes over NULL
        return F.struct(F.lit(name).alias("status"), F.col(since).alias("from_run"), to.alias("to_run"))

    states = F.array(
        state("active", "run_no", "missed_in"),
        state("not_found", "missed_in", "archived_in"),
        state("archived", "archived_in", None),
    )
    each = placed.select(*SCOPE, "rec_key", "first_run", F.col("run_no").alias("last_run"), F.explode(states).alias("s"))
    held = each.select(*SCOPE, "rec_key", "s.status", "first_run", "last_run", "s.from_run", "s.to_run")
    return held.where("from_run is not null and (to_run is null or from_run < to_run)")


def as_of(intervals: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``intervals`` that hold in each run of ``runs(run_no)``, with its number.

    Runs after the last change see the last states, runs before the first none.
    """
    low, high = intervals.agg(F.min("from_run"), F.greatest(F.max("from_run"), F.max("to_run"))).first()
    low, high = low or 0, high or 0
    levels = (high - low + 1).bit_length()
    end = 1 << levels  # beyond every run that changes anything
    start = F.col("from_run") - low
    to = F.coalesce(F.col("to_run") - low, F.lit(end).cast("bigint"))

    def length(level):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)

    def blocks(level):
        size = length(level)
        a, b = F.floor((start + size - 1) / size), F.floor(to / size)
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("block")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    every = F.sequence(F.lit(0), F.lit(levels))
    cut = intervals.withColumn("_b", F.explode(F.flatten(F.transform(every, blocks))))
    asked = runs.select("run_no").where(F.col("run_no") >= low).distinct()
    place = F.least(F.col("run_no") - low, F.lit(end - 1).cast("bigint"))
    of = F.transform(every, lambda level: F.struct(level.alias("level"), F.floor(place / length(level)).alias("block")))
    asked = asked.select("run_no", F.explode(of).alias("_b"))
    return cut.join(asked, "_b").drop("_b")
