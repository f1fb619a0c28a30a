"""Stored records over runs: seen, missing, archived, returned; jobs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..spec import RecordSpec

SCOPE = ("university", "department")
STORED = (
    "record_id", "university", "department", "first_seen", "last_seen",
    "status", "runs_not_found", "data", "profile_url",
)


def merge_run(
    stored: DataFrame, seen: DataFrame, scopes: DataFrame, as_of: Column, order: str = "ord"
) -> DataFrame:
    """Stored records after one run.

    Seen records are active with no misses; a known one keeps first_seen and,
    when the new profile link is NULL, its old one. Records of a scraped scope
    that were not seen are not_found with one more miss, and last_seen moves to
    the run. Records of other scopes stay as they are.
    """
    latest = (
        seen.groupBy("record_id")
        .agg(F.max(F.struct(order, *SCOPE, "data", "profile_url")).alias("_r"))
        .select("record_id", F.col("_r").alias("r"))
    )
    scraped = scopes.select(*SCOPE).distinct().withColumn("_scraped", F.lit(True))
    known = (
        stored.alias("k")
        .join(
            scraped.alias("s"),
            F.col("k.university").eqNullSafe(F.col("s.university"))
            & F.col("k.department").eqNullSafe(F.col("s.department")),
            "left",
        )
        .select(
            "k.record_id",
            F.struct(*[F.col(f"k.{c}").alias(c) for c in STORED]).alias("o"),
            F.coalesce("s._scraped", F.lit(False)).alias("scraped"),
        )
    )
    j = known.join(latest, "record_id", "full_outer")
    is_seen, is_known = F.col("r").isNotNull(), F.col("o").isNotNull()
    missed = ~is_seen & F.coalesce("scraped", F.lit(False))
    ts = as_of.cast("timestamp")
    return j.select(
        "record_id",
        F.when(is_known, F.col("o.university")).otherwise(F.col("r.university")).alias("university"),
        F.when(is_known, F.col("o.department")).otherwise(F.col("r.department")).alias("department"),
        F.when(is_known, F.col("o.first_seen")).otherwise(ts).alias("first_seen"),
        F.when(is_seen | missed, ts).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(is_seen, "active").when(missed, "not_found").otherwise(F.col("o.status")).alias("status"),
        F.when(is_seen, F.lit(0).cast("bigint"))
        .when(missed, F.col("o.runs_not_found") + 1)
        .otherwise(F.col("o.runs_not_found"))
        .alias("runs_not_found"),
        F.when(is_seen, F.col("r.data")).otherwise(F.col("o.data")).alias("data"),
        F.coalesce("r.profile_url", "o.profile_url").alias("profile_url"),
    )


def _to_archive(threshold: int) -> Column:
    return (F.col("status") == "not_found") & (F.col("runs_not_found") >= threshold)


def live_after_archive(stored: DataFrame, threshold: int) -> DataFrame:
    return stored.where(~F.coalesce(_to_archive(threshold), F.lit(False)))


def archive_missing(
    stored: DataFrame, archive: DataFrame, threshold: int, as_of: Column
) -> DataFrame:
    """The archive after moving records missed ``threshold`` times into it.

    An id that is archived again updates data, last_seen and archived_at and
    keeps its first first_seen.
    """
    moved = stored.where(_to_archive(threshold)).select(
        "record_id", F.struct(*SCOPE, "first_seen", "last_seen", "data").alias("n")
    )
    old = archive.select(
        "record_id",
        F.struct(*SCOPE, "first_seen", "last_seen", "data", "archived_at").alias("o"),
    )
    j = old.join(moved, "record_id", "full_outer")
    known, moving = F.col("o").isNotNull(), F.col("n").isNotNull()
    return j.select(
        "record_id",
        *[
            F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
            for c in (*SCOPE, "first_seen")
        ],
        *[
            F.when(moving, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in ("last_seen", "data")
        ],
        F.when(moving, as_of.cast("timestamp")).otherwise(F.col("o.archived_at")).alias("archived_at"),
    )


def active_records(
    stored: DataFrame, university: str | None = None, department: str | None = None
) -> DataFrame:
    out = stored.where(F.col("status") == "active")
    if university is not None:
        out = out.where(F.col("university") == university)
    if department is not None:
        out = out.where(F.col("department") == department)
    return out


def lifecycle_history(sightings: DataFrame, archive_after: int | None = None) -> DataFrame:
    """Last state of every record over many runs, without a loop over runs.

    ``sightings(run_no, university, department, rec_key)``. A scope counts as
    scraped in a run when it has any sighting there, so other runs are no
    misses. Work grows with the sightings, not with records times runs: misses
    are differences between the places of runs within their scope. A gap of
    ``archive_after`` misses or more ends a life; the next sighting starts anew.
    """
    s = _placed_sightings(sightings)
    new_life = F.col("_gap").isNull()
    if archive_after is not None:
        new_life = new_life | (F.col("_gap") >= archive_after)
    lives = s.withColumn("_start", F.when(new_life, F.col("run_no")))
    by_record = lives.groupBy(*SCOPE, "rec_key").agg(
        F.max("_start").alias("first_run"),
        F.max("run_no").alias("last_run"),
        F.count("*").alias("n_runs_seen"),
        F.count("_start").alias("n_lives"),
        F.count_if(F.col("_gap") > 0).alias("n_returns"),
        (F.max("_last_place") - F.max("_place")).alias("misses"),
    )
    status = F.when(F.col("misses") == 0, "active")
    if archive_after is not None:
        status = status.when(F.col("misses") >= archive_after, "archived")
    return by_record.withColumn("status", status.otherwise("not_found"))


def lifecycle_run_counts(sightings: DataFrame) -> DataFrame:
    """(run_no, arrivals, returns, departures, seen) over all scopes.

    A departure counts in the first run of its scope that misses the record.
    """
    s = _placed_sightings(sightings, with_next_run=True)
    here = s.groupBy("run_no").agg(
        F.count_if(F.col("_gap").isNull()).alias("arrivals"),
        F.count_if(F.col("_gap") > 0).alias("returns"),
        F.count("*").alias("seen"),
    )
    left = (
        s.where(F.col("_left_in").isNotNull())
        .groupBy(F.col("_left_in").alias("run_no"))
        .agg(F.count("*").alias("departures"))
    )
    none = F.lit(0).cast("bigint")
    return here.join(left, "run_no", "left").select(
        "run_no", "arrivals", "returns", F.coalesce("departures", none).alias("departures"), "seen"
    )


def _placed_sightings(sightings: DataFrame, with_next_run: bool = False) -> DataFrame:
    """Distinct sightings with the place of their run within the scope's runs.

    The windows run over one scope's runs and one record's runs, both bounded by
    the number of runs, never over a whole scope's records.
    """
    seen = sightings.select("run_no", *SCOPE, "rec_key").distinct()
    runs = seen.select("run_no", *SCOPE).distinct()
    scope_runs = W.partitionBy(*SCOPE).orderBy("run_no")
    whole_scope = W.partitionBy(*SCOPE)
    places = runs.select(
        "run_no",
        *SCOPE,
        F.row_number().over(scope_runs).cast("bigint").alias("_place"),
        F.count("*").over(whole_scope).alias("_last_place"),
        F.lead("run_no").over(scope_runs).alias("_next_scope_run"),
    )
    on = [F.col("a.run_no") == F.col("p.run_no")] + [
        F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in SCOPE
    ]
    joined = (
        seen.alias("a")
        .join(places.alias("p"), on)
        .select("a.*", "p._place", "p._last_place", "p._next_scope_run")
    )
    own = W.partitionBy(*SCOPE, "rec_key").orderBy("run_no")
    out = joined.withColumn("_gap", F.col("_place") - F.lag("_place").over(own) - 1)
    if with_next_run:
        next_place = F.lead("_place").over(own)
        stays = F.coalesce(next_place == F.col("_place") + 1, F.lit(False))
        out = out.withColumn("_left_in", F.when(~stays, F.col("_next_scope_run")))
    return out


def job_state(events: DataFrame, order: str = "seq", at: str = "ts") -> DataFrame:
    """Last state per job from its events.

    Status and error are those of the last event, the link the last one that is
    not NULL; last_attempted moves when running, completed_at when completed.
    """
    when_status = lambda s: F.max(F.when(F.col("status") == s, F.col(at)))
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("error", order).alias("error"),
        F.max_by("listing_url", F.when(F.col("listing_url").isNotNull(), F.col(order))).alias(
            "listing_url"
        ),
        when_status("running").alias("last_attempted"),
        when_status("completed").alias("completed_at"),
    )


def jobs_by_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("status") == status)


def run_log(events: DataFrame) -> DataFrame:
    """One row per run from appended open and close rows."""
    return events.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        *[
            F.max_by(c, F.when(F.col("finished_at").isNotNull(), F.col("finished_at"))).alias(c)
            for c in ("total_jobs", "successful", "failed")
        ],
    )


def schema_version(spark: SparkSession, spec: RecordSpec, applied_at: Column) -> DataFrame:
    """A row for the schema log: fingerprint as version, time, columns."""
    return spark.range(1).select(
        F.lit(spec.fingerprint()).alias("version"),
        applied_at.cast("timestamp").alias("applied_at"),
        F.lit(spec.columns_json()).alias("columns_json"),
    )


def ordered_records(records: DataFrame) -> DataFrame:
    """Stored records in the order they are listed: by scope, then by id."""
    return records.orderBy("university", "department", "record_id")


def recent_jobs(jobs: DataFrame, attempted: str = "last_attempted") -> DataFrame:
    """Jobs, newest attempt first, unattempted ones last."""
    return jobs.orderBy(F.col(attempted).desc_nulls_last(), "job_id")
