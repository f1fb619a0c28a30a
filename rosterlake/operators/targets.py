"""Targets: filters, status write-back, mirroring, counts, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as X
from ..functions.keys import SOURCE_KEY, source_key
from ..functions.urls import is_http

KEY = ("university", "department")


def _open_status(statuses=fv.PENDING_STATUSES) -> Column:
    return F.coalesce(F.lower("status"), F.lit("")).isin(*statuses)


def pending_targets(
    targets: DataFrame, pending_statuses: tuple[str, ...] = fv.PENDING_STATUSES
) -> DataFrame:
    """Targets to scrape: a department, and a status that is empty or skipped."""
    return targets.where(F.col("department").isNotNull() & _open_status(pending_statuses))


def discovery_targets(targets: DataFrame) -> DataFrame:
    """Targets whose departments are still to be found."""
    return targets.where(F.col("department").isNull() & _open_status(("", "skipped")))


def missing_link_targets(targets: DataFrame) -> DataFrame:
    return targets.where(
        (X.or_empty("department") != "") & ~is_http("link") & _open_status()
    )


def academic_departments(departments: DataFrame, name: str = "name") -> DataFrame:
    return departments.where(X.is_academic_department(name))


def clear_statuses(targets: DataFrame) -> DataFrame:
    return targets.withColumn("status", F.lit(None).cast("string"))


def count_set_statuses(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count("status").alias("n_cleared"))


def _same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.university").eqNullSafe(F.col(f"{b}.university")) & F.col(
        f"{a}.department"
    ).eqNullSafe(F.col(f"{b}.department"))


def apply_status(targets: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Write statuses and links back onto all matching targets.

    Updates are replayed in ``order``: the last status wins, and the last link
    that is not empty; without any the target keeps its link.
    """
    link = F.nullif(F.col("link"), F.lit(""))
    last = updates.groupBy(*KEY).agg(
        F.max(F.struct(order, "status")).alias("_s"),
        F.max(F.when(link.isNotNull(), F.struct(order, link.alias("link")))).alias("_l"),
    )
    joined = targets.alias("t").join(last.alias("u"), _same_key("t", "u"), "left")
    changed = {
        "status": F.when(F.col("u._s").isNotNull(), F.col("u._s.status")).otherwise(
            F.col("t.status")
        ),
        "link": F.coalesce(F.col("u._l.link"), F.col("t.link")),
    }
    return joined.select(
        *[changed.get(c, F.col(f"t.`{c}`")).alias(c) for c in targets.columns]
    )


def append_targets(
    targets: DataFrame, new: DataFrame, dedupe: bool = True, order: tuple[str, ...] = ()
) -> DataFrame:
    """Append rows; columns they lack become NULL.

    With ``dedupe`` a key that is already there, or comes twice, is added once: its
    first row by the ``order`` columns, then by all others.
    """
    if dedupe:
        rest = [c for c in new.columns if c not in KEY]
        if rest:
            by = [*order, *(c for c in rest if c not in order)]
            first = new.groupBy(*KEY).agg(F.min(F.struct(*by)).alias("_first"))
            new = first.select(*[c if c in KEY else F.col("_first")[c].alias(c) for c in new.columns])
        else:
            new = new.distinct()
        new = (
            new.alias("n")
            .join(targets.select(*KEY).distinct().alias("t"), _same_key("n", "t"), "left_anti")
        )
    return targets.unionByName(new, allowMissingColumns=True)


def sync_actions(stored: DataFrame, fresh: DataFrame, order: str = "ord") -> DataFrame:
    """Mirror a full input: one action per key (insert, update or delete).

    Duplicate input keys keep the last row. NULL departments match each other.
    Both sides are unique per key before they meet.
    """
    rest = [c for c in fresh.columns if c not in (*KEY, order)]
    newest = (
        fresh.groupBy(*KEY)
        .agg(F.max(F.struct(order, *rest)).alias("_n"))
        .select(*KEY, *[F.col(f"_n.{c}").alias(c) for c in rest], F.lit(True).alias("_in"))
    )
    old = stored.select(*KEY).distinct().withColumn("_old", F.lit(True))
    joined = old.alias("o").join(newest.alias("f"), _same_key("o", "f"), "full_outer")
    action = (
        F.when(F.col("f._in").isNull(), "delete")
        .when(F.col("o._old").isNull(), "insert")
        .otherwise("update")
    )
    keys = [
        F.when(F.col("f._in"), F.col(f"f.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in KEY
    ]
    return joined.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest], action.alias("action"))


def sync_counts(actions: DataFrame) -> DataFrame:
    """(n_kept, n_deleted): distinct input keys and stored keys removed."""
    return actions.agg(
        F.count_if(F.col("action") != "delete").alias("n_kept"),
        F.count_if(F.col("action") == "delete").alias("n_deleted"),
    )


def forced_targets(targets: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``forced``: asked for, or no stored rows with the target's key."""
    keys = stored.select(X.strip(SOURCE_KEY).alias("_k")).distinct().withColumn("_has", F.lit(True))
    keyed = targets.withColumn("_k", source_key("university", "department"))
    return (
        keyed.join(keys, "_k", "left")
        .withColumn("forced", F.lit(force) | F.col("_has").isNull())
        .drop("_k", "_has")
    )


def status_counts(targets: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("pending"))
    return targets.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def _bucket() -> Column:
    s = F.coalesce(F.lower("status"), F.lit(""))
    return (
        F.when(s.contains("failed") | s.contains("error"), "failed")
        .when(s == "skipped", "skipped")
        .when(s == "completed", "completed")
        .otherwise("pending")
    )


def target_summary(targets: DataFrame) -> DataFrame:
    """One row: completed, failed, skipped, pending and total."""
    b = _bucket()
    return targets.agg(
        *[F.count_if(b == n).alias(n) for n in ("completed", "failed", "skipped", "pending")],
        F.count("*").alias("total"),
    )


def failed_targets(targets: DataFrame) -> DataFrame:
    return targets.where(_bucket() == "failed").select(
        "university", "department", F.lower("status").alias("error")
    )


def target_outcomes(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Status and link of every target after a run.

    ``pages(target_id, page_no, n_records, page_error, skipped, exception)`` has
    one row per visited page. An error on the first page fails the target, on a
    later page it drops that page only; exception text is kept whole.
    """
    error = F.nullif(F.col("page_error"), F.lit(""))
    good = error.isNull()
    per = pages.groupBy("target_id").agg(
        F.bool_or(F.coalesce("skipped", F.lit(False))).alias("_skipped"),
        F.min("exception").alias("_exception"),
        F.min(F.when(F.col("page_no") == 1, error)).alias("_first_error"),
        F.coalesce(F.sum(F.when(good, F.col("n_records"))), F.lit(0)).alias("_n"),
        F.count_if(~good).alias("n_error_pages"),
    )
    failed = F.lit(fv.STATUS_FAILED_PREFIX)
    status = (
        F.when(F.col("_skipped"), fv.STATUS_SKIPPED)
        .when(
            F.col("_exception").isNotNull(),
            F.concat(failed, "_exception"),
        )
        .when(
            F.col("_first_error").isNotNull(),
            F.concat(failed, F.lit(fv.PAGE_ISSUE_PREFIX), F.col("_first_error")),
        )
        .when(F.col("_n").isNull(), F.concat(failed, F.lit(fv.NO_PAGE_ERROR)))
        .otherwise(fv.STATUS_COMPLETED)
    )
    failed_first = F.col("_exception").isNotNull() | F.col("_first_error").isNotNull()
    return targets.join(per, "target_id", "left").select(
        "target_id",
        "university",
        "department",
        "link",
        status.alias("status"),
        F.when(F.coalesce(failed_first, F.lit(False)), 0)
        .otherwise(F.coalesce("_n", F.lit(0)))
        .alias("n_records"),
        F.coalesce("n_error_pages", F.lit(0)).alias("n_error_pages"),
    )


def run_summary(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, successful, failed and skipped, per run."""
    s = F.lower("status")
    totals = [
        F.count("*").alias("total"),
        F.count_if(s == "completed").alias("successful"),
        F.count_if(s.startswith("failed")).alias("failed"),
        F.count_if(s == "skipped").alias("skipped"),
    ]
    return outcomes.groupBy(*by).agg(*totals) if by else outcomes.agg(*totals)
