"""One incremental run: from targets, pages and responses to current records.

A run has two steps. ``plan_run`` compares the pages with what is stored and says
which targets have work and which of their pages need a response. ``finish_run`` takes
the responses and publishes the records of the targets that completed.

Stored are, per run, the fingerprint and the response of every page that a completed
target was built from, and of no other. So a page that changed while its target was
not processed, or failed, still counts as changed the next time, and an unchanged page
keeps its links and records without a new response. Nothing is published before
all stages are done: first the records, then the pages, so a run that
fails is simply run again. html is read where it is fingerprinted and never joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.keys import SOURCE_KEY, job_id, source_key
from ..functions.urls import is_http
from ..operators import dedup, enrichment, pages, records, responses, subtree, targets, traversal
from ..session import StepTables
from ..sinks.tables import GenerationTable
from ..spec import RecordSpec

PAGES = "url string, run_no bigint, fingerprint string, response string"


@dataclass
class RosterStore:
    """Where a roster lives: current records, and the pages they were built from."""

    spark: SparkSession
    path: str
    spec: RecordSpec
    records: GenerationTable = field(init=False)

    def __post_init__(self) -> None:
        columns = [SOURCE_KEY, *self.spec.names()]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        self.records = GenerationTable(self.spark, f"{self.path}/records", schema)

    def save_pages(self, run_no: int, built_from: DataFrame) -> None:
        """Publish (url, fingerprint, response) of the pages of a run."""
        rows = built_from.select("url", "fingerprint", "response")
        rows.write.mode("overwrite").parquet(f"{self.path}/pages/run_no={run_no}")

    def pages(self, before: int | None) -> DataFrame:
        """Newest stored (url, fingerprint, response) of earlier runs; None: no runs."""
        empty = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "fingerprint", "response")])
        if before is None:
            return self.spark.createDataFrame([], empty)
        log = self.spark.read.schema(PAGES).parquet(f"{self.path}/pages").where(F.col("run_no") < before)
        newest = log.groupBy("url").agg(F.max("run_no").alias("run_no"))
        return log.join(newest, ["url", "run_no"]).select("url", "fingerprint", "response")


@dataclass(frozen=True)
class RunResult:
    targets: DataFrame
    """The targets with their new status and link."""
    outcomes: DataFrame
    rows: DataFrame
    """Rows written for the targets that completed."""


@dataclass(frozen=True)
class RunPlan:
    run_no: int
    targets: DataFrame
    work: DataFrame
    """target_id, university, department, link, skipped: a row per target and link."""
    pages: DataFrame
    """url, fingerprint, response (stored, of unchanged pages) of the known pages."""
    to_extract: DataFrame
    """url of the pages that need a response before ``finish_run``."""
    steps: StepTables


def _known_pages(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fetched pages, and stored ones that could not be fetched this time.

    An unchanged page, and one that was not fetched or is blocked, has its stored response.
    """
    old = stored.select("url", F.col("fingerprint").alias("_old"), "response")
    both = fresh.join(old, "url", "full_outer")
    now = F.coalesce("fingerprint", "_old")
    same = F.coalesce(now == F.col("_old"), F.lit(False))
    status = F.when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(
        "url", now.alias("fingerprint"), F.when(same, F.col("response")).alias("response"), status.alias("status")
    )


def plan_run(
    store: RosterStore,
    run_no: int,
    target_rows: DataFrame,
    page_rows: DataFrame,
    force: bool = False,
    first_run: bool = False,
    gate: Callable[[Column], Column] | None = None,
) -> RunPlan:
    """What the pending targets need.

    ``target_rows`` are normalised targets and ``page_rows(url, html)`` the pages of
    this run. Pages for which ``gate`` (such as ``functions.html.is_blocked``) is true
    count as not fetched; the stored page, if there is one, takes their place. A URL that
    stands there more than once is one page.
    Targets of one (university, department) are worked on together and skipped only if
    nothing below any of their links changed.
    """
    spark = store.spark
    steps = StepTables(spark)
    if gate is not None:
        page_rows = page_rows.where(~gate(F.col("html")))
    fresh = pages.fingerprint_snapshots(page_rows, keep=("url",))
    fresh = fresh.groupBy("url").agg(F.max("fingerprint").alias("fingerprint"))
    known = steps.write("known", _known_pages(store.pages(None if first_run else run_no), fresh))
    parsed = responses.parse_responses(known.where("response is not null").select("url", "response"))
    links = steps.write("links", responses.response_links(parsed))

    pending = targets.pending_targets(target_rows)
    existing = (
        spark.createDataFrame([], f"{SOURCE_KEY} string")
        if first_run
        else store.records.current(before=run_no).select(SOURCE_KEY)
    )
    work = targets.forced_targets(pending, existing, force).withColumn(
        "target_id", job_id("university", "department")
    )
    changes = known.select("url", "status")
    direct = pages.subtree_changes(changes, links).select("url", "can_skip")
    # pages further below count too, as far as they are known
    usable = traversal.usable_links(links, known.select("url"))
    deep = subtree.changed_below(changes, usable).select("url", F.col("can_skip").alias("all_same"))
    can_skip = direct.join(deep, "url").select(
        F.col("url").alias("link"), (F.col("can_skip") & F.col("all_same")).alias("can_skip")
    )
    work = (
        work.groupBy("target_id", "link")
        .agg(F.min("university").alias("university"), F.min("department").alias("department"), F.max("forced").alias("forced"))
        .join(can_skip, "link", "left")
    )
    rest = (
        work.groupBy("target_id")
        .agg(F.bool_and(~F.col("forced") & F.coalesce("can_skip", F.lit(False))).alias("skipped"))
    )
    work = steps.write(
        "work", work.join(rest, "target_id").select("target_id", "university", "department", "link", "skipped")
    )
    below = traversal.crawl_closure(_roots(work, known), usable)
    need = below.select("url").distinct().join(known.where("response is null").select("url"), "url", "left_semi")
    return RunPlan(run_no, target_rows, work, known, steps.write("need", need), steps)


def _roots(work: DataFrame, known: DataFrame) -> DataFrame:
    open_ = work.where(~F.col("skipped") & is_http("link")).select(F.col("link").alias("url")).distinct()
    return open_.join(known.select("url"), "url", "left_semi").select(F.col("url").alias("root"))


def run(
    store: RosterStore,
    run_no: int,
    target_rows: DataFrame,
    page_rows: DataFrame,
    response_rows: DataFrame,
    detail_rows: DataFrame | None = None,
    force: bool = False,
    max_pages: int | None = None,
    first_run: bool = False,
    gate: Callable[[Column], Column] | None = None,
    enough_records: int = 0,
) -> RunResult:
    """Both steps at once, for callers that have the responses already."""
    plan = plan_run(store, run_no, target_rows, page_rows, force, first_run, gate)
    return finish_run(store, plan, response_rows, detail_rows, max_pages, enough_records)


def finish_run(
    store: RosterStore,
    plan: RunPlan,
    response_rows: DataFrame,
    detail_rows: DataFrame | None = None,
    max_pages: int | None = None,
    enough_records: int = 0,
) -> RunResult:
    """Publish the records of a planned run.

    ``response_rows(url, response)`` is what was extracted from pages and ``detail_rows``
    parsed detail pages (profile_url, fields, blocked, failed). A new response replaces
    the stored one. With ``max_pages`` a target visits so many pages at most; links of listing pages with
    ``enough_records`` records or more are not followed (0: always).
    """
    spec, steps, work, run_no = store.spec, plan.steps, plan.work, plan.run_no
    new = response_rows.groupBy("url").agg(F.max("response").alias("_new"))
    current = plan.pages.join(new, "url", "left").withColumn("response", F.coalesce("_new", "response"))
    current = steps.write("current", current.select("url", "fingerprint", "response"))
    parsed = responses.parse_responses(current.where("response is not null").select("url", "response"))
    parsed = steps.write("parsed", parsed)
    roots = _roots(work, plan.pages)
    usable = traversal.usable_links(responses.response_links(parsed), plan.pages.select("url"))
    if enough_records:
        each = parsed.select("url", F.explode("records"))
        usable = traversal.frontier_pruned(usable, each, roots, enough_records)
    visits = steps.write("visits", traversal.crawl_order(roots, usable, max_pages))

    extracted = responses.records_from_responses(parsed, spec)
    meta = university, department, listing_url = records.META_COLUMNS
    found = (
        visits.select("root", "visit_no", "url")
        .join(extracted, "url")
        .join(
            work.where(~F.col("skipped")).select(
                F.col("link").alias("root"),
                F.col("university").alias(university),
                F.col("department").alias(department),
                F.col("link").alias(listing_url),
            ),
            "root",
        )
        .withColumn("_ord", F.struct("root", "visit_no", "pos"))
        .withColumn(SOURCE_KEY, source_key(university, department))
        .drop("root", "visit_no", "url", "pos")
    )
    found = steps.write("found", found)
    if detail_rows is not None:
        gaps = enrichment.enrichment_plan(found, spec).where("needs_detail").select(SOURCE_KEY)
        keys = found.join(gaps, SOURCE_KEY, "left_semi").select("profile_url").distinct()
        details = detail_rows.join(keys, "profile_url", "left_semi")
        found = enrichment.enrich_records(found, details, spec, order="_ord")
    valid = records.validate_records(found, spec, keep=("_ord", *meta))
    filled = records.fill_records(valid, spec, meta)
    merged = dedup.merge_duplicates(filled, spec, (university, department), "_ord")
    final = records.apply_formulas(merged, spec)
    rows = steps.write("rows", records.export_rows(final, spec, meta))

    outcomes = steps.write("outcomes", _outcomes(work, visits, parsed))
    done = outcomes.where(F.col("status") == fv.STATUS_COMPLETED)
    done_keys = done.select(source_key("university", "department").alias(SOURCE_KEY))
    good = rows.join(done_keys, SOURCE_KEY, "left_semi")
    store.records.commit(run_no, done_keys, good)
    # a page that a failed target visited too must still count as changed for it
    seen = visits.join(work.select(F.col("link").alias("root"), "target_id"), "root").select("url", "target_id")
    of_done = seen.join(done, "target_id", "left_semi").select("url").distinct()
    of_others = seen.join(done, "target_id", "left_anti").select("url").distinct()
    built_from = current.join(of_done.join(of_others, "url", "left_anti"), "url", "left_semi")
    store.save_pages(run_no, built_from)
    # targets of one key share the status and keep their own links
    keep = outcomes.groupBy("target_id").agg(F.count("*").alias("n")).where("n > 1")
    shared = outcomes.join(keep, "target_id", "left_semi").select("target_id").distinct().withColumn("_many", F.lit(True))
    updates = (
        outcomes.join(shared, "target_id", "left")
        .select("university", "department", "status", F.when(F.col("_many").isNull(), F.col("link")).alias("link"), F.lit(0).alias("seq"))
        .distinct()
    )
    return RunResult(targets.apply_status(plan.targets, updates), outcomes, good)


def _outcomes(work: DataFrame, visits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Status of every target of the run from the pages that were visited."""
    nothing = F.lit(None).cast("string")
    answered = parsed.select("url", "page_error", F.size("records").alias("n"), F.lit(True).alias("answered"))
    page_results = (
        visits.join(answered, "url", "left")
        .withColumn("page_error", F.when(F.col("answered").isNull(), "no response").otherwise(F.col("page_error")))
        .join(work.select(F.col("link").alias("root"), "target_id"), "root")
        .select(
            "target_id",
            F.col("visit_no").alias("page_no"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_records"),
            "page_error",
            F.lit(False).alias("skipped"),
            nothing.alias("exception"),
        )
    )
    left_out = work.where("skipped").select(
        "target_id",
        F.lit(1).cast("bigint").alias("page_no"),
        F.lit(0).cast("bigint").alias("n_records"),
        nothing.alias("page_error"),
        F.lit(True).alias("skipped"),
        nothing.alias("exception"),
    )
    return targets.target_outcomes(work, page_results.unionByName(left_out))
