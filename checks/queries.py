"""One Spark query per operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import html as H
from rosterlake.functions import keys as K
from rosterlake.functions import text as X
from rosterlake.functions import urls as U
from rosterlake.operators import closure_updates, dedup, enrichment, history, hits, lifecycle, links, listing, pages
from rosterlake.operators import records, requests, responses, similar_names, subtree, targets, traversal, visit_order
from rosterlake.plans import discovery, roster_run
from rosterlake.session import StepTables, scratch_root
from rosterlake.sinks import tables
from rosterlake.sources import snapshots
from rosterlake.sources.targets import normalize_targets
from rosterlake.streaming import snapshots as streams

from .fixtures import DETAIL_SPEC, LISTING_SPEC, SPEC, fx, table
from .scratch import with_scratch

QUERIES: dict[str, object] = {}


def query(fn):
    """Register a query; it may write to the scratch folder of its session."""

    def run(spark, sf):
        return fn(with_scratch(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


def _ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_targets(fx(spark, sf, "fx_targets"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    df = fx(spark, sf, "fx_records")
    return df.withColumn(K.SOURCE_KEY, K.source_key("university", "department"))


# --- sources and sinks ------------------------------------------------------


@query
def targets_normalized(spark, sf):
    return _targets(spark, sf)


@query
def pages_latest(spark, sf):
    latest = snapshots.latest_pages(fx(spark, sf, "fx_snapshots"))
    return latest.select("url", "run_no", F.sha2("html", 256).alias("html_sha"))


@query
def snapshots_live(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("stored_at"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id") * 3600 * 10).alias("ttl_sec"),
    )
    live = snapshots.live_entries(e, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return live.select("event_id", "ttl_sec")


@query
def target_sync_actions(spark, sf):
    fresh = _targets(spark, sf).withColumnRenamed("target_id", "ord")
    stored = fx(spark, sf, "fx_updates").select("university", "department")
    return targets.sync_actions(stored, fresh)


@query
def target_sync_counts(spark, sf):
    return targets.sync_counts(target_sync_actions(spark, sf))


@query
def targets_appended(spark, sf):
    new = fx(spark, sf, "fx_departments").select(
        F.concat(F.lit("NATION_"), F.col("ord") % 25).alias("university"),
        F.concat_ws(" ", F.lit("BUILDING"), F.col("ord").cast("string")).alias("department"),
    )
    return targets.append_targets(_targets(spark, sf).drop("target_id"), new)


@query
def export_rows(spark, sf):
    filled = records.fill_records(fx(spark, sf, "fx_records"), SPEC)
    return records.export_rows(records.apply_formulas(filled, SPEC), SPEC)


@query
def export_json(spark, sf):
    rows = fx(spark, sf, "fx_records").select("ord", "full_name", "title", "email")
    return records.json_rows(rows)


@query
def merge_by_source_key(spark, sf):
    r = _records(spark, sf)
    old = r.select(K.SOURCE_KEY, "full_name", "email")
    keys = r.where(F.col("department").isin("BUILDING", "MACHINERY")).select(K.SOURCE_KEY)
    new = (
        fx(spark, sf, "fx_details")
        .where(F.col("department") == "BUILDING")
        .select(
            K.source_key("university", "department").alias(K.SOURCE_KEY),
            F.lit(None).cast("string").alias("full_name"),
            "email",
        )
    )
    return tables.merge_by_source_key(old, keys, new)


@query
def generation_table(spark, sf):
    """The same replacement through the written table of generations."""
    r = _records(spark, sf).select(K.SOURCE_KEY, "full_name", "email", "department")
    rows = r.drop("department")
    path = f"{scratch_root(spark)}/generations/{uuid.uuid4().hex}"
    out = tables.GenerationTable(spark, path, rows.schema)
    out.commit(1, r, rows)
    again = r.where(F.col("department").isin("BUILDING", "MACHINERY"))
    kept = again.where(F.col("department") == "BUILDING").withColumn("full_name", F.upper("full_name"))
    out.commit(2, again, kept.drop("department"))
    return out.current()


@query
def run_log(spark, sf):
    log = lifecycle.run_log(fx(spark, sf, "fx_run_events"))
    return log.select(
        "run_id",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"),
        F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"),
        "total_jobs",
        "successful",
        "failed",
    )


# --- pages ------------------------------------------------------------------


@query
def pages_clean(spark, sf):
    return pages.clean_pages(table(spark, sf, "pages")).select("page_id", "html")


@query
def page_flags(spark, sf):
    return pages.page_flags(fx(spark, sf, "fx_snapshots"), keep=("url", "run_no"))


@query
def page_flags_kinds(spark, sf):
    """Signs of refused pages and of templates where they mean that, and where they don't."""
    return pages.page_flags(fx(spark, sf, "fx_page_kinds"), keep=("url", "run_no"))


@query
def page_fingerprint(spark, sf):
    return pages.fingerprint_snapshots(fx(spark, sf, "fx_snapshots"))


@query
def page_changes(spark, sf):
    changes = pages.changes_between(fx(spark, sf, "fx_snapshots"), 2)
    return changes.select("url", "status", "old_fingerprint", "new_fingerprint")


@query
def subtree_changes(spark, sf):
    # read twice, so it is written once (narrow: no html)
    changes = StepTables(spark).write(
        "changes", pages.changes_between(fx(spark, sf, "fx_snapshots"), 2)
    )
    p = table(spark, sf, "pages").select("page_id", "url")
    host_links = p.select(
        "url", F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("page_id")
    )
    child = p.select("page_id", F.col("url").alias("dst"))
    edges = host_links.join(child, "page_id").select(F.col("url").alias("src"), "dst")
    return pages.subtree_changes(changes, edges)


@query
def subtree_changes_deep(spark, sf):
    """Pages with nothing changed at any depth below; every fourth page links back up."""
    changes = pages.changes_between(fx(spark, sf, "fx_snapshots"), 2).select("url", "status")
    p = table(spark, sf, "pages").select("page_id", "url")
    n = F.col("page_id")
    up = F.when((n % 4 == 0) & (n > 0), F.floor((n - 1) / 2))
    to = p.select(F.col("url").alias("src"), F.explode(F.array(n * 2 + 1, n * 2 + 2, up)).alias("page_id"))
    links = to.join(p.withColumnRenamed("url", "dst"), "page_id").select("src", "dst")
    return subtree.changed_below(StepTables(spark).write("changes", changes), links)


@query
def page_emails(spark, sf):
    return pages.page_emails(fx(spark, sf, "fx_contacts"), "doc_id", "text")


@query
def page_emails_html(spark, sf):
    return pages.page_emails(table(spark, sf, "pages"), "url", "html")


@query
def emails_deobfuscated(spark, sf):
    c = fx(spark, sf, "fx_contacts").withColumn("text", X.deobfuscate_emails("text"))
    return pages.page_emails(c, "doc_id", "text")


@query
def title_prefix(spark, sf):
    r = fx(spark, sf, "fx_records")
    named = r.select("ord", F.concat_ws(" ", "title", "full_name").alias("shown"))
    return named.select("ord", X.title_prefix("shown").alias("prefix"))


@query
def listing_rows(spark, sf):
    return listing.listing_rows(table(spark, sf, "pages"))


def _directories(spark, sf):
    """Pages that list forty customers each: cards, terms, lists in lists and table rows."""
    number, at = F.expr("c_custkey div 40"), F.col("c_custkey") % 40
    key = F.col("c_custkey").cast("string")
    link = F.concat(F.lit('<a href="/p/'), key, F.lit('">'), F.col("c_name"), F.lit("</a>"))
    mail = F.concat(F.lit("m"), key, F.lit("@d.edu"))
    in_list = F.when(at % 3 == 0, "<ul>").when(at % 3 == 1, "</li>").otherwise("</ul></li>")
    shapes = [
        ("", F.concat(F.lit("<div><div><b>"), link, F.lit("</div><div>"), F.col("c_mktsegment"), F.lit("<br>"), mail, F.lit("</div></div>")), ""),
        ("<dl>", F.concat(F.lit("<dt>"), F.col("c_name"), F.lit("<dd>"), mail, F.lit("<dd>"), F.col("c_mktsegment")), "</dl>"),
        ("<ul>", F.concat(F.lit("<li>"), link, in_list), "</ul>"),
        ("<table><tr><th>Name<th>Mail", F.concat(F.lit("<tr><td>"), F.col("c_name"), F.lit('<td><a href="mailto:'), mail, F.lit('">write</a>')), "</table>"),
    ]
    rows = table(spark, sf, "customer").select(number.alias("page"), at.alias("at"), *(s[1].alias(f"s{i}") for i, s in enumerate(shapes)))
    shape = F.col("page") % 4
    entry = F.when(shape == 0, F.col("s0")).when(shape == 1, F.col("s1")).when(shape == 2, F.col("s2")).otherwise(F.col("s3"))
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", entry.alias("entry")))).alias("entries"))
    menu = "<nav><ul>{}</ul></nav>".format("".join(f'<li><a href="/{w}">{w}</a>' for w in ("home", "news", "visit")))
    head, tail = (
        F.element_at(F.array(*(F.lit(s[at]) for s in shapes)), (shape + 1).cast("int")) for at in (0, 2)
    )
    return pages.select(
        F.concat(F.lit("https://d.edu/people/"), F.col("page").cast("string")).alias("url"),
        F.concat(F.lit(f"<html><body>{menu}<div><p><b>All people<br>"), head, F.array_join("entries.entry", ""), tail, F.lit("</div></body></html>")).alias("html"),
    )


@query
def records_mined(spark, sf):
    """Entries of directory pages by their repeated structure."""
    mined = listing.records_mined(_directories(spark, sf))
    return mined.select("url", "pos", "name", "profile_url", "email")


@query
def records_extracted(spark, sf):
    def anchors(url: str, html: str):
        import re

        for m in re.finditer(r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', html):
            yield {"Full Name": m[2], "profile_url": m[1]}

    return listing.extract_records(table(spark, sf, "pages"), LISTING_SPEC, anchors)


# --- links ------------------------------------------------------------------


@query
def page_links(spark, sf):
    return links.page_links(table(spark, sf, "pages"))


@query
def url_from_text(spark, sf):
    a = fx(spark, sf, "fx_answers")
    return a.select("page_id", X.url_in("answer").alias("url"))


@query
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select(
        "url", U.canonical("url").alias("canonical"), U.host("url").alias("host")
    )


@query
def urls_allowed(spark, sf):
    return links.allowed_urls(fx(spark, sf, "fx_hits")).select("query_id", "rank", "url")


@query
def urls_allowed_substring(spark, sf):
    h = fx(spark, sf, "fx_hits")
    return links.allowed_urls(h, mode="substring").select("query_id", "rank", "url")


@query
def pagination_series(spark, sf):
    return links.pagination_series(fx(spark, sf, "fx_series"))


@query
def search_queries(spark, sf):
    return requests.search_queries(_targets(spark, sf).select("university", "department"))


@query
def hits_topn(spark, sf):
    h = fx(spark, sf, "fx_hits").select("query_id", "rank", "url")
    return hits.top_hits(h, 5)


@query
def hits_combined(spark, sf):
    h = fx(spark, sf, "fx_hits").select("target_id", "query_no", "rank", "url")
    return hits.combine_hits(links.allowed_urls(h), ["target_id"])


@query
def listing_url_best(spark, sf):
    return hits.best_listing_url(fx(spark, sf, "fx_hits"), ["target_id"], "domain", "department")


# --- traversal --------------------------------------------------------------


def _regions(spark, sf):
    return table(spark, sf, "region").select(
        F.concat(F.lit("https://d/r"), F.col("r_regionkey").cast("string")).alias("root")
    )


@query
def crawl_closure(spark, sf):
    closure = traversal.crawl_closure(_regions(spark, sf), fx(spark, sf, "fx_links"))
    return closure.select("root", "url", "depth")


@query
def crawl_ancestors(spark, sf):
    closure = traversal.crawl_closure(_regions(spark, sf), fx(spark, sf, "fx_links"))
    return closure.select("root", "url", F.array_join("ancestors", " > ").alias("ancestors"))


@query
def pagination_walk(spark, sf):
    """Every chain of next links from its head to its end."""
    edges = fx(spark, sf, "fx_links")
    nexts = edges.where(F.col("kind") == "next")
    starts = nexts.select(F.col("src").alias("root")).distinct()
    starts = starts.join(nexts.select(F.col("dst").alias("root")), "root", "left_anti")
    return traversal.pagination_walk(starts, edges)


@query
def crawl_order(spark, sf):
    roots = table(spark, sf, "nation").select(
        F.concat(F.lit("https://d/n"), F.col("n_nationkey").cast("string")).alias("root")
    )
    order = traversal.crawl_order(roots, fx(spark, sf, "fx_links"), max_pages=30)
    return order.withColumn("ancestors", F.array_join("ancestors", " > "))


@query
def crawl_order_full(spark, sf):
    """The visiting order of all pages that the nations lead to, without a budget."""
    roots = table(spark, sf, "nation").select(
        F.concat(F.lit("https://d/n"), F.col("n_nationkey").cast("string")).alias("root")
    )
    return visit_order.visit_order(roots, fx(spark, sf, "fx_links"))


def _changed_links(spark, sf):
    """Links that are gone, and links that are new: from a page to the next but one."""
    links = fx(spark, sf, "fx_links")
    number = F.regexp_extract("dst", "([0-9]+)$", 1).cast("bigint")
    removed = links.where(F.when(F.col("kind") == "next", number % 13 == 5).otherwise(number % 11 == 3))
    added = links.where((F.col("kind") == "next") & (number % 7 == 2)).select(
        "src",
        F.concat(F.regexp_replace("dst", "[0-9]+$", ""), (number + 2).cast("string")).alias("dst"),
        F.lit("child").alias("kind"),
        F.lit(99).cast("bigint").alias("pos"),
    )
    return links, added, removed


@query
def closure_delta(spark, sf):
    """The closure after the links changed, from the one before and what changes in it."""
    before = crawl_closure(spark, sf)
    changes = closure_updates.closure_changes(before, *_changed_links(spark, sf))
    return closure_updates.updated_closure(before, changes)


@query
def frontier_pruned(spark, sf):
    found = table(spark, sf, "orders").select(
        F.concat(F.lit("https://d/n"), (F.col("o_custkey") % 25).cast("string")).alias("url")
    ).unionByName(
        table(spark, sf, "orders").select(
            F.concat(F.lit("https://d/r"), (F.col("o_custkey") % 2).cast("string")).alias("url")
        )
    )
    return traversal.frontier_pruned(
        fx(spark, sf, "fx_links"), found, _regions(spark, sf), threshold=40
    )


# --- responses --------------------------------------------------------------


def _parsed(spark, sf):
    return responses.parse_responses(fx(spark, sf, "fx_responses"))


@query
def responses_parsed(spark, sf):
    return _parsed(spark, sf).select(
        "page_id",
        "parse_status",
        "page_error",
        F.size("records").cast("bigint").alias("n_records"),
        "next_page_url",
        F.array_join("child_page_urls", " ").alias("child_page_urls"),
    )


@query
def response_links(spark, sf):
    return responses.response_links(_parsed(spark, sf))


@query
def records_from_responses(spark, sf):
    return responses.records_from_responses(_parsed(spark, sf), LISTING_SPEC)


@query
def values_coerced(spark, sf):
    return responses.parse_details(fx(spark, sf, "fx_detail_responses"), DETAIL_SPEC)


@query
def departments_parsed(spark, sf):
    return responses.department_names(fx(spark, sf, "fx_department_lists"), ["ord", "university"])


@query
def departments_discovered(spark, sf):
    answers = fx(spark, sf, "fx_department_lists")
    asking = answers.select(
        F.col("university"),
        F.lit(None).cast("string").alias("department"),
        F.lit(None).cast("string").alias("link"),
        F.when(F.col("ord") % 3 == 0, "Skipped").alias("status"),
    )
    return discovery.discover_departments(asking, answers)


@query
def listing_urls_found(spark, sf):
    """Best listing page over all hits of a target, written back to it."""
    h = fx(spark, sf, "fx_hits").select(
        F.col("target_id").cast("string").alias("university"),
        "department", "query_no", "rank", "url", "domain",
    )
    t = h.select("university", "department").distinct().select(
        "*", F.lit("ftp://none").alias("link"), F.lit("nan").alias("status")
    )
    return discovery.find_listing_urls(t, h)


@query
def extraction_requests(spark, sf):
    p = table(spark, sf, "pages").select("url", "html")
    known = F.array_compact(F.transform(H.hrefs("html"), lambda h: U.resolve("url", h)))
    context = p.select("url", F.array(U.origin("url")).alias("ancestors"), known.alias("known_urls"))
    made = requests.extraction_requests(p, LISTING_SPEC, context)
    return made.select("url", F.length("prompt").cast("bigint").alias("n_chars"), "prompt_hash")


@query
def detail_requests(spark, sf):
    r = _records(spark, sf)
    plan = enrichment.enrichment_plan(r, SPEC)
    return requests.detail_requests(r, plan, SPEC)


# --- record columns ---------------------------------------------------------


@query
def records_validated(spark, sf):
    return records.validate_records(fx(spark, sf, "fx_records"), SPEC, keep=("ord",)).drop(
        "institution", "listing", "source", "last_name"
    )


@query
def validation_report(spark, sf):
    return records.validation_report(fx(spark, sf, "fx_records"), SPEC)


@query
def records_filled(spark, sf):
    r = fx(spark, sf, "fx_records").drop("listing_url").withColumn("target_id", F.col("ord"))
    t = fx(spark, sf, "fx_records").select(
        F.col("ord").alias("target_id"), "university", "department", F.col("listing_url").alias("link")
    )
    linked = records.with_target_metadata(r.drop("university", "department"), t)
    filled = records.fill_records(linked, SPEC)
    return filled.select("ord", "department_name", "institution", "listing", "source")


@query
def records_formula(spark, sf):
    return records.apply_formulas(fx(spark, sf, "fx_records"), SPEC).select("ord", "last_name")


@query
def records_role_filtered(spark, sf):
    return records.role_filtered(fx(spark, sf, "fx_records")).select("ord", "position")


@query
def departments_filtered(spark, sf):
    return targets.academic_departments(fx(spark, sf, "fx_departments"))


@query
def stable_ids(spark, sf):
    return fx(spark, sf, "fx_records").select(
        "ord",
        K.source_key("university", "department").alias("source_key"),
        K.job_id("university", "department").alias("job_id"),
        K.url_key("profile_url").alias("url_key"),
        K.record_id(
            "university",
            "department",
            {"email": F.col("email"), "title": F.col("title")},
            content=F.col("full_name"),
        ).alias("record_id"),
    )


@query
def records_enriched(spark, sf):
    return enrichment.enrich_records(
        fx(spark, sf, "fx_records"), fx(spark, sf, "fx_details"), SPEC, remark="remark"
    ).select("ord", "title", "email", "homepage", "position", "remark")


@query
def field_null_counts(spark, sf):
    names = [c.name for c in SPEC.extractable()]
    return enrichment.field_null_counts(fx(spark, sf, "fx_records"), names)


@query
def field_empty_any(spark, sf):
    names = [c.name for c in SPEC.extractable()]
    return enrichment.field_empty_any(_records(spark, sf), names, by=[K.SOURCE_KEY])


@query
def enrichment_plan(spark, sf):
    plan = enrichment.enrichment_plan(_records(spark, sf), SPEC)
    return plan.withColumn("fields", F.array_join("fields", ","))


@query
def error_budget(spark, sf):
    d = fx(spark, sf, "fx_details")
    return enrichment.error_budget(
        d.withColumn(K.SOURCE_KEY, K.source_key("university", "department"))
    )


@query
def records_deduped(spark, sf):
    return dedup.merge_duplicates(fx(spark, sf, "fx_records"), SPEC)


@query
def records_deduped_global(spark, sf):
    return dedup.merge_duplicates(fx(spark, sf, "fx_records"), SPEC, scope=())


@query
def dedup_report(spark, sf):
    return dedup.dedup_report(fx(spark, sf, "fx_records"), SPEC)


@query
def departments_distinct(spark, sf):
    return dedup.distinct_names(fx(spark, sf, "fx_departments"), scope=("university",))


@query
def departments_canonical(spark, sf):
    return dedup.canonical_names(fx(spark, sf, "fx_departments"), scope=("university",))


@query
def departments_similar(spark, sf):
    """Names of units of one university that are nearly the same."""
    return similar_names.similar_names(fx(spark, sf, "fx_unit_names"), scope=("university",), similarity=0.7)


@query
def results_filtered(spark, sf):
    rows = _records(spark, sf).select(
        K.SOURCE_KEY, "ord", "full_name", "email", "university", "department"
    )
    out = records.results_filtered(
        rows.withColumn("ord", F.col("ord").cast("string")),
        university="nation_3",
        department="Building",
        institution_column="university",
        department_column="department",
    )
    m = F.col("record")
    return out.select(
        F.try_element_at(m, F.lit("ord")).alias("ord"),
        F.try_element_at(m, F.lit("email")).alias("email"),
        F.size(m).cast("bigint").alias("n_fields"),
    )


# --- targets ----------------------------------------------------------------


@query
def targets_pending(spark, sf):
    return targets.pending_targets(_targets(spark, sf))


@query
def targets_discovery(spark, sf):
    return targets.discovery_targets(_targets(spark, sf))


@query
def targets_missing_link(spark, sf):
    return targets.missing_link_targets(_targets(spark, sf))


@query
def targets_cleared(spark, sf):
    t = _targets(spark, sf)
    return targets.count_set_statuses(t).withColumn(
        "n_left", F.lit(0).cast("bigint")
    ).unionByName(
        targets.clear_statuses(t).agg(
            F.lit(0).cast("bigint").alias("n_cleared"), F.count("status").alias("n_left")
        )
    )


@query
def targets_forced(spark, sf):
    stored = fx(spark, sf, "fx_updates").where(F.col("status") == "completed").select(
        K.source_key("university", "department").alias(K.SOURCE_KEY)
    )
    return targets.forced_targets(_targets(spark, sf), stored).select("target_id", "forced")


@query
def targets_status_applied(spark, sf):
    return targets.apply_status(_targets(spark, sf), fx(spark, sf, "fx_updates"))


@query
def target_status_counts(spark, sf):
    return targets.status_counts(_targets(spark, sf))


@query
def target_summary(spark, sf):
    return targets.target_summary(_targets(spark, sf))


@query
def targets_failed(spark, sf):
    return targets.failed_targets(_targets(spark, sf))


@query
def target_outcomes(spark, sf):
    t = _targets(spark, sf)
    return targets.target_outcomes(t, fx(spark, sf, "fx_page_results"))


@query
def run_summary(spark, sf):
    outcomes = targets.target_outcomes(_targets(spark, sf), fx(spark, sf, "fx_page_results"))
    return targets.run_summary(outcomes, by=("university",))


# --- lifecycle --------------------------------------------------------------


def _after_run(spark, sf):
    seen = fx(spark, sf, "fx_seen")
    return lifecycle.merge_run(
        fx(spark, sf, "fx_stored"),
        seen,
        seen.select("university", "department"),
        F.lit("2024-03-01 00:00:00"),
    )


@query
def lifecycle_after_run(spark, sf):
    df = _after_run(spark, sf)
    return df.select(
        *[_ts(c) if c in ("first_seen", "last_seen") else F.col(c) for c in df.columns]
    )


@query
def lifecycle_archived(spark, sf):
    df = lifecycle.archive_missing(
        _after_run(spark, sf), fx(spark, sf, "fx_archive"), 2, F.lit("2024-03-02 00:00:00")
    )
    times = ("first_seen", "last_seen", "archived_at")
    return df.select(*[_ts(c) if c in times else F.col(c) for c in df.columns])


@query
def lifecycle_live(spark, sf):
    live = lifecycle.live_after_archive(_after_run(spark, sf), 2)
    return live.select("record_id", "status", "runs_not_found")


@query
def records_active(spark, sf):
    return lifecycle.active_records(fx(spark, sf, "fx_stored"), "NATION_3", "BUILDING").select(
        "record_id", "data"
    )


@query
def lifecycle_history(spark, sf):
    return lifecycle.lifecycle_history(fx(spark, sf, "fx_sightings"), archive_after=2)


@query
def records_as_of(spark, sf):
    """The state of every record in every run, one before the first and one after the last."""
    seen = fx(spark, sf, "fx_sightings")
    runs = seen.select(F.explode(F.array(F.col("run_no") - 1, F.col("run_no"), F.col("run_no") + 1)).alias("run_no"))
    found = history.as_of(history.state_intervals(seen, archive_after=2), runs)
    return found.select("run_no", "university", "department", "rec_key", "status", "first_run", "last_run")


@query
def lifecycle_run_counts(spark, sf):
    return lifecycle.lifecycle_run_counts(fx(spark, sf, "fx_sightings"))


def _jobs(spark, sf):
    jobs = lifecycle.job_state(fx(spark, sf, "fx_job_events"))
    return jobs.select(
        "job_id",
        "status",
        "error",
        "listing_url",
        F.unix_micros(F.col("last_attempted").cast("timestamp")).alias("last_attempted_us"),
        F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us"),
    )


@query
def job_state(spark, sf):
    return _jobs(spark, sf)


@query
def jobs_by_status(spark, sf):
    return lifecycle.jobs_by_status(_jobs(spark, sf), "failed").select("job_id", "error")


@query
def jobs_recent(spark, sf):
    """Jobs in order, newest attempt first, unattempted ones last."""
    jobs = _jobs(spark, sf).select("job_id", "last_attempted_us")
    return lifecycle.recent_jobs(jobs, "last_attempted_us")


@query
def records_ordered(spark, sf):
    """Stored records in listing order."""
    rows = lifecycle.ordered_records(fx(spark, sf, "fx_stored"))
    return rows.select("university", "department", "record_id")


@query
def rows_numbered(spark, sf):
    """Place of every record among those of its university and department."""
    rows = records.number_rows(_records(spark, sf), ("university", "department"), ("ord",))
    return rows.select("ord", "university", "department", "row_no")


# --- a whole run ------------------------------------------------------------


@query
def full_run(spark, sf):
    """Three runs over pages of which half change after the first.

    Every page is the listing page of a target, named by its URL and its number, as some
    URLs have several pages. Responses fail for half the pages in the
    first two runs; one target in seven is not processed in the second. What changed
    meanwhile, or failed, is made up for in the third; the rest is skipped there.
    """
    named = F.concat("url", F.lit("#P"), F.col("page_id").cast("string"))
    p = table(spark, sf, "pages").withColumn("url", named)
    no_status = F.lit(None).cast("string")
    t = p.select(
        U.host("url").alias("university"),
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("department"),
        F.col("url").alias("link"),
        F.when(F.col("page_id") % 7 == 0, "completed").alias("_second"),
    )
    changed = F.when(
        F.col("page_id") % 4 >= 2, F.concat("html", F.lit("<p>another entry</p>"))
    ).otherwise(F.replace(F.col("html"), F.lit('class="ad"'), F.lit('class="ad-17"')))
    later = p.select("url", changed.alias("html"))
    answers = fx(spark, sf, "fx_run_responses").withColumn("url", named)
    store = roster_run.RosterStore(
        spark, f"{scratch_root(spark)}/roster/{uuid.uuid4().hex}", LISTING_SPEC
    )
    for run_no, found in ((1, p.select("url", "html")), (2, later), (3, later)):
        status = F.col("_second") if run_no == 2 else no_status
        roster_run.run(
            store,
            run_no,
            t.withColumn("status", status).drop("_second"),
            found,
            answers.where(F.col("run_no") == run_no).select("url", "response"),
            first_run=run_no == 1,
        )
    return store.records.current().drop("run_no")


# --- streams ----------------------------------------------------------------


def _tracked(spark, sf, publisher=None):
    """Both runs of snapshots through the tracker, one batch each."""
    work = f"{scratch_root(spark)}/stream/{uuid.uuid4().hex}"
    snaps = fx(spark, sf, "fx_snapshots")
    files = 8  # per run, which makes one batch of each run
    for run_no in (1, 2):
        one_run = snaps.where(F.col("run_no") == run_no).repartition(files)
        one_run.write.mode("append").parquet(f"{work}/in")
    tracker = streams.ChangeTracker(spark, f"{work}/state", publisher)
    stream = streams.read_snapshot_stream(spark, f"{work}/in", files_per_batch=files)
    tracker.start(stream, f"{work}/checkpoint").awaitTermination()
    return tracker


@query
def stream_page_changes(spark, sf):
    return _tracked(spark, sf).changes().select("url", "status", "batch_id")


@query
def stream_listing_rows(spark, sf):
    """Listing rows of every page, kept up to date by the stream."""
    schema = listing.listing_rows(table(spark, sf, "pages")).withColumnRenamed("url", K.SOURCE_KEY).schema
    path = f"{scratch_root(spark)}/stream/{uuid.uuid4().hex}/rows"
    rows = tables.GenerationTable(spark, path, schema)
    _tracked(spark, sf, streams.page_row_publisher(rows, listing.listing_rows))
    return rows.current().drop("run_no")


@query
def stream_dedup(spark, sf):
    """Every event sent twice, kept once."""
    work = f"{scratch_root(spark)}/stream/{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema

    def events():
        return (
            spark.readStream.schema(schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(sf)
            .withColumn("ts", F.col("ts").cast("timestamp"))
        )

    once = streams.distinct_events(events().unionByName(events()), ["event_id"], "ts", "1 day")
    started = (
        once.select("event_id", "user_id")
        .writeStream.format("parquet")
        .option("path", f"{work}/out")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.parquet(f"{work}/out")


