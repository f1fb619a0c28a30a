"""Finding departments and listing pages for targets that lack them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as X
from ..operators import dedup, hits, links, responses, targets


def discover_departments(
    target_rows: DataFrame, answers: DataFrame, synonyms: DataFrame | None = None
) -> DataFrame:
    """Targets with the departments found for organisations that had none.

    ``answers(university, ord, response)`` are the responses for the listing
    pages of an organisation, in page order. Names are filtered to academic
    departments, then spellings of one name are merged. An organisation is
    completed only when something was found for it.
    """
    names = responses.department_names(answers, ["university", "ord"])
    placed = names.select("university", F.struct("ord", "pos").alias("ord"), "name")
    academic = targets.academic_departments(dedup.distinct_names(placed, scope=("university",)))
    found = dedup.canonical_names(academic, scope=("university",), synonyms=synonyms)
    asked = targets.discovery_targets(target_rows).select("university").distinct()
    new = found.join(asked, "university", "left_semi").select(
        "university", F.col("name").alias("department")
    )
    nothing = F.lit(None).cast("string")
    updates = new.select("university").distinct().select(
        "university",
        nothing.alias("department"),
        F.lit(fv.STATUS_COMPLETED).alias("status"),
        nothing.alias("link"),
        F.lit(0).alias("seq"),
    )
    return targets.append_targets(targets.apply_status(target_rows, updates), new)


def find_listing_urls(target_rows: DataFrame, hit_rows: DataFrame) -> DataFrame:
    """Targets with the best listing page among their search hits.

    ``hit_rows(university, department, query_no, rank, url, domain)``. Blocked
    hosts are dropped and the hits of all queries are ranked together, every one of them. A target without a usable hit stays as it is.
    """
    key = ["university", "department"]
    open_targets = targets.missing_link_targets(target_rows).select(*key).distinct()
    mine = links.allowed_urls(hit_rows).join(open_targets, key, "left_semi")
    best = hits.best_listing_url(
        mine.withColumn("_dept", X.or_empty("department")), key, "domain", "_dept"
    )
    updates = best.select(
        *key,
        F.lit(fv.STATUS_URL_FOUND).alias("status"),
        F.col("listing_url").alias("link"),
        F.lit(0).alias("seq"),
    )
    return targets.apply_status(target_rows, updates)
