"""Text requests for an offline extraction batch, one row per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import html as H
from ..functions.text import is_blank, or_empty
from ..spec import RecordSpec


def field_list(spec: RecordSpec, names: list[str] | None = None) -> str:
    return "\n".join(
        f"field_{i}: {c.name} ({c.hint or 'no hint'})"
        for i, c in enumerate(spec.extractable(), 1)
        if names is None or c.name in names
    )


def static_list(spec: RecordSpec) -> str:
    return "\n".join(f"{c.name}: from {c.value_from or 'value'}" for c in spec.of_kind("static"))


def extraction_requests(
    pages: DataFrame,
    spec: RecordSpec,
    context: DataFrame | None = None,
    cleaned: bool = False,
) -> DataFrame:
    """(url, prompt, prompt_hash) for listing pages.

    ``context(url, ancestors, known_urls)`` adds the chain a page was reached by
    and the URLs already known; the page itself is left out of the latter.
    """
    body = F.col("html") if cleaned else H.clean("html")
    rows = pages.select("url", body.alias("_body"))
    if context is None:
        chain, known = F.lit(""), F.lit("")
    else:
        rows = rows.join(context.select("url", "ancestors", "known_urls"), "url", "left")
        chain = F.coalesce(F.array_join("ancestors", "\n"), F.lit(""))
        others = F.sort_array(F.array_distinct(F.array_remove("known_urls", F.col("url"))))
        known = F.coalesce(F.array_join(others, "\n"), F.lit(""))
    prompt = F.concat(
        F.lit("Page: "),
        F.col("url"),
        F.lit(f"\nFields:\n{field_list(spec)}\nFilled elsewhere:\n{static_list(spec)}\nReached by:\n"),
        chain,
        F.lit("\nAlready known:\n"),
        known,
        F.lit("\nHTML:\n"),
        F.col("_body"),
    )
    return rows.select("url", prompt.alias("prompt")).withColumn(
        "prompt_hash", F.sha2("prompt", 256)
    )


def detail_requests(records: DataFrame, plan: DataFrame, spec: RecordSpec) -> DataFrame:
    """One request per profile page of the groups to enrich.

    ``plan(_source_key, needs_detail, fields)`` is the enrichment plan; fields
    come in spec order with their hints.
    """
    hints = F.create_map(
        *[F.lit(x) for c in spec.extractable() for x in (c.name, c.hint or "no hint")]
    )
    lines = F.transform(
        F.col("fields"), lambda f: F.concat(f, F.lit(": "), F.try_element_at(hints, f))
    )
    wanted = plan.where("needs_detail").select("_source_key", lines.alias("_lines"))
    return (
        records.where(F.col("profile_url").startswith("http"))
        .select("_source_key", "profile_url")
        .distinct()
        .join(wanted, "_source_key")
        .withColumn(
            "prompt",
            F.concat(
                F.lit("Profile: "),
                F.col("profile_url"),
                F.lit("\nMissing fields:\n"),
                F.array_join("_lines", "\n"),
            ),
        )
        .select("_source_key", "profile_url", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))
    )


def search_queries(targets: DataFrame) -> DataFrame:
    """(university, department, query_no, query), in fixed order per target."""

    def texts(templates) -> Column:
        def one(template: str) -> Column:
            filled = F.replace(F.lit(template), F.lit("{u}"), F.col("university"))
            return F.replace(filled, F.lit("{d}"), or_empty("department"))

        return F.array(*[one(t) for t in templates])

    queries = F.when(is_blank("department"), texts(fv.QUERIES_WITHOUT_DEPARTMENT)).otherwise(
        texts(fv.QUERIES_WITH_DEPARTMENT)
    )
    return targets.select(
        "university", "department", F.posexplode(queries).alias("query_no", "query")
    ).withColumn("query_no", F.col("query_no").cast("bigint"))
