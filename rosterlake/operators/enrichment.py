"""Gaps in records and filling them from detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import add_remark, or_empty
from ..spec import RecordSpec, col


def _as_rows(counts: DataFrame, keys: list[str], fields: list[str], value: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias(value))
            for i, f in enumerate(fields)
        ]
    )
    return counts.select(*keys, F.inline(pairs))


def field_null_counts(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_null) over all records."""
    counts = records.agg(
        *[F.count_if(col(f).isNull()).alias(f"_f{i}") for i, f in enumerate(fields)]
    )
    return _as_rows(counts, [], fields, "n_null")


def field_empty_any(records: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """(field, any_empty): is the field NULL or "" in any record of the group?"""
    keys = by or []
    flags = [
        F.coalesce(F.bool_or(or_empty(col(f)) == ""), F.lit(False)).alias(f"_f{i}")
        for i, f in enumerate(fields)
    ]
    counts = records.groupBy(*keys).agg(*flags) if keys else records.agg(*flags)
    return _as_rows(counts, keys, fields, "any_empty")


def enrichment_plan(
    records: DataFrame,
    spec: RecordSpec,
    group: str = "_source_key",
    any_null: bool = False,
    profile: str = "profile_url",
) -> DataFrame:
    """(group, n_records, n_with_profile, needs_detail, fields) per group.

    With required columns a group needs detail pages when any of them is NULL or
    "" anywhere in it, otherwise when any field is NULL; ``any_null`` makes a
    NULL count in both cases. Without a profile link there is nothing to visit.
    ``fields`` are those NULL or "" somewhere in the group, in spec order.
    """
    names = [c.name for c in spec.extractable()]
    required = [n for n in spec.required() if n in names]
    stats = records.groupBy(group).agg(
        F.count("*").alias("n_records"),
        F.count_if(F.coalesce(F.col(profile).startswith("http"), F.lit(False))).alias(
            "n_with_profile"
        ),
        *[F.bool_or(col(n).isNull()).alias(f"_n{i}") for i, n in enumerate(names)],
        *[F.bool_or(or_empty(col(n)) == "").alias(f"_e{i}") for i, n in enumerate(names)],
    )
    some_null = F.greatest(*[F.col(f"_n{i}") for i in range(len(names))], F.lit(False))
    if required:
        gate = F.greatest(
            *[F.col(f"_e{names.index(r)}") for r in required], F.lit(False)
        )
        gate = gate | some_null if any_null else gate
    else:
        gate = some_null
    empty = F.array(*[F.when(F.col(f"_e{i}"), F.lit(n)) for i, n in enumerate(names)])
    return stats.select(
        group,
        "n_records",
        "n_with_profile",
        (gate & (F.col("n_with_profile") > 0)).alias("needs_detail"),
        F.array_compact(empty).alias("fields"),
    )


def spread_null_keys(df: DataFrame, key: str, spread_by: str, alias: str) -> DataFrame:
    """A join key in which rows without a key do not all hash to one task."""
    apart = F.concat(F.lit("\u0000"), (F.xxhash64(spread_by) % 4096).cast("string"))
    return df.withColumn(alias, F.coalesce(F.col(key), apart))


def enrich_records(
    records: DataFrame,
    details: DataFrame,
    spec: RecordSpec,
    remark: str = "Remark",
    order: str = "ord",
    profile: str = "profile_url",
) -> DataFrame:
    """Fill NULL and "" fields from the detail row of the record's profile page.

    ``details`` has the fields, ``blocked`` and ``failed`` per profile page; of
    several rows for a page a usable one counts. A record value that is present
    is kept; a remark is added when the page was blocked or its response failed.
    Pass only the details of groups the enrichment plan selects.
    """
    names = [c.name for c in spec.extractable() if c.name in details.columns]
    is_blocked = F.coalesce("blocked", F.lit(False))
    is_failed = F.coalesce("failed", F.lit(False))
    row = F.struct(
        (~is_blocked & ~is_failed).alias("_usable"),
        is_blocked.alias("_blocked"),
        is_failed.alias("_failed"),
        *[col(n).alias(f"_d{i}") for i, n in enumerate(names)],
    )
    # grouped by the join key, so the join needs no second shuffle of it
    seen = details.groupBy(F.col(profile).alias("_key")).agg(F.max(row).alias("_row"))
    seen = seen.select("_key", "_row.*")
    joined = spread_null_keys(records, profile, order, "_key").join(seen, "_key", "left")
    blocked = F.coalesce("_blocked", F.lit(False))
    failed = F.coalesce("_failed", F.lit(False))
    usable = F.coalesce("_usable", F.lit(False))
    message = F.when(
        blocked, F.concat(F.lit(fv.REMARK_BLOCKED), F.col(profile))
    ).when(failed, F.concat(F.lit(fv.REMARK_FAILED), F.col(profile)))
    out = []
    for name in records.columns:
        value = col(name)
        if name in names:
            detail = F.when(usable, F.nullif(F.col(f"_d{names.index(name)}"), F.lit("")))
            value = F.when(or_empty(value) == "", F.coalesce(detail, value)).otherwise(value)
        if name == remark:
            value = F.when(message.isNotNull(), add_remark(value, message)).otherwise(value)
        out.append(value.alias(name))
    return joined.select(*out)


def error_budget(
    details: DataFrame, group: str = "_source_key", budget: int = fv.ERROR_BUDGET
) -> DataFrame:
    """(group, n_pages, n_errors, over_budget): groups to stop visiting."""
    error = F.coalesce("blocked", F.lit(False)) | F.coalesce("failed", F.lit(False))
    return (
        details.groupBy(group)
        .agg(F.count("*").alias("n_pages"), F.count_if(error).alias("n_errors"))
        .withColumn("over_budget", F.col("n_errors") >= budget)
    )
