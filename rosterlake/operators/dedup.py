"""Merging duplicate records and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..spec import RecordSpec, col


def merge_duplicates(
    records: DataFrame,
    spec: RecordSpec,
    scope: tuple[str, ...] = ("university", "department"),
    order: str = "ord",
) -> DataFrame:
    """One row per scope and dedup key values; the first non-empty value wins.

    Keys are compared stripped and case-sensitive. Rows with all keys blank stay
    apart (their ``order`` joins the key); partly blank keys still group. The
    merged row keeps the lowest ``order``. With ``scope=()`` duplicates are
    merged across all scopes. All aggregates combine map-side, so a key that
    holds very many rows sends one partial row per task.
    """
    if not spec.dedup_keys:
        return records
    stripped = [X.strip(X.or_empty(col(k))) for k in spec.dedup_keys]
    keys = [s.alias(f"_k{i}") for i, s in enumerate(stripped)]
    all_blank = F.concat(*stripped) == ""
    apart = F.when(all_blank, F.col(order)).alias("_apart")
    grouped = [*[col(s) for s in scope], *keys, apart]
    values = [c for c in records.columns if c not in (*scope, order)]
    merged = records.groupBy(*grouped).agg(
        F.min(order).alias(order),
        *[_first_value(col(c), col(order)).alias(c) for c in values],
    )
    return merged.select(*[col(c) for c in records.columns])


def _first_value(value: Column, order: Column) -> Column:
    """First non-blank value by order, else the first one (NULL or blank)."""
    return F.min_by(value, F.struct(X.is_blank(value), order))


def dedup_report(
    records: DataFrame,
    spec: RecordSpec,
    scope: tuple[str, ...] = ("university", "department"),
    order: str = "ord",
) -> DataFrame:
    """Rows per scope before and after merging, counted on the keys alone."""
    stripped = [X.strip(X.or_empty(col(k))) for k in spec.dedup_keys]
    all_blank = F.concat(*stripped) == ""
    keys = [s.alias(f"_k{i}") for i, s in enumerate(stripped)]
    apart = F.when(all_blank, F.col(order)).alias("_apart")
    per_key = records.groupBy(*[col(s) for s in scope], *keys, apart).agg(
        F.count("*").alias("n")
    )
    return per_key.groupBy(*[col(s) for s in scope]).agg(
        F.sum("n").alias("n_before"), F.count("*").alias("n_after")
    )


def distinct_names(
    names: DataFrame, name: str = "name", scope: tuple[str, ...] = (), order: str = "ord"
) -> DataFrame:
    """Names that differ by case or outer spaces once, first spelling kept."""
    s = X.strip(name)
    return (
        names.where(~X.is_blank(name))
        .groupBy(*scope, F.lower(s).alias("_key"))
        .agg(F.min(F.struct(F.col(order), s.alias("n"))).alias("_first"))
        .select(*scope, F.col("_first.n").alias(name), F.col(f"_first.{order}").alias(order))
    )


_UNIT = "(?:department|dept\\.?|school|faculty|division|institute) of"
_UNIT_AFTER = ", (?:department|dept\\.?|school|faculty|division|institute) of"


def canonical_name_key(name: Column | str) -> Column:
    """"X, Department of", "Department of X" and "X" share one key."""
    k = F.regexp_replace(F.lower(X.strip(name)), "[ \t]+", " ")
    k = F.regexp_replace(k, rf"{_UNIT_AFTER}$", "")
    return X.strip(F.regexp_replace(k, rf"^{_UNIT} ", ""))


def canonical_names(
    names: DataFrame,
    name: str = "name",
    scope: tuple[str, ...] = (),
    synonyms: DataFrame | None = None,
) -> DataFrame:
    """One name per group of spellings, the shortest (then the smallest) kept.

    ``synonyms(name_key, same_as)`` maps further keys onto each other.
    """
    keyed = names.where(~X.is_blank(name)).select(
        *scope, X.strip(name).alias(name), canonical_name_key(name).alias("name_key")
    )
    if synonyms is not None:
        keyed = keyed.join(synonyms, "name_key", "left").withColumn(
            "name_key", F.coalesce("same_as", "name_key")
        )
    shortest = F.min(F.struct(F.length(name).alias("len"), F.col(name).alias("n")))
    return (
        keyed.groupBy(*scope, "name_key")
        .agg(shortest.alias("_s"), F.count("*").alias("n_spellings"))
        .select(*scope, "name_key", F.col("_s.n").alias(name), "n_spellings")
    )
