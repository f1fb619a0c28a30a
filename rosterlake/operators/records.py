"""Record columns: fill rules, validation, formulas, role filter, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import SOURCE_KEY, source_key
from ..spec import METADATA, RecordSpec, col, formula_expression


def _have(df: DataFrame, name: str) -> Column:
    return col(name) if name in df.columns else F.lit(None).cast("string")


def validate_records(
    records: DataFrame, spec: RecordSpec, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Spec columns in spec order, NULL as "", values that break a rule as ""."""
    return records.select(
        *keep, *[c.validated(_have(records, c.name)).alias(c.name) for c in spec.columns]
    )


def validation_report(records: DataFrame, spec: RecordSpec) -> DataFrame:
    """(column, rule, n_violations) for every declared rule, in one pass.

    A value counts for the first rule it breaks. Counts are taken as columns of
    one aggregate and turned into rows afterwards, so rows are not multiplied.
    """
    first = {
        c.name: c.first_violation(F.coalesce(_have(records, c.name), F.lit("")))
        for c in spec.columns
        if c.validation
    }
    labels = list(first)
    if not labels:
        return records.limit(0).select(
            F.lit("").alias("column"), F.lit("").alias("rule"), F.lit(0).cast("bigint").alias("n_violations")
        )
    marked = records.select(*[first[n].alias(f"_v{i}") for i, n in enumerate(labels)])
    rules = [
        (i, name, rule)
        for i, name in enumerate(labels)
        for rule, _ in spec.column(name).validation.violations(F.lit(""))
    ]
    counts = marked.agg(
        *[F.count_if(F.col(f"_v{i}") == rule).alias(f"_n{k}") for k, (i, _, rule) in enumerate(rules)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(rule).alias("rule"),
                F.col(f"_n{k}").alias("n_violations"),
            )
            for k, (_, name, rule) in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


# Columns the metadata is in. Column names ignore case, so a spec with a column
# "Department" needs other names, such as META_COLUMNS.
PLAIN_COLUMNS = ("university", "department", "listing_url")
META_COLUMNS = ("_university", "_department", "_listing_url")


def fill_records(
    records: DataFrame, spec: RecordSpec, meta_columns: tuple[str, str, str] = PLAIN_COLUMNS
) -> DataFrame:
    """Static columns from value or metadata; fallback columns where blank.

    Metadata comes from ``meta_columns`` of the same rows. A fallback value that
    is present stays unstripped.
    """
    meta = {name: _have(records, c) for name, c in zip(METADATA, meta_columns, strict=True)}
    filled: dict[str, Column] = {}
    for c in spec.of_kind("static"):
        if c.value_from in meta:
            filled[c.name] = meta[c.value_from]
        elif c.value is not None:
            filled[c.name] = F.lit(str(c.value))
    for c in spec.of_kind("fallback"):
        if c.value_from in meta:
            own = _have(records, c.name)
            filled[c.name] = F.when(X.is_blank(own), meta[c.value_from]).otherwise(own)
    kept = [col(n) for n in records.columns if n not in filled]
    return records.select(*kept, *[v.alias(n) for n, v in filled.items()])


def with_target_metadata(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds university, department and listing_url of the target a record is from.

    ``records`` carries target_id. The size of the target side is left to
    adaptive execution, which broadcasts it only when it measures small.
    """
    meta = targets.select(
        "target_id", "university", "department", F.col("link").alias("listing_url")
    )
    return records.join(meta, "target_id", "left")


def apply_formulas(records: DataFrame, spec: RecordSpec) -> DataFrame:
    known = [n for n in records.columns]
    out = {
        c.name: formula_expression(c.formula or "''", known) for c in spec.of_kind("formula")
    }
    kept = [col(n) for n in records.columns if n not in out]
    return records.select(*kept, *[v.alias(n) for n, v in out.items()])


def role_filtered(records: DataFrame, position: str = "position") -> DataFrame:
    return records.where(X.has_included_role(position))


def export_rows(
    records: DataFrame, spec: RecordSpec, meta_columns: tuple[str, str, str] = PLAIN_COLUMNS
) -> DataFrame:
    """Source key first, then the spec columns in order; NULL becomes ""."""
    university, department, _ = meta_columns
    return records.select(
        source_key(university, department).alias(SOURCE_KEY),
        *[X.or_empty(_have(records, n)).alias(n) for n in spec.names()],
    )


def json_rows(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row without the NULL fields."""
    return rows.select(F.to_json(F.struct(*[col(c) for c in rows.columns])).alias(name))


def results_filtered(
    rows: DataFrame,
    university: str | None = None,
    department: str | None = None,
    institution_column: str = "Institution",
    department_column: str = "Department",
) -> DataFrame:
    """Non-empty fields per row as a map, for one institution and department."""

    def same(name: str, wanted: str) -> Column:
        return F.lower(X.or_empty(_have(rows, name))) == wanted.strip().lower()

    out = rows
    if university and university.strip():
        out = out.where(same(institution_column, university))
    if department and department.strip():
        out = out.where(same(department_column, department))
    shown = [c for c in rows.columns if c != SOURCE_KEY]
    fields = F.create_map(*[x for c in shown for x in (F.lit(c), col(c))])
    present = F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin("", "nan", "None"))
    return out.select(present.alias("record")).where(F.size("record") > 0)


def number_rows(rows: DataFrame, scope: tuple[str, ...], order: tuple[str, ...], name: str = "row_no") -> DataFrame:
    """Number the rows of each scope from 1, as they stand in its part of the output."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*scope).orderBy(*order)).cast("bigint"))
