"""Extraction responses: free text with one JSON object, to records and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, or_empty, snake, strip
from ..spec import RecordSpec

_LISTING = (
    "records array<map<string,string>>, static_values map<string,string>, "
    "error string, next_page_url string, child_page_urls string"
)


def json_object_text(text: Column | str) -> Column:
    """From the first "{" to the last "}"; NULL when there is none."""
    found = F.regexp_extract(as_col(text), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def is_one_json_object(block: Column) -> Column:
    """Valid JSON with nothing after the object (wrapped, it is one element)."""
    wrapped = F.concat(F.lit("["), block, F.lit("]"))
    return F.coalesce(F.json_array_length(wrapped) == 1, F.lit(False))


def _status(block: Column, error: Column) -> Column:
    return (
        F.when(block.isNull(), "no_json")
        .when(~is_one_json_object(block), "invalid_json")
        .when(or_empty(error) != "", "reported_error")
        .otherwise("ok")
    )


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Adds parse_status, page_error, records, static_values, next_page_url and
    child_page_urls. Missing JSON, invalid JSON and a reported error differ.
    """
    df = responses.withColumn("_block", json_object_text(text))
    df = df.withColumn("_j", F.from_json("_block", _LISTING))
    error = F.when(~F.col("_j.error").isin("", "false", "0", "[]", "{}"), F.col("_j.error"))
    df = df.withColumn("parse_status", _status(F.col("_block"), error))
    valid = F.col("parse_status").isin("ok", "reported_error")
    children = F.coalesce(
        F.from_json("_j.child_page_urls", "array<string>"), F.array().cast("array<string>")
    )
    page_error = (
        F.when(F.col("parse_status") == "no_json", "response holds no JSON")
        .when(F.col("parse_status") == "invalid_json", "response holds invalid JSON")
        .otherwise(error)
    )
    return df.select(
        *[c for c in responses.columns if c != text],
        "parse_status",
        page_error.alias("page_error"),
        F.when(valid, F.col("_j.records")).alias("records"),
        F.when(valid, F.col("_j.static_values")).alias("static_values"),
        F.when(valid, strip(or_empty("_j.next_page_url"))).alias("next_page_url"),
        F.when(valid, children).alias("child_page_urls"),
    )


def response_links(parsed: DataFrame, url: str = "url") -> DataFrame:
    """links(src, dst, kind, pos) from parsed responses, http only."""
    as_links = F.concat(
        F.array(
            F.struct(
                F.col("next_page_url").alias("dst"),
                F.lit("next").alias("kind"),
                F.lit(0).cast("bigint").alias("pos"),
            )
        ),
        F.transform(
            F.col("child_page_urls"),
            lambda u, i: F.struct(
                strip(u).alias("dst"), F.lit("child").alias("kind"), i.cast("bigint").alias("pos")
            ),
        ),
    )
    return (
        parsed.where(F.col("parse_status") == "ok")
        .select(F.col(url).alias("src"), F.explode(as_links).alias("l"))
        .select("src", "l.dst", "l.kind", "l.pos")
        .where(F.col("dst").startswith("http"))
    )


def department_names(
    answers: DataFrame, keep: list[str], text: str = "response"
) -> DataFrame:
    """(keep..., pos, name) from responses that list departments.

    The list is the ``departments`` of the JSON object; a response that is not
    valid, or lists none, gives no rows.
    """
    block = json_object_text(text)
    listed = F.from_json(F.from_json("_block", "departments string")["departments"], "array<string>")
    return (
        answers.select(*keep, block.alias("_block"))
        .where(is_one_json_object(F.col("_block")))
        .select(*keep, F.posexplode(listed).alias("pos", "name"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


def name_list(text: Column | str) -> Column:
    """First JSON array of texts in a response; NULL when there is none."""
    found = F.regexp_extract(as_col(text), r"(?s)\[.*?\]", 0)
    return F.when(found != "", F.from_json(found, "array<string>"))


def field_value(entries: Column, index: int, name: str) -> Column:
    """Value of a spec column in a record's (key, value) entries.

    An alias (``field_N`` or the snake-case name, any case) wins over the exact
    name, the last alias in the record over earlier ones; absent gives NULL.
    """
    aliases = (f"field_{index}", name.lower().replace(" ", "_"))
    by_alias = F.filter(
        entries, lambda e: snake(e["key"]).isin(*aliases) & (e["key"] != F.lit(name))
    )
    by_name = F.filter(entries, lambda e: e["key"] == F.lit(name))
    return F.when(F.size(by_alias) > 0, F.try_element_at(by_alias, F.lit(-1))["value"]).otherwise(
        F.try_element_at(by_name, F.lit(-1))["value"]
    )


def records_from_responses(
    parsed: DataFrame, spec: RecordSpec, url: str = "url", apply_static: bool = True
) -> DataFrame:
    """One row per record: url, pos, the extractable columns and profile_url.

    With ``apply_static`` a page's static values fill record values that are
    NULL; the record's own values win.
    """
    rows = parsed.where(F.col("parse_status") == "ok").select(
        F.col(url).alias("url"),
        F.map_entries("static_values").alias("_static"),
        F.posexplode("records").alias("pos", "_record"),
    )
    rows = rows.select("url", "pos", "_static", F.map_entries("_record").alias("_entries"))
    values = []
    for i, rule in enumerate(spec.extractable(), 1):
        value = field_value(F.col("_entries"), i, rule.name)
        if apply_static:
            value = F.coalesce(value, field_value(F.col("_static"), i, rule.name))
        values.append(value.alias(rule.name))
    profile = F.filter(
        F.col("_entries"),
        lambda e: (snake(e["key"]) == "profile_url") & e["value"].startswith("http"),
    )
    return rows.select(
        "url",
        F.col("pos").cast("bigint").alias("pos"),
        *values,
        F.try_element_at(profile, F.lit(1))["value"].alias("profile_url"),
    )


def coerce_value(value: Column) -> Column:
    """Text of a JSON value held as variant: lists joined, objects as JSON text.

    Empty items of a list (null, "", 0, false, [], {}) are left out. JSON null
    gives "", SQL NULL (absent) stays NULL.
    """
    kind = F.schema_of_variant(value)

    def scalar_text(v: Column) -> Column:
        k = F.schema_of_variant(v)
        return (
            F.when(k == "BOOLEAN", F.initcap(F.to_json(v)))
            .when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(v))
            .otherwise(F.try_variant_get(v, "$", "string"))
        )

    items = F.filter(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v: v.isNotNull() & ~F.to_json(v).isin("null", '""', "0", "false", "[]", "{}", "0.0"),
    )
    return (
        F.when(kind.startswith("ARRAY"), F.array_join(F.transform(items, scalar_text), "; "))
        .when(kind.startswith("OBJECT"), F.to_json(value))
        .when(kind == "VOID", "")
        .otherwise(scalar_text(value))
    )


def parse_details(
    responses: DataFrame, spec: RecordSpec, url: str = "profile_url", text: str = "response"
) -> DataFrame:
    """Detail responses to one row per profile page with coerced values.

    ``failed`` marks responses without usable JSON or with a reported error;
    their values are NULL, as are JSON nulls.
    """
    df = responses.select(url, json_object_text(text).alias("_block"))
    df = df.withColumn("_m", F.from_json("_block", "map<string,variant>"))
    error = F.to_json(F.try_element_at("_m", F.lit("error")))
    failed = ~is_one_json_object(F.col("_block")) | ~F.coalesce(
        error.isin("null", '""', "false", "0", "[]", "{}"), F.lit(True)
    )
    df = df.withColumn("failed", F.coalesce(failed, F.lit(True)))

    def value(name: str) -> Column:
        v = F.try_element_at("_m", F.lit(name))
        found = F.when(~F.is_variant_null(v), coerce_value(v))
        return F.when(~F.col("failed"), found).alias(name)

    return df.select(url, "failed", *[value(c.name) for c in spec.extractable()])

