import json

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import dedup, enrichment, records
from rosterlake.spec import ColumnRule, RecordSpec

SPEC = RecordSpec.from_dict(
    {
        "columns": [
            {"name": "Title", "type": "extracted", "validation": {"max_length": 5}},
            {"name": "English Full Name", "type": "extracted", "required": True},
            {"name": "Chinese Name", "type": "extracted", "validation": {"contains_cjk": True}},
            {"name": "Email", "type": "extracted", "required": True,
             "validation": {"regex": r"^[^@\s]+@[a-z.]+$", "case_insensitive": True}},
            {"name": "Page", "type": "extracted", "validation": {"url_like": True, "min_length": 10}},
            {"name": "Department", "type": "fallback", "value_from": "department"},
            {"name": "Institution", "type": "static", "value_from": "university_name"},
            {"name": "Surname", "type": "formula",
             "formula": "element_at(split([@[English Full Name]], ' '), -1)"},
        ],
        "dedup_keys": ["Email", "Title"],
    }
)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_spec_from_json_and_absent_file(tmp_path):
    assert RecordSpec.load(tmp_path / "none.json") == RecordSpec()
    path = tmp_path / "spec.json"
    path.write_text(json.dumps({"columns": [{"name": "A", "type": "extracted", "note": 1}], "dedup_keys": ["A"]}))
    spec = RecordSpec.load(path)
    assert spec.names() == ["A"] and spec.dedup_keys == ("A",)
    assert [f.name for f in spec.schema()] == ["A"]


def test_spec_fingerprint_sees_every_column():
    more = SPEC.with_column(ColumnRule("Extra", "fallback"))
    assert more.fingerprint() != SPEC.fingerprint()
    assert RecordSpec.from_dict({}).fingerprint() == RecordSpec().fingerprint()
    with pytest.raises(ValueError):
        SPEC.with_column(ColumnRule("Email", "extracted"))
    with pytest.raises(ValueError):
        ColumnRule("x", "unknown")


@pytest.mark.parametrize(
    ("column", "given", "want"),
    [
        ("Title", "Professor", ""), ("Title", "Prof.", "Prof."), ("Title", None, ""),
        ("Chinese Name", "Wang", ""), ("Chinese Name", "王 Wang", "王 Wang"), ("Chinese Name", "", ""),
        ("Email", "A@X.EDU", "A@X.EDU"), ("Email", "bad", ""), ("Email", "a@x.edu\n", "a@x.edu\n"),
        ("Email", "a@x.edu\r", ""),
        ("Page", "HTTPS://a.edu/x", "HTTPS://a.edu/x"), ("Page", "http://a", ""), ("Page", "www.a.edu/abc", ""),
    ],
)
def test_validation(spark, column, given, want):
    df = spark.createDataFrame([(given,)], f"`{column}` string")
    assert records.validate_records(df, SPEC).first()[column] == want


def test_validation_keeps_spec_columns_in_order(spark):
    df = spark.createDataFrame([("x", "a@b.c")], "other string, Email string")
    out = records.validate_records(df, SPEC)
    assert out.columns == SPEC.names()
    assert out.first()["Department"] == ""


def test_validation_report_counts_the_first_broken_rule(spark):
    df = spark.createDataFrame([("www.a",), ("http://a",), ("http://long.enough",), (None,)], "Page string")
    got = {(r["column"], r["rule"]): r["n_violations"] for r in records.validation_report(df, SPEC).collect()}
    assert got[("Page", "min_length")] == 2 and got[("Page", "url_like")] == 0
    assert records.validation_report(df, RecordSpec()).count() == 0


@pytest.mark.parametrize(
    ("given", "want"), [("Own ", "Own "), (None, "Math"), ("", "Math"), (" \t", "Math")]
)
def test_fallback_fill(spark, given, want):
    df = spark.createDataFrame(
        [("HKU", "Math", given)], "university string, department string, Unit string"
    )
    spec = RecordSpec.from_dict(
        {
            "columns": [
                {"name": "Unit", "type": "fallback", "value_from": "department"},
                {"name": "Site", "type": "fallback"},
                {"name": "Institution", "type": "static", "value_from": "university_name"},
                {"name": "Source", "type": "static", "value": "crawl"},
            ]
        }
    )
    got = records.fill_records(df, spec).first()
    assert (got["Unit"], got["Institution"], got["Source"]) == (want, "HKU", "crawl")
    assert "Site" not in got.asDict()


def test_formula(spark):
    df = spark.createDataFrame([("Ann Lee",)], "`English Full Name` string")
    assert records.apply_formulas(df, SPEC).first()["Surname"] == "Lee"
    bad = RecordSpec.from_dict({"columns": [{"name": "S", "type": "formula", "formula": "[@[None]]"}]})
    with pytest.raises(ValueError, match="unknown column"):
        records.apply_formulas(df, bad)


DEDUP = "ord long, university string, department string, Email string, Title string, Note string"


def test_duplicates_merge_first_non_empty(spark):
    df = spark.createDataFrame(
        [
            (1, "U", "D", "a@x", "Dr.", None),
            (2, "U", "D", " a@x ", "Dr.", " "),
            (3, "U", "D", "a@x", "Dr.", "late"),
            (4, "U", "D", "A@x", "Dr.", "other case"),
            (5, "U", "D", None, " ", "blank"),
            (6, "U", "D", "", None, "blank"),
            (7, "U", "D", None, "Dr.", None),
            (8, "U", "D", "", "Dr.", "partly blank"),
            (9, "U", "E", "a@x", "Dr.", "other scope"),
        ],
        DEDUP,
    )
    got = rows(dedup.merge_duplicates(df, SPEC), "ord", "Email", "Note")
    assert got == [
        (1, "a@x", "late"), (4, "A@x", "other case"), (5, None, "blank"), (6, "", "blank"),
        (7, None, "partly blank"), (9, "a@x", "other scope"),
    ]
    across = dedup.merge_duplicates(df, SPEC, scope=())
    assert rows(across, "ord") == [(1,), (4,), (5,), (6,), (7,)]
    shuffled = dedup.merge_duplicates(df.orderBy(F.desc("ord")), SPEC)
    assert rows(shuffled, "ord", "Email", "Note") == got
    report = dedup.dedup_report(df, SPEC)
    assert rows(report, "department", "n_before", "n_after") == [("D", 8, 5), ("E", 1, 1)]


def test_department_with_slash_keeps_its_scope(spark):
    df = spark.createDataFrame([(1, "U", "A/B", "a@x", "", ""), (2, "B/U", "A", "a@x", "", "")], DEDUP)
    assert dedup.merge_duplicates(df, SPEC).count() == 2


def test_names(spark):
    names = spark.createDataFrame(
        [(1, " Physics "), (2, "physics"), (3, "Department of Physics"), (4, "Physics, Department of"),
         (5, "Applied Physics"), (6, " "), (7, None), (8, "School of Computing")],
        "ord long, name string",
    )
    assert rows(dedup.distinct_names(names), "name")[0:2] == [("Applied Physics",), ("Department of Physics",)]
    assert dedup.distinct_names(names).where("name = 'Physics'").count() == 1
    kept = rows(dedup.canonical_names(names), "name", "n_spellings")
    assert kept == [("Applied Physics", 1), ("Physics", 4), ("School of Computing", 1)]
    same = spark.createDataFrame([("applied physics", "physics")], "name_key string, same_as string")
    assert rows(dedup.canonical_names(names, synonyms=same), "name_key") == [("computing",), ("physics",)]


GAPS = "ord long, _source_key string, profile_url string, Title string, Email string, Remark string"
GAP_SPEC = RecordSpec.from_dict(
    {"columns": [{"name": "Title", "type": "extracted"}, {"name": "Email", "type": "extracted", "required": True}]}
)
LOOSE = RecordSpec.from_dict(
    {"columns": [{"name": "Title", "type": "extracted"}, {"name": "Email", "type": "extracted"}]}
)


def test_enrichment_plan(spark):
    df = spark.createDataFrame(
        [
            (1, "full", "http://p/1", "Dr.", "a", None), (2, "null title", "http://p/2", None, "a", None),
            (3, "no mail", "http://p/3", "Dr.", "", None), (4, "no profile", None, None, None, None),
        ],
        GAPS,
    )
    strict = enrichment.enrichment_plan(df, GAP_SPEC)
    assert rows(strict.where("needs_detail"), "_source_key", "fields") == [("no mail", ["Email"])]
    either = enrichment.enrichment_plan(df, GAP_SPEC, any_null=True).where("needs_detail")
    assert rows(either, "_source_key") == [("no mail",), ("null title",)]
    loose = enrichment.enrichment_plan(df, LOOSE).where("needs_detail")
    assert rows(loose, "_source_key", "fields") == [("null title", ["Title"])]


def test_enrichment_fills_gaps_only(spark):
    df = spark.createDataFrame(
        [
            (1, "k", "http://p/1", None, "own@x", ""), (2, "k", "http://p/2", "", None, "seen"),
            (3, "k", "http://p/3", "", None, None), (4, "k", None, None, None, None),
        ],
        GAPS,
    )
    details = spark.createDataFrame(
        [
            ("http://p/1", False, False, "Prof.", "new@x"), ("http://p/2", True, False, "Prof.", "n@x"),
            ("http://p/3", False, True, None, None), ("http://p/1", True, False, "zzz", "zzz"),
        ],
        "profile_url string, blocked boolean, failed boolean, Title string, Email string",
    )
    got = rows(enrichment.enrich_records(df, details, GAP_SPEC), "ord", "Title", "Email", "Remark")
    assert got == [
        (1, "Prof.", "own@x", ""),
        (2, "", None, "seen; Detail page unreachable: http://p/2"),
        (3, "", None, "LLM extraction failed for: http://p/3"),
        (4, None, None, None),
    ]


def test_null_and_empty_counts(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("x", "c")], "Title string, Email string")
    assert rows(enrichment.field_null_counts(df, ["Title", "Email"]), "field", "n_null") == [("Email", 0), ("Title", 1)]
    assert rows(enrichment.field_empty_any(df, ["Title", "Email"]), "field", "any_empty") == [
        ("Email", False), ("Title", True)
    ]
    assert enrichment.field_empty_any(df.limit(0), ["Title"]).first()["any_empty"] is False


def test_results_filter(spark):
    df = spark.createDataFrame(
        [("k", "A", "HKU", "CS"), ("k", "nan", "hku ", "CS"), ("k", "", None, None), ("k", "B", "CUHK", "Math")],
        "_source_key string, Name string, Institution string, Department string",
    )
    only = records.results_filtered(df, university=" hku")
    assert [r["record"] for r in only.collect()] == [{"Name": "A", "Institution": "HKU", "Department": "CS"}]
    assert records.results_filtered(df, department="MATH").count() == 1
    assert records.results_filtered(df).count() == 3
