import json

import pytest

from rosterlake.operators import requests, responses
from rosterlake.spec import RecordSpec

SPEC = RecordSpec.from_dict(
    {
        "columns": [
            {"name": "Title", "type": "extracted", "hint": "title"},
            {"name": "Full Name", "type": "extracted"},
            {"name": "Email", "type": "extracted"},
            {"name": "Institution", "type": "static", "value_from": "university_name"},
        ]
    }
)


def parse(spark, *texts):
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, response string")
    return responses.parse_responses(df)


@pytest.mark.parametrize(
    ("text", "status", "error"),
    [
        ("sorry", "no_json", "response holds no JSON"),
        ('{"records": [', "no_json", "response holds no JSON"),
        ('{"records": [}', "invalid_json", "response holds invalid JSON"),
        ('{"a": 1} and {"b": 2}', "invalid_json", "response holds invalid JSON"),
        ('{"a": 1}, {"b": 2}', "invalid_json", "response holds invalid JSON"),
        ('x {"records": [], "error": "Cloudflare"} y', "reported_error", "Cloudflare"),
        ('{"records": [], "error": null}', "ok", None),
        ('{"records": [], "error": ""}', "ok", None),
        ('{"records": [], "error": false}', "ok", None),
        ('```json\n{"records":\n []}\n```', "ok", None),
        ('{"a": 1, "a": 2}', "ok", None),
    ],
)
def test_parse_status(spark, text, status, error):
    got = parse(spark, text).first()
    assert (got["parse_status"], got["page_error"]) == (status, error)


@pytest.mark.parametrize(
    ("body", "next_page", "children"),
    [
        ({"next_page_url": " https://a/2 "}, "https://a/2", []),
        ({"next_page_url": None}, "", []),
        ({}, "", []),
        ({"child_page_urls": ["https://a/c", "/rel"]}, "", ["https://a/c", "/rel"]),
        ({"child_page_urls": "not a list"}, "", []),
        ({"child_page_urls": None}, "", []),
    ],
)
def test_links_in_responses(spark, body, next_page, children):
    got = parse(spark, json.dumps({"records": [], **body})).first()
    assert (got["next_page_url"], got["child_page_urls"]) == (next_page, children)


def test_response_links_are_http_only(spark):
    text = json.dumps({"records": [], "next_page_url": "https://a/2", "child_page_urls": ["/x", " https://a/c "]})
    got = [tuple(r) for r in responses.response_links(parse(spark, text)).collect()]
    assert got == [("u0", "https://a/2", "next", 0), ("u0", "https://a/c", "child", 1)]


@pytest.mark.parametrize(
    ("record", "want"),
    [
        ({"field_1": "Dr.", "field_2": "A", "field_3": None}, ("Dr.", "A", None)),
        ({"Title": "exact", "field_1": "alias"}, ("alias", None, None)),
        ({"field_1": "alias", "Title": "exact"}, ("alias", None, None)),
        ({"field_1": "first", "title": "last"}, ("last", None, None)),
        ({"full_name": "A", "FULL NAME": "B"}, (None, "B", None)),
        ({"Full Name": "A", "other": "x"}, (None, "A", None)),
        ({"Email": ""}, (None, None, "")),
        ({}, (None, None, None)),
    ],
)
def test_field_aliases(spark, record, want):
    df = responses.records_from_responses(parse(spark, json.dumps({"records": [record]})), SPEC)
    got = df.first()
    assert (got["Title"], got["Full Name"], got["Email"]) == want


def test_records_keep_count_profile_and_static_values(spark):
    text = json.dumps(
        {
            "static_values": {"field_3": "s@x", "Title": "Prof."},
            "records": [
                {"Profile URL": "https://p/1", "field_3": "own@x"}, {"profile_url": "none"},
                {"profile_url": None},
            ],
        }
    )
    parsed = parse(spark, text)
    rows = responses.records_from_responses(parsed, SPEC).orderBy("pos").collect()
    assert [(r["Email"], r["Title"], r["profile_url"]) for r in rows] == [
        ("own@x", "Prof.", "https://p/1"), ("s@x", "Prof.", None), ("s@x", "Prof.", None),
    ]
    plain = responses.records_from_responses(parsed, SPEC, apply_static=False)
    assert [r["Email"] for r in plain.orderBy("pos").collect()] == ["own@x", None, None]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("x", "x"), ("[x]", "[x]"), (["a", "", None, "b", 0, False, 2], "a; b; 2"), ([], ""),
        ({"k": 1}, '{"k":1}'), (True, "True"), (1.5, "1.5"), (7, "7"), (None, None), ("", ""),
        ([{"k": 1}, ["x"]], '{"k":1}; ["x"]'),
    ],
)
def test_detail_values_become_text(spark, value, want):
    text = json.dumps({"Title": value, "error": None})
    df = spark.createDataFrame([("http://p", text)], "profile_url string, response string")
    got = responses.parse_details(df, SPEC).first()
    assert (got["failed"], got["Title"]) == (False, want)


@pytest.mark.parametrize("text", ["no", '{"Title": ', '{"error": "not a profile", "Title": "x"}', '{"Title":"a"} {"Title":"b"}', None])
def test_failed_details(spark, text):
    df = spark.createDataFrame([("http://p", text)], "profile_url string, response string")
    got = responses.parse_details(df, SPEC).first()
    assert (got["failed"], got["Title"]) == (True, None)


def test_request_text(spark):
    pages = spark.createDataFrame([("https://a/1", "<p onclick='x'>hi</p><script>s</script>")], "url string, html string")
    context = spark.createDataFrame(
        [("https://a/1", ["https://a"], ["https://a/9", "https://a/1", "https://a/2"])],
        "url string, ancestors array<string>, known_urls array<string>",
    )
    prompt = requests.extraction_requests(pages, SPEC, context).first()["prompt"]
    assert "field_1: Title (title)" in prompt and "field_3: Email (no hint)" in prompt
    assert "Institution: from university_name" in prompt
    assert prompt.endswith("Reached by:\nhttps://a\nAlready known:\nhttps://a/2\nhttps://a/9\nHTML:\n<p>hi</p>")
    alone = requests.extraction_requests(pages, SPEC).first()["prompt"]
    assert alone.endswith("Reached by:\n\nAlready known:\n\nHTML:\n<p>hi</p>")


def test_search_queries(spark):
    targets = spark.createDataFrame([("HKU", "CS"), ("MIT", None)], "university string, department string")
    got = requests.search_queries(targets).orderBy("university", "query_no").collect()
    assert [r["query"] for r in got] == [
        "HKU CS faculty", "HKU CS academic staff", "HKU department of CS faculty", "HKU CS staff",
        "HKU CS professors", "MIT faculty", "MIT academic staff", "MIT staff", "MIT professors",
    ]
