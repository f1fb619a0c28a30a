import json

from rosterlake.functions import html as H
from rosterlake.operators import hits, responses
from rosterlake.plans.discovery import discover_departments, find_listing_urls

T = "university string, department string, link string, status string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_departments_are_found_and_appended(spark):
    targets = spark.createDataFrame(
        [("U", None, None, None), ("U", "Law", None, None), ("V", None, None, "Skipped"), ("W", None, None, "completed")], T
    )
    lists = [
        ("U", 1, json.dumps({"departments": ["Department of Physics", "Library", " Law "]})),
        ("U", 2, json.dumps({"departments": ["Physics, Department of", "physics", "Applied Physics"]})),
        ("V", 1, "no list"),
        ("W", 1, json.dumps({"departments": ["Art"]})),
    ]
    answers = spark.createDataFrame(lists, "university string, ord long, response string")
    got = discover_departments(targets, answers)
    assert rows(got, "university", "department", "status") == [
        ("U", "Applied Physics", None), ("U", "Law", None), ("U", "physics", None),
        ("U", None, "completed"), ("V", None, "Skipped"), ("W", None, "completed"),
    ]


def test_name_list(spark):
    df = spark.createDataFrame([('Here: ["A", "B"] or ["C"]',), ("none",), ("[1, ",)], "t string")
    got = [r["v"] for r in df.select(responses.name_list("t").alias("v")).collect()]
    assert got == [["A", "B"], None, None]


HITS = "university string, department string, query_no long, rank long, url string, domain string"


def test_best_listing_page(spark):
    targets = spark.createDataFrame([("U", "cs", None, None), ("U", "law", "nan", ""), ("U", "art", "https://a", None)], T)
    found = spark.createDataFrame(
        [
            ("U", "cs", 0, 1, "https://u.edu/", "u.edu"), ("U", "cs", 0, 2, "https://u.edu/cs/people", "u.edu"),
            ("U", "cs", 1, 1, "https://cs.u.edu/staff", "u.edu"), ("U", "cs", 1, 2, "https://fake-u.edu/people", "u.edu"),
            ("U", "law", 0, 1, "https://linkedin.com/u.edu/people", "u.edu"), ("U", "law", 0, 2, "https://other.org/staff", "u.edu"),
            ("U", "art", 0, 1, "https://u.edu/people", "u.edu"),
        ],
        HITS,
    )
    assert rows(find_listing_urls(targets, found), "department", "link", "status") == [
        ("art", "https://a", None), ("cs", "https://cs.u.edu/staff", "url-found"), ("law", "nan", ""),
    ]


def test_hits_are_combined(spark):
    found = spark.createDataFrame(
        [("t", 1, 1, "https://a"), ("t", 0, 2, "https://a"), ("t", 0, 1, "https://b"), ("t", 0, 3, ""), ("t", 0, 4, None)],
        "target string, query_no long, rank long, url string",
    )
    assert rows(hits.combine_hits(found, ["target"]), "url", "query_no", "rank") == [("https://a", 0, 2), ("https://b", 0, 1)]
    assert rows(hits.top_hits(found.where("url <> ''"), 1, query="query_no"), "url") == [("https://a",), ("https://b",)]


def test_rendered_pages_can_be_blocked_by_title(spark):
    df = spark.createDataFrame(
        [("x" * 2000, "403 Forbidden"), ("x" * 2000, "People"), ("short", "People"), (None, "People"), ("x" * 2000, None)],
        "html string, title string",
    )
    got = [r["b"] for r in df.select(H.is_blocked_render("html", "title").alias("b")).collect()]
    assert got == [True, False, True, True, False]
