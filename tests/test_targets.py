import pytest

from rosterlake.operators import links, targets
from rosterlake.sources.targets import normalize_targets, read_targets, title_headers

RAW = "`University Name` string, ` Department Name ` string, LINK string, Status string, Extra string"
T = "university string, department string, link string, status string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_reading(spark, tmp_path):
    raw = spark.createDataFrame(
        [(" HKU ", "CS", "https://a", " Done ", "e"), ("HKU", "nan", "ftp://x", "NULL", None), ("  ", "CS", None, None, None)],
        RAW,
    )
    got = normalize_targets(raw)
    assert got.columns == ["university", "department", "link", "status", "extra"]
    assert rows(got) == [("HKU", "CS", "https://a", "Done", "e"), ("HKU", None, None, None, None)]
    with pytest.raises(ValueError, match="university_name"):
        normalize_targets(raw.select("Status"))
    path = tmp_path / "t.csv"
    path.write_text("University Name,Department Name\nMIT,EECS\n,\n")
    assert rows(read_targets(spark, str(path))) == [("MIT", "EECS", None, None)]
    assert title_headers(spark.createDataFrame([("a",)], "university_name string")).columns == ["University Name"]


def test_filters(spark):
    statuses = [None, "", "Skipped", "completed", "failed: x", "url-found", "nan"]
    df = spark.createDataFrame(
        [("U", d, "https://a" if i % 2 else None, s) for d in ("D", None) for i, s in enumerate(statuses)], T
    )
    assert rows(targets.pending_targets(df), "status") == [("",), ("Skipped",), ("nan",), (None,)]
    assert targets.pending_targets(df, ("", "url-found")).count() == 3
    assert rows(targets.discovery_targets(df), "status") == [("",), ("Skipped",), (None,)]
    assert rows(targets.missing_link_targets(df), "status") == [("Skipped",), ("nan",), (None,)]
    assert targets.count_set_statuses(df).first()["n_cleared"] == 12
    assert targets.clear_statuses(df).where("status IS NOT NULL").count() == 0


def test_status_write_back(spark):
    df = spark.createDataFrame(
        [("U", "D", "old", None), ("U", "D", "old2", "x"), ("U", None, None, None), ("V", "D", "keep", "s")], T
    )
    updates = spark.createDataFrame(
        [(1, "U", "D", "running", "https://new"), (2, "U", "D", "completed", ""), (3, "U", None, "Skipped", None)],
        "seq long, " + T.replace("link string, status string", "status string, link string"),
    )
    got = rows(targets.apply_status(df, updates), "university", "department", "link", "status")
    assert got == [
        ("U", "D", "https://new", "completed"), ("U", "D", "https://new", "completed"),
        ("U", None, None, "Skipped"), ("V", "D", "keep", "s"),
    ]


def test_append(spark):
    df = spark.createDataFrame([("U", "D", "l", "s"), ("U", None, None, None)], T)
    new = spark.createDataFrame([("U", "D"), ("U", "E"), ("U", "E"), ("U", None)], "university string, department string")
    assert targets.append_targets(df, new).count() == 3
    assert targets.append_targets(df, new, dedupe=False).count() == 6


def test_mirror(spark):
    fresh = spark.createDataFrame(
        [(1, "U", "D", "a"), (2, "U", "D", "b"), (3, "U", None, "c")], "ord long, university string, department string, link string"
    )
    stored = spark.createDataFrame(
        [("U", None), ("U", None), ("U", "Gone")], "university string, department string"
    )
    actions = targets.sync_actions(stored, fresh)
    assert rows(actions, "department", "link", "action") == [
        ("D", "b", "insert"), ("Gone", None, "delete"), (None, "c", "update"),
    ]
    assert tuple(targets.sync_counts(actions).first()) == (2, 1)
    kept = actions.where("action <> 'delete'")
    assert targets.sync_counts(targets.sync_actions(kept, fresh)).first()["n_deleted"] == 0


def test_forced(spark):
    df = spark.createDataFrame([("HKU", "CS", None, None), ("HKU", "Math", None, None)], T)
    stored = spark.createDataFrame([(" CS/HKU ",)], "_source_key string")
    assert rows(targets.forced_targets(df, stored), "department", "forced") == [("CS", False), ("Math", True)]
    assert targets.forced_targets(df, stored, force=True).where("forced").count() == 2


def test_counts(spark):
    df = spark.createDataFrame(
        [("U", "a", None, None), ("U", "b", None, "Failed: x"), ("U", "c", None, "scrape ERROR"), ("U", "d", None, "Skipped"),
         ("U", "e", None, "COMPLETED"), ("U", "f", None, "url-found")], T
    )
    assert targets.target_summary(df).first().asDict() == {
        "completed": 1, "failed": 2, "skipped": 1, "pending": 2, "total": 6,
    }
    assert rows(targets.failed_targets(df), "department", "error") == [("b", "failed: x"), ("c", "scrape error")]
    assert ("pending", 1) in rows(targets.status_counts(df), "status", "n")


def test_outcomes(spark):
    df = spark.createDataFrame([(i, "U", str(i), "https://l") for i in range(7)], "target_id long, university string, department string, link string")
    pages = spark.createDataFrame(
        [
            (0, 1, 5, None, False, None), (0, 2, 3, "late error", False, None),
            (1, 1, 0, "Cloudflare", False, None), (2, 1, 0, None, True, None),
            (3, 1, 4, None, False, "x" * 200), (4, 1, 0, "", False, None),
            (6, 2, 4, "later only", False, None),
        ],
        "target_id long, page_no int, n_records long, page_error string, skipped boolean, exception string",
    )
    got = {r["target_id"]: (r["status"], r["n_records"]) for r in targets.target_outcomes(df, pages).collect()}
    assert got == {
        0: ("completed", 5), 1: ("failed: Listing page issue: Cloudflare", 0), 2: ("Skipped", 0),
        3: ("failed: " + "x" * 200, 0), 4: ("completed", 0),
        5: ("failed: No page HTML available for scraping.", 0), 6: ("completed", 0),
    }
    summary = targets.run_summary(targets.target_outcomes(df, pages)).first().asDict()
    assert summary == {"total": 7, "successful": 3, "failed": 3, "skipped": 1}


def test_departments(spark):
    df = spark.createDataFrame(
        [("Computer Science",), ("Finance",), ("IT",), ("Italian",), ("University Library",), ("Labs",), ("Graduate School",), (None,)],
        "name string",
    )
    assert rows(targets.academic_departments(df)) == [("Computer Science",), ("Italian",)]


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_series(spark, bucket):
    urls = ["https://a/l?page=1", "https://a/l?page=2", "https://a/l?page=5", "https://a/l?page=10",
            "https://a/l?page=2", "https://a/p/page/7", "https://a/A.html", "https://a/C.html", "https://a/about", "https://b/12/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["next_url"], r["gap"], r["is_last"]) for r in links.pagination_series(df, bucket).collect()}
    assert got == {
        "https://a/l?page=1": ("https://a/l?page=2", 0, False),
        "https://a/l?page=2": ("https://a/l?page=5", 2, False),
        "https://a/l?page=5": ("https://a/l?page=10", 4, False),
        "https://a/l?page=10": (None, None, True),
        "https://a/p/page/7": (None, None, True),
        "https://a/A.html": ("https://a/C.html", 1, False),
        "https://a/C.html": (None, None, True),
        "https://b/12/": (None, None, True),
    }
