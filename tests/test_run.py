import json

from rosterlake.functions.html import is_blocked
from rosterlake.plans.roster_run import RosterStore, finish_run, plan_run, run
from rosterlake.spec import RecordSpec

SPEC = RecordSpec.from_dict(
    {
        "columns": [
            {"name": "Title", "type": "extracted", "validation": {"max_length": 6}},
            {"name": "Name", "type": "extracted"},
            {"name": "Email", "type": "extracted", "required": True},
            {"name": "Department", "type": "fallback", "value_from": "department"},
            {"name": "Institution", "type": "static", "value_from": "university_name"},
            {"name": "Listing", "type": "static", "value_from": "listing_url"},
        ],
        "dedup_keys": ["Email"],
    }
)
T = "university string, department string, link string, status string"
A, A2, B, C = ("https://u.edu/" + p for p in ("a", "a2", "b", "c"))


def page(body):
    return f"<html><body>{body}</body></html>"


def answer(records, **more):
    return "Sure: " + json.dumps({"records": records, **more})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_incremental_runs(spark, tmp_path):
    store = RosterStore(spark, str(tmp_path / "roster"), SPEC)
    targets = spark.createDataFrame(
        [("U", "Physics", A, None), ("U", "Math", B, ""), ("U", "Law", C, None), ("U", "Old", A, "completed"), ("U", "Art", None, None)], T
    )
    pages = [(A, page("one")), (A2, page("two")), (B, page("three")), (C, page("four"))]
    first_answers = [
        (A, answer([{"field_1": "Prof.", "Name": "Ann", "Email": None, "profile_url": "https://p/1"},
                    {"Title": "too long title", "Name": "Bob", "email": "b@u.edu"}], next_page_url=A2)),
        (A2, answer([{"Name": "", "Email": " b@u.edu", "Title": "Dr."}, {"Name": "Cyd", "Email": "", "Department": "Optics"}])),
        (B, answer([{"Name": "Dan", "Email": "d@u.edu"}])),
        (C, "no json here"),
    ]
    details = spark.createDataFrame(
        [("https://p/1", "ann@u.edu", False, False)], "profile_url string, Email string, blocked boolean, failed boolean"
    )

    def frames(page_rows, answers):
        return (
            spark.createDataFrame(page_rows, "url string, html string"),
            spark.createDataFrame(answers, "url string, response string"),
        )

    result = run(store, 1, targets, *frames(pages, first_answers), details, first_run=True)
    assert rows(result.targets, "department", "status") == [
        ("Art", "failed: No page HTML available for scraping."),
        ("Law", "failed: Listing page issue: response holds no JSON"),
        ("Math", "completed"), ("Old", "completed"), ("Physics", "completed"),
    ]
    current = rows(store.records.current(), "_source_key", "Title", "Name", "Email", "Department", "Institution", "Listing")
    assert current == [
        ("Math/U", "", "Dan", "d@u.edu", "Math", "U", B),
        ("Physics/U", "", "Cyd", "", "Optics", "U", A),
        ("Physics/U", "Dr.", "Bob", "b@u.edu", "Physics", "U", A),
        ("Physics/U", "Prof.", "Ann", "ann@u.edu", "Physics", "U", A),
    ]

    # Math is unchanged and skipped, Physics changes on its second page, Law has
    # no stored rows and so is not skipped although its page is the same
    again = spark.createDataFrame([("U", "Physics", A, None), ("U", "Math", B, "Skipped"), ("U", "Law", C, None)], T)
    pages[1] = (A2, page("two, changed"))
    answers = [first_answers[0], (A2, answer([])), (B, answer([])), (C, answer([{"Name": "Eve", "Email": "e@u.edu"}]))]
    for _ in range(2):  # a retry gives the same result
        result = run(store, 2, again, *frames(pages, answers))
        assert rows(result.outcomes, "department", "status", "n_records") == [
            ("Law", "completed", 1), ("Math", "Skipped", 0), ("Physics", "completed", 2),
        ]
        assert rows(store.records.current(), "_source_key", "Name", "Email") == [
            ("Law/U", "Eve", "e@u.edu"), ("Math/U", "Dan", "d@u.edu"), ("Physics/U", "Ann", ""), ("Physics/U", "Bob", "b@u.edu"),
        ]


def frames(spark, page_rows, answers):
    return (
        spark.createDataFrame(page_rows, "url string, html string"),
        spark.createDataFrame(answers, "url string, response string"),
    )


def store_at(spark, tmp_path):
    return RosterStore(spark, str(tmp_path / "roster"), SPEC)


def names(store):
    return sorted(r["Name"] for r in store.records.current().collect())


def person(name):
    return {"Name": name, "Email": f"{name.lower()}@u.edu"}


def test_targets_of_one_key_are_all_kept(spark, tmp_path):
    store = store_at(spark, tmp_path)
    targets = spark.createDataFrame([("U", "Phys", A, None), ("U", "Phys", B, None)], T)
    pages = frames(spark, [(A, page("a")), (B, page("b"))], [(A, answer([person("Ann")])), (B, answer([person("Bob")]))])
    result = run(store, 1, targets, *pages, first_run=True)
    assert names(store) == ["Ann", "Bob"]
    assert rows(result.targets, "link", "status") == [(A, "completed"), (B, "completed")]
    # only one of the two pages changes: the other's stored response still counts
    pages = frames(spark, [(A, page("a")), (B, page("b, new"))], [(B, answer([person("Bea")]))])
    run(store, 2, targets, *pages)
    assert names(store) == ["Ann", "Bea"]


def test_change_while_target_was_not_processed(spark, tmp_path):
    store = store_at(spark, tmp_path)
    open_ = spark.createDataFrame([("U", "Phys", A, None)], T)
    done = spark.createDataFrame([("U", "Phys", A, "completed")], T)
    run(store, 1, open_, *frames(spark, [(A, page("one"))], [(A, answer([person("Ann")]))]), first_run=True)
    run(store, 2, done, *frames(spark, [(A, page("two"))], [(A, answer([person("Bob")]))]))
    assert names(store) == ["Ann"]
    result = run(store, 3, open_, *frames(spark, [(A, page("two"))], [(A, answer([person("Bob")]))]))
    assert names(store) == ["Bob"] and rows(result.outcomes, "status") == [("completed",)]


def test_failed_target_is_not_skipped_next_time(spark, tmp_path):
    store = store_at(spark, tmp_path)
    open_ = spark.createDataFrame([("U", "Phys", A, None)], T)
    run(store, 1, open_, *frames(spark, [(A, page("one"))], [(A, answer([person("Ann")]))]), first_run=True)
    failed = run(store, 2, open_, *frames(spark, [(A, page("two"))], [(A, "sorry")]))
    assert names(store) == ["Ann"] and failed.outcomes.first()["status"].startswith("failed")
    run(store, 3, open_, *frames(spark, [(A, page("two"))], [(A, answer([person("Bob")]))]))
    assert names(store) == ["Bob"]


def test_changed_page_below_an_unchanged_one(spark, tmp_path):
    store = store_at(spark, tmp_path)
    open_ = spark.createDataFrame([("U", "Phys", A, None)], T)
    first = [(A, answer([person("Ann")], child_page_urls=[A2])), (A2, answer([person("Bob")], child_page_urls=[B])), (B, answer([person("Cyd")]))]
    old = [(A, page("one")), (A2, page("two")), (B, page("three"))]
    run(store, 1, open_, *frames(spark, old, first), first_run=True)
    assert names(store) == ["Ann", "Bob", "Cyd"]
    new = [*old[:2], (B, page("three, new"))]
    pages, answers = frames(spark, new, [(B, answer([person("Dan")]))])
    plan = plan_run(store, 2, open_, pages)
    assert rows(plan.to_extract, "url") == [(B,)]
    finish_run(store, plan, answers)
    assert names(store) == ["Ann", "Bob", "Dan"]
    result = run(store, 3, open_, *frames(spark, new, [])[:1], spark.createDataFrame([], "url string, response string"))
    assert rows(result.outcomes, "status") == [("Skipped",)]


def test_blocked_and_missing_pages_fall_back_on_stored_ones(spark, tmp_path):
    store = store_at(spark, tmp_path)
    open_ = spark.createDataFrame([("U", "Phys", A, None), ("U", "Law", C, None)], T)
    long = "word " * 400
    old = [(A, page(long)), (A2, page(long + "2")), (C, page(long + "3"))]
    first = [(A, answer([person("Ann")], next_page_url=A2)), (A2, answer([person("Bob")])), (C, answer([person("Eve")]))]
    run(store, 1, open_, *frames(spark, old, first), first_run=True, gate=is_blocked)
    new = [(A, page(long + "new")), (A2, page("Just a moment"))]  # one blocked, one gone
    result = run(store, 2, open_, *frames(spark, new, [(A, answer([person("Abe")], next_page_url=A2))]), gate=is_blocked)
    assert names(store) == ["Abe", "Bob", "Eve"]
    assert rows(result.outcomes, "department", "status") == [("Law", "Skipped"), ("Phys", "completed")]


def test_full_listing_pages_are_not_followed(spark, tmp_path):
    store = store_at(spark, tmp_path)
    open_ = spark.createDataFrame([("U", "Phys", A, None)], T)
    answers = [(A, answer([person("Ann"), person("Bob")], child_page_urls=[A2])), (A2, answer([person("Cyd")]))]
    run(store, 1, open_, *frames(spark, [(A, page("a")), (A2, page("b"))], answers), first_run=True, enough_records=2)
    assert names(store) == ["Ann", "Bob"]
