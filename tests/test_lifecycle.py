from pyspark.sql import functions as F

from rosterlake.operators import lifecycle as L
from rosterlake.spec import RecordSpec

STORED = (
    "record_id string, university string, department string, first_seen timestamp, last_seen timestamp, "
    "status string, runs_not_found long, data string, profile_url string"
)
SEEN = "record_id string, university string, department string, ord long, data string, profile_url string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def run(spark, stored, seen, scopes, day):
    return L.merge_run(
        stored,
        spark.createDataFrame(seen, SEEN),
        spark.createDataFrame(scopes, "university string, department string"),
        F.lit(f"2024-01-{day:02d} 00:00:00"),
    )


def test_seen_missed_and_archived(spark):
    """Three records, one seen in each later run: two go to the archive."""
    stored = spark.createDataFrame([], STORED)
    scope = [("MIT", "EECS")]
    people = [(f"r{i}", "MIT", "EECS", i, f"d{i}", f"http://p/{i}") for i in range(3)]
    first = run(spark, stored, people, scope, 1)
    assert first.where("status = 'active'").count() == 3
    second = run(spark, first, [("r0", "MIT", "EECS", 0, "new", None)], scope, 2)
    third = run(spark, second, [("r0", "MIT", "EECS", 0, "new", None)], scope, 3)
    assert rows(third, "record_id", "status", "runs_not_found", "data", "profile_url") == [
        ("r0", "active", 0, "new", "http://p/0"),
        ("r1", "not_found", 2, "d1", "http://p/1"),
        ("r2", "not_found", 2, "d2", "http://p/2"),
    ]
    kept = third.where("record_id = 'r0'").first()
    assert (kept["first_seen"].day, kept["last_seen"].day) == (1, 3)
    archive = spark.createDataFrame(
        [], "record_id string, university string, department string, first_seen timestamp, "
        "last_seen timestamp, data string, archived_at timestamp"
    )
    archived = L.archive_missing(third, archive, 2, F.lit("2024-01-04 00:00:00"))
    live = L.live_after_archive(third, 2)
    assert archived.count() == 2 and rows(live, "record_id") == [("r0",)]
    back = run(spark, live, [("r1", "MIT", "EECS", 0, "again", None)], scope, 5)
    again = back.where("record_id = 'r1'").first()
    assert (again["first_seen"].day, again["runs_not_found"]) == (5, 0)
    twice = L.archive_missing(
        back.withColumn("status", F.lit("not_found")).withColumn("runs_not_found", F.lit(2)),
        archived, 2, F.lit("2024-01-09 00:00:00"),
    )
    r1 = twice.where("record_id = 'r1'").first()
    assert (r1["first_seen"].day, r1["data"], r1["archived_at"].day) == (1, "again", 9)


def test_only_scraped_scopes_count_as_missed(spark):
    stored = run(
        spark, spark.createDataFrame([], STORED),
        [("a", "U", "D", 1, "x", None), ("b", "U", None, 2, "x", None), ("c", "V", "D", 3, "x", None)],
        [("U", "D")], 1,
    )
    after = run(spark, stored, [], [("U", None)], 2)
    assert rows(after, "record_id", "runs_not_found") == [("a", 0), ("b", 1), ("c", 0)]


def test_merge_again_changes_nothing(spark):
    seen = [("a", "U", "D", 1, "old", None), ("a", "U", "D", 2, "new", "http://p")]
    once = run(spark, spark.createDataFrame([], STORED), seen, [("U", "D")], 1)
    twice = run(spark, once, list(reversed(seen)), [("U", "D")], 1)
    cols = once.columns
    assert rows(once, *cols) == rows(twice, *cols)
    assert once.first()["data"] == "new"


def brute_history(sightings, threshold):
    """Replay the runs one by one, as stored records would go."""
    by_scope = {}
    for run_no, u, d, key in sightings:
        by_scope.setdefault((u, d), {}).setdefault(run_no, set()).add(key)
    out = {}
    for scope, runs in by_scope.items():
        state = {}
        for run_no in sorted(runs):
            for key in runs[run_no]:
                s = state.get(key)
                if s is None or s["misses"] >= threshold:
                    lives = (s or {"lives": 0})["lives"] + 1
                    state[key] = {"first": run_no, "misses": 0, "lives": lives}
                state[key]["misses"] = 0
                state[key]["last"] = run_no
            for key, s in state.items():
                if key not in runs[run_no]:
                    s["misses"] += 1
        for key, s in state.items():
            status = "active" if s["misses"] == 0 else "archived" if s["misses"] >= threshold else "not_found"
            out[(*scope, key)] = (s["first"], s["last"], s["lives"], s["misses"], status)
    return out


def test_history_equals_a_replay(spark):
    import random

    rng = random.Random(7)
    sightings = [
        (rng.randint(1, 9), rng.choice("UV"), rng.choice(["D", None]), rng.randint(1, 12)) for _ in range(160)
    ]
    df = spark.createDataFrame(sightings, "run_no long, university string, department string, rec_key long")
    got = {
        (r["university"], r["department"], r["rec_key"]): (
            r["first_run"], r["last_run"], r["n_lives"], r["misses"], r["status"]
        )
        for r in L.lifecycle_history(df, archive_after=2).collect()
    }
    assert got == brute_history(sightings, 2)


def test_jobs(spark):
    events = spark.createDataFrame(
        [("j", 1, 10, "pending", None, "http://l"), ("j", 2, 20, "running", None, None),
         ("j", 3, 30, "completed", None, None), ("j", 4, 40, "failed", "late", None)],
        "job_id string, seq long, ts long, status string, error string, listing_url string",
    )
    assert L.job_state(events).first().asDict() == {
        "job_id": "j", "status": "failed", "error": "late", "listing_url": "http://l",
        "last_attempted": 20, "completed_at": 30,
    }
    assert L.jobs_by_status(L.job_state(events), "failed").count() == 1


def test_schema_version(spark):
    spec = RecordSpec.from_dict({"columns": [{"name": "A", "type": "extracted"}]})
    row = L.schema_version(spark, spec, F.lit("2024-01-01")).first()
    assert row["version"] == spec.fingerprint() and '"name": "A"' in row["columns_json"]
