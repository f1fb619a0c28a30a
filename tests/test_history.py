import random

import pytest

from rosterlake.operators.history import as_of, state_intervals

SIGHTINGS = "run_no long, university string, department string, rec_key long"


def by_hand(rows, asked, archive_after):
    """Each run replayed, one after the other."""
    out = set()
    scopes = {r[1:3] for r in rows}
    for run in asked:
        for scope in scopes:
            state = {}
            for past in sorted({r[0] for r in rows if r[1:3] == scope and r[0] <= run}):
                here = {r[3] for r in rows if r[0] == past and r[1:3] == scope}
                for key in here | state.keys():
                    first, last, misses = state.get(key, (past, past, 0))
                    if key not in here:
                        state[key] = (first, last, misses + 1)
                    else:
                        state[key] = (past if misses >= archive_after else first, past, 0)
            for key, (first, last, misses) in state.items():
                status = "active" if not misses else "archived" if misses >= archive_after else "not_found"
                out.add((run, *scope, key, status, first, last))
    return out


@pytest.mark.parametrize(("seed", "archive_after", "shift"), [(0, 1, 0), (1, 2, -7), (2, 3, 1000), (3, 2, 0)])
def test_states_equal_a_replay(spark, seed, archive_after, shift):
    rng = random.Random(seed)
    rows = set()
    for scope in [("u", "a"), ("u", None), (None, "a"), ("v", "b")]:
        for run in rng.sample(range(23), rng.randrange(1, 20)):
            rows |= {(run + shift, *scope, key) for key in range(12) if rng.random() < 0.5}
    rows = sorted(rows, key=str)
    asked = list(range(shift - 3, shift + 30)) + [shift + 5]
    df = spark.createDataFrame(rows + rows[:5], SIGHTINGS)
    found = as_of(state_intervals(df, archive_after), spark.createDataFrame([(r,) for r in asked], "run_no long"))
    got = found.select("run_no", "university", "department", "rec_key", "status", "first_run", "last_run").collect()
    assert {tuple(r) for r in got} == by_hand(rows, set(asked), archive_after)
    assert len(got) == len({tuple(r) for r in got})  # a run meets an interval once


def test_runs_that_miss_a_record_have_no_rows(spark):
    rows = [(run, "u", "d", 1) for run in range(1, 2001)] + [(run, "u", "d", 2) for run in (1, 2000)]
    df = spark.createDataFrame(rows, SIGHTINGS)
    got = {(r["rec_key"], r["status"], r["from_run"], r["to_run"]) for r in state_intervals(df, 3).collect()}
    assert got == {
        *((1, "active", run, run + 1 if run < 2000 else None) for run in range(1, 2001)),
        (2, "active", 1, 2), (2, "not_found", 2, 4), (2, "archived", 4, 2000), (2, "active", 2000, None),
    }


def test_nothing_seen(spark):
    none = spark.createDataFrame([], SIGHTINGS)
    runs = spark.createDataFrame([(1,)], "run_no long")
    assert as_of(state_intervals(none, 2), runs).count() == 0
    with pytest.raises(ValueError, match="archive_after"):
        state_intervals(none, 0)
