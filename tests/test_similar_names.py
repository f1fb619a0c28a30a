import random

import pytest

from rosterlake.operators.similar_names import DISTINGUISHING, similar_names


def grams(key, q):
    padded = " " * (q - 1) + key + " " * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def brute_force(keys, similarity, q):
    out = set()
    for scope, a in keys:
        for other, b in keys:
            if scope == other and a < b and [w in a.split() for w in DISTINGUISHING] == [w in b.split() for w in DISTINGUISHING]:
                one, two = grams(a, q), grams(b, q)
                if len(one & two) * 1_000_000 >= len(one | two) * round(similarity * 1_000_000):
                    out.add((scope, a, b, len(one & two), len(one | two)))
    return out


@pytest.mark.parametrize(("similarity", "q"), [(0.6, 3), (0.3, 2), (0.8, 3), (1.0, 2), (0.5, 4)])
def test_pairs_equal_brute_force(spark, similarity, q):
    rng = random.Random(q)
    words = ["physics", "physic", "biology", "biologies", "applied", "chemistry", "chemical", "law", "laws", "a", "é漢"]
    rows = []
    for i in range(500):
        name = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.3:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("xyz") + name[at + 1 :]
        rows.append((rng.choice(["u", "v", None]), " ".join(name.split())))
    df = spark.createDataFrame(rows, "university string, name string")
    got = similar_names(df, scope=("university",), similarity=similarity, q=q).collect()
    want = brute_force({r for r in rows if r[1]}, similarity, q)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert want or similarity == 1.0


def test_spellings_blanks_and_distinguishing_words(spark):
    names = ["Physics, Department of", "School of Physics", "Physiks", "Applied Physics", "applied  physiks", " ", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["key"], r["other"]) for r in similar_names(df, similarity=0.4).collect()}
    assert got == {("physics", "physiks"), ("applied physics", "applied physiks")}
    assert similar_names(df.where("false")).count() == 0


def test_no_plan_of_all_pairs(spark):
    df = spark.createDataFrame([("a", "b")], "university string, name string")
    plan = similar_names(df, scope=("university",))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_are_not_shuffled(spark):
    names = spark.createDataFrame([("u", f"name {i}") for i in range(50)], "university string, name string")
    plan = similar_names(names, scope=("university",))._jdf.queryExecution().optimizedPlan().toString()
    # candidate pairs were made distinct by the two ids before they were verified
    assert not [line for line in plan.splitlines() if "Aggregate [id#" in line and ", to#" in line]
