import hashlib
import random

from pyspark.sql import functions as F

from rosterlake.llm import fingerprints
from rosterlake.llm.successors import with_next

from .rows import awkward, clashing, empty


def test_equal_and_empty_texts(spark):
    docs = clashing(awkward(spark))
    got = fingerprints.add_fingerprint(docs, "text", "fp").select("doc_id", fingerprints.as_text(F.col("fp")).alias("s")).collect()
    by = {r["doc_id"]: r["s"] for r in got}
    assert by[1] == by[2] and len(by[1]) == 256 and by[1] != by[10]
    assert by[3] == by[4] == by[5] == ""
    assert fingerprints.add_fingerprint(empty(spark), "text").count() == 0


def test_likeness_estimates_common_shingles(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        a = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        cut = rng.randrange(0, 400)
        b = a[:cut] + [f"u{rng.randrange(10**6)}" for _ in range(400 - cut)]
        one, other = ({tuple(w[k : k + 5]) for k in range(396)} for w in (a, b))
        rows.append((i, " ".join(a), " ".join(b), len(one & other) / len(one | other)))
    df = spark.createDataFrame(rows, "i int, a string, b string, want double")
    df = fingerprints.add_fingerprint(fingerprints.add_fingerprint(df, "a", "fa"), "b", "fb")
    off = [abs(r["got"] - r["want"]) for r in df.select("want", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("got")).collect()]
    assert sum(off) / len(off) < 0.05 and max(off) < 0.16


def test_short_texts_borrow_alike(spark):
    df = spark.createDataFrame([("a b c d e f", "a b c d e f"), ("a b", "a b"), ("a b", "a c"), ("", ""), ("", "a")], "a string, b string")
    df = fingerprints.add_fingerprint(fingerprints.add_fingerprint(df, "a", "fa"), "b", "fb")
    near = [r[0] for r in df.select(fingerprints.likeness(F.col("fa"), F.col("fb"))).collect()]
    assert near[0] == near[1] == near[3] == 1.0 and near[2] < 0.2 and near[4] == 0.0


def test_next_row_over_gaps_blocks_and_nulls(spark):
    ids = [None, *sorted(random.Random(5).sample(range(-5000, 20000), 60)), 10**9, 10**9]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    got = with_next(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", ["t"]).collect()
    assert {r["t"]: r["next_t"] for r in got} == {f"t{n}": f"t{(n + 1) % len(ids)}" for n in range(len(ids))}
    one = with_next(spark.createDataFrame([(4, "x")], "doc_id long, t string"), "doc_id", ["t"]).collect()
    assert one[0]["next_t"] == "x"


def test_plan_is_native(spark):
    docs = fingerprints.add_fingerprint(awkward(spark), "text")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.sha256(b"").hexdigest()
