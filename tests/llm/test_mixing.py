import random

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import mixing

from .rows import awkward, clashing, empty


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > repeats * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        target |= {s: repeats * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_shares(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "", "aa"]
    rows = [(i, rng.choice(names[: 3 + seed * 2]), int(rng.paretovariate(1.2))) for i in range(3000)]
    rows += [(5000 + i, "tiny", 1) for i in range(3)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, taken = brute_targets(sizes), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert sum(r["taken"]) <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + sum(r["taken"])
    assert sum(taken.values()) == sum(sizes.values())
    longest = max(n for _, _, n in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in sizes)


def test_order_is_by_virtual_finish_time(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(40)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(3, 1)).collect()
    taken = {s: sum(sum(r["taken"]) for r in out if r["source"] == s) for s in "ab"}
    assert taken == {"a": 300, "b": 100}
    assert {len([x for x in r["taken"] if x]) for r in out if r["source"] == "a"} <= {1, 2}


def test_awkward_rows_and_reruns(spark):
    docs = clashing(awkward(spark))
    one, again = (sorted(map(str, mixing.mixed_documents(docs).collect())) for _ in range(2))
    assert one == again and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(docs.where("doc_id in (3, 4)")).count() == 0


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc\n",), ("x\xa0y z",)], "t string")
    assert [r[0] for r in df.select(mixing.words_in(F.col("t"))).collect()] == [0, 0, 3, 2]


def test_each_repeated_row_is_taken_for_itself(spark):
    """100 equal rows of one source, whose target is 800 of their 1,000 words."""
    rows = [(1, " ".join("x" * 10), "a")] * 100 + [(i + 2, "y", "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("r"))
    kept = mixing.mixed_documents(docs, weights=(4.0, 3.0))
    taken = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).collect()}
    assert taken == {"a": 800, "b": 600} and kept.columns == docs.columns
