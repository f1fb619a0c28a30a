import random
import re

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import decontaminate

from .rows import BASE, awkward, clashing, empty

ITEM = "item_id long, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    known = {}
    for item, text in items:
        own = words(text)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            known.setdefault(tuple(own[k : k + n]), set()).add(str(item))
    out = {}
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(own[k : k + n])]
        out[i] = (len(own), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 300])
def test_equals_brute_force_also_in_slices(spark, limit):
    rng = random.Random(2)
    some = [f"k{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([0, 2, 5, 13, 20])))) for i in range(12)] + [(99, None)]
    docs = []
    for i in range(60):
        own = rng.choices(some + ["É1", "Zz"], k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            own[5:5] = items[rng.randrange(12)][1].upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(own)))
    found = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), broadcast_bytes=limit
    )
    got = {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"]) for r in found.collect()}
    assert got == brute(docs, items)


def test_packed_windows_stay_small_and_tell_items_apart():
    rng = random.Random(4)
    some = [f"word{i}" for i in range(3000)]
    shared = " ".join(some[:20])
    items = [(f"i{k:04}", " ".join(rng.choices(some, k=200))) for k in range(1500)]
    items += [(f"s{k}", shared) for k in range(50)] + [("twice", shared + " x " + shared)]
    known = decontaminate.WindowSet(items, 13)
    assert known.n_bytes < 6 * sum(len(t) for _, t in items)
    hits = list(known.hits(decontaminate.Words([b"start " + shared.upper().encode() + b" end"], decontaminate.ALNUM, lower=True)))
    assert [(first, n) for first, n, _ in hits] == [(1 + k, 13) for k in range(8)]
    assert all(names == {*(f"s{k}" for k in range(50)), "twice"} for _, _, names in hits)


def test_equal_hashes_of_unlike_words():
    known = decontaminate.WindowSet([("a", "one two"), ("b", "one three"), ("c", "one two")], 2)
    hashes, *rest = known.by_length[2]
    own = decontaminate.Words([b"one two"], decontaminate.ALNUM, lower=True)
    known.by_length[2] = (hashes * 0 + own.windows(2)[1][0], *rest)
    assert list(known.hits(own)) == [(0, 2, {"a", "c"})]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    bench = spark.createDataFrame([(1, BASE), (2, None), (3, ""), (None, "kurz")], ITEM)
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["10", "3", "4", "5", "6", "7", "9", "None"]
    assert decontaminate.remove_documents(empty(spark), bench).count() == 0
    assert decontaminate.remove_documents(docs, spark.createDataFrame([], ITEM)).count() == docs.count()


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "é before; ONE two three! after é"), (2, "nothing"), (3, None)], "doc_id long, text string")
    left = decontaminate.remove_spans(docs, spark.createDataFrame([(1, "one two three")], ITEM))
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: "é before; ! after é", 2: "nothing", 3: None}


def test_twentieth_of_the_words(spark):
    thirteen = " ".join(f"b{i}" for i in range(13))
    docs = [(1, thirteen + " x" * 247), (2, thirteen + " x" * 248)]
    marked = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, thirteen)], ITEM))
    got = {r["doc_id"]: r["c"] for r in marked.select("doc_id", decontaminate.contaminated().alias("c")).collect()}
    assert got == {1: True, 2: False}
    empty_items = marked.select(decontaminate.items_digest().alias("d")).where(F.col("d") == decontaminate.empty_digest()).count()
    assert empty_items == 0
