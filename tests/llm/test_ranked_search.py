import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import ranked_search
from rosterlake.llm.wordhash import ALNUM, Words

from .rows import awkward, clashing, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [h for h in held if h[1]]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def corpus(rng, docs, words):
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80)))) for i in range(docs)]


@pytest.mark.parametrize("options", [{}, {"block_docs": 7}, {"block_entries": 200, "slice_bytes": 300}])
def test_best_equal_brute_force(spark, options):
    rng = random.Random(len(options))
    docs = corpus(rng, 400, 60) + [(None, "w1 w2"), (None, ""), (900, None), (901, "!?"), (902, "w1 W1 w-1 É é"), (902, "w1 W1 w-1 É é")]
    items = [(f"i{i}", t) for i, (_, t) in enumerate(corpus(rng, 20, 60))]
    items += [("none", None), ("blank", "..."), (None, "w3 w5"), ("twice", "w7 w9 w7"), ("twice", "w7 w9 w7"), ("far", "zzz"), ("é", "É")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = ranked_search.search(d, b, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_force(docs, items)


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("first", [1, 3, 64])
def test_intervals_close_on_the_best(seed, first):
    rng = np.random.default_rng(seed)
    docs, n_terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 8)), int(rng.integers(1, 6))
    tf = rng.integers(0, 4, (n_terms, docs)) * (rng.random((n_terms, docs)) < rng.random())
    lengths = np.maximum(tf.sum(axis=0), 1)
    term, doc = np.nonzero(tf)
    row = {"lengths": lengths.astype("<i8").tobytes(), "ids": np.arange(docs).astype("<i8").tobytes(), "no_id": np.zeros(docs, bool).tobytes()}
    for name, a in (("term", term), ("doc", doc), ("tf", tf[term, doc])):
        row[name] = a.astype("<i4").tobytes()
    lists = ranked_search.Lists(row, docs, int(lengths.sum()), n_terms)
    weights = rng.integers(0, 5, n_terms)
    m = 10 + 90 * lengths * docs // lengths.sum()
    scores = (weights[:, None] * (10**9 * tf // (1000 * tf + 8 * m))).sum(axis=0)
    at, found = ranked_search.nra(lists, np.arange(n_terms), weights, k, first)
    assert (scores[at] == found).all()
    kth = max(1, np.sort(scores)[-k] if docs >= k else 1)
    assert set(at.tolist()) == set(np.flatnonzero(scores >= kth).tolist())


def test_lists_are_not_read_to_their_end():
    """One document stands out early; the rest of a long list can't change that."""
    n = 4000
    term = np.concatenate((np.zeros(n, int), [1]))
    doc = np.concatenate((np.arange(n), [5]))
    tf = np.concatenate((np.where(np.arange(n) == 5, 50, 1), [50]))
    lengths = np.where(np.arange(n) == 5, 100, 100)
    row = {"lengths": lengths.astype("<i8").tobytes(), "ids": np.arange(n).astype("<i8").tobytes(), "no_id": np.zeros(n, bool).tobytes()}
    for name, a in (("term", term), ("doc", doc), ("tf", tf)):
        row[name] = a.astype("<i4").tobytes()
    lists = ranked_search.Lists(row, n, int(lengths.sum()), 2)

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype == np.int64 and key.ndim == 1 and len(key) > 2:
                Counted.read += len(key)
            return np.asarray(self)[key]

    lists.doc = lists.doc.view(Counted)
    at, _ = ranked_search.nra(lists, np.arange(2), np.array([1, 1000]), 1)
    assert at.tolist() == [5] and 0 < Counted.read < n / 4


def test_terms_of_equal_hash_are_told_apart():
    terms = ranked_search.Terms(["one two three"])
    terms.hash = np.zeros(3, np.uint64)
    terms.same = 3
    words = Words([b"two x one one"], ALNUM, lower=True)
    words.hash = np.zeros(4, np.uint64)
    at, found = terms.find(words)
    spelled = [bytes(terms.bytes[terms.ends[t] : terms.ends[t + 1]]) for t in found]
    assert sorted(zip(at.tolist(), spelled, strict=True)) == [(0, b"two"), (2, b"one"), (3, b"one")]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark)).withColumn("t", docs_text()).withColumn("number", docs_text())
    items = spark.createDataFrame([(1, "quick KURZ 漢字", 9), (None, "row id", 9), (3, None, 9)], "item_id long, text string, copies int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, ranked_search.search(docs, items).collect())) == brute_force(rows, [(1, "quick KURZ 漢字"), (None, "row id")])
    assert ranked_search.search(empty(spark), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0


def docs_text():
    from pyspark.sql import functions as F

    return F.lit("x")
