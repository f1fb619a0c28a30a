import random

import numpy as np
import pytest

from rosterlake.llm import near_dedup
from rosterlake.llm.wordhash import VISIBLE, Words
from rosterlake.session import StepTables

from .rows import awkward, clashing, empty


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_banded_distance_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    a = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
    b = [x for x in a if rng.random() > 0.15]
    for _ in range(rng.randrange(4)):
        b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
    limit = rng.randrange(0, 12)
    want = edit_distance(a, b)
    got = near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), limit)
    assert got == (want if want <= limit else None)


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("k", [1, 2])
def test_unmatched_runs_bound_the_distance(seed, k):
    rng = random.Random(seed)
    a = [rng.randrange(9) for _ in range(rng.randrange(1, 40))]
    b = [x for x in a if rng.random() > 0.1]
    for _ in range(rng.randrange(5)):
        b.insert(rng.randrange(len(b) + 1), rng.randrange(9))
    edits = edit_distance(a, b)
    one, other = np.array(a, np.uint64), np.array(b, np.uint64)
    assert near_dedup.unmatched(one, other, edits, k) <= k * edits
    near = [i for i in range(len(a) - k + 1) if any(a[i : i + k] == b[j : j + k] for j in range(max(0, i - 3), i + 4) if len(b) - j >= k)]
    assert near_dedup.unmatched(one, other, 3, k) == len(a) - k + 1 - len(near)


def test_sketches_keep_text_order():
    words = Words([b"a b c d e f g h i j"], VISIBLE, lower=True).hash
    there = near_dedup.order_sketches(words, 1, 32, 3)
    back = near_dedup.order_sketches(words[::-1], 1, 32, 3)
    assert len(there) == 32 and not set(there.tolist()) & set(back.tolist())


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(7, k) for k in range(1000, 1300)]
    edges = spark.createDataFrame(chain + hub + [(5, 5), (141, 139)], "a long, b long")
    got = {r["id"]: r["least"] for r in near_dedup.connected(edges, StepTables(spark)).collect()}
    want = {i: 100 for i in range(101, 142)} | {k: 7 for k in range(1000, 1300)}
    assert got == want


def groups(df):
    return {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df).collect()}


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    found = groups(docs)
    assert found[1] == found[2] == found[10] == 1
    assert found[3] == found[4] == 3 and found[5] == 5 and found[8] == 8
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "5", "6", "7", "8", "9", "None"])


def test_empty_table(spark):
    assert groups(empty(spark)) == {}
    assert near_dedup.keep_first(empty(spark)).count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    for g in range(12):
        words = [f"x{rng.randrange(500)}" for _ in range(120)]
        for k in range(4):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"y{rng.randrange(1000)}"
            texts[g * 10 + k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = groups(docs)
    want = {}
    for i, t in sorted(texts.items()):
        near = [j for j in want if edit_distance(t.split(), texts[j].split()) <= 0.2 * 120]
        want[i] = want[near[0]] if near else i
    assert found == want


@pytest.mark.parametrize("block", [256, 3])
def test_texts_of_frequent_passages(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(2)
    passages = [[f"p{p}w{i}" for i in range(30)] for p in range(8)]
    texts = {}
    for i in range(200):
        words = [w for p in rng.sample(passages, 4) for w in p]
        for at in rng.sample(range(120), 4):
            words[at] = f"own{i}x{at}"
        texts[i] = words
    for i in range(200):
        words = list(texts[i])
        for at in rng.sample(range(120), 3):
            words[at] = f"new{i}x{at}"
        texts[1000 + i] = words
    # by brute force: groups of all pairs that share a sketch and are alike
    hashes = {i: Words([" ".join(w).encode()], VISIBLE, lower=True).hash for i, w in texts.items()}
    keys = {i: set(near_dedup.order_sketches(h, 5, 32, 3).tolist()) for i, h in hashes.items()}
    want = {i: i for i in texts}
    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if want[i] != want[j] and keys[i] & keys[j] and near_dedup.banded_distance(hashes[i], hashes[j], 24) is not None:
                low, high = sorted((want[i], want[j]))
                want = {k: low if g == high else g for k, g in want.items()}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert groups(docs) == want
    assert len(set(want.values())) <= 200


def test_hot_groups_of_copies(spark):
    rows = [(i, "one text that is copied very often indeed by all " * 3) for i in range(3000)]
    rows += [(5000 + i, "the same start for every row of this kind and then number " * 4 + f"n{i}") for i in range(500)]
    found = groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {found[i] for i in range(3000)} == {0}
    assert {found[5000 + i] for i in range(500)} == {5000}


def five_word_similarity(a, b):
    one, other = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(one & other) / len(one | other)


@pytest.mark.parametrize("whole", [256, 12, 3])
def test_recall_at_the_threshold_in_split_buckets(spark, monkeypatch, whole):
    """Unlike texts around one passage that is a third of each, and near copies whose
    five-word similarity to them is 0.8 to 0.9, with open buckets that are split or not."""
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts, pairs = {}, []
    for i in range(300):
        own = [f"o{i}x{k}" for k in range(120)]
        at = rng.randrange(120)
        texts[i] = own[:at] + passage + own[at:]
    for i in range(300):
        words = list(texts[i])
        for at in (20, 90, 160)[: rng.randrange(2, 4)]:
            words[at] = f"n{i}x{at}"
        texts[1000 + i] = words
        pairs.append(five_word_similarity(texts[i], words))
    assert 0.79 < min(pairs) < 0.9
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = groups(docs)
    assert all(found[i] == i for i in range(300))  # the passage alone joins nothing
    alike = [i for i in range(300) if pairs[i] >= 0.8]
    assert len(alike) > 200 and sum(found[1000 + i] == i for i in alike) >= 0.99 * len(alike)


def test_one_text_of_each_class_is_compared(spark, monkeypatch):
    """800 + 800 repeated rows of two near copies are one pair."""
    steps_, written = near_dedup.StepTables.write, {}

    def counted(self, name, df):
        out = steps_(self, name, df)
        written.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(near_dedup.StepTables, "write", counted)
    words = [f"w{i}" for i in range(100)]
    rows = [(i // 2, " ".join(words)) for i in range(800)] + [(5, " ".join([*words, "end"]))] * 800
    assert set(groups(spark.createDataFrame(rows, "doc_id long, text string")).values()) == {0}
    assert [t.count() for t in written["pairs"]] == [1] and [t.count() for t in written["texts"]] == [2]


def test_unlike_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(7, " ".join(words)), (7, "quite another text"), (7, "quite another text"), (7, None), (9, " ".join([*words, "more"]))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    kept = near_dedup.keep_first(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(7, ""), (7, " ".join(words)), (7, "quite another text")])
    found = near_dedup.near_duplicates(docs)
    assert found.count() == 5 and {r["group_id"] for r in found.collect()} == {7}


@pytest.mark.parametrize(("whole", "cells"), [(12, True), (12, False), (3, False)])
def test_large_buckets_lose_no_link(spark, monkeypatch, whole, cells):
    """Buckets of a frequent passage, in chains of near copies that often share one sketch only."""
    monkeypatch.setattr(near_dedup, "WHOLE", whole)
    monkeypatch.setattr(near_dedup, "_less_in_cells", lambda large, classes: cells)
    by_runs, called = near_dedup._by_rare_runs, []
    monkeypatch.setattr(near_dedup, "_by_rare_runs", lambda *a: called.append(1) or by_runs(*a))
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for c in range(30):
        words = passage + [f"o{c}x{k}" for k in range(rng.randrange(10, 60))]
        for step in range(6):
            texts[c * 10 + step] = list(words)
            for at in rng.sample(range(len(words)), len(words) // 6):
                words[at] = f"n{c}x{step}x{at}"
    texts |= {900: ["P0"], 901: ["p0"], 902: ["p0", "p1"], 903: ["P0", "p1"]}
    hashes = {i: Words([" ".join(w).encode()], VISIBLE, lower=True).hash for i, w in texts.items()}
    keys = {i: set(near_dedup.order_sketches(h, 5, 32, 3).tolist()) for i, h in hashes.items()}
    want, ids = {i: i for i in texts}, sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            limit = int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)
            if want[i] != want[j] and keys[i] & keys[j] and near_dedup.banded_distance(hashes[i], hashes[j], limit) is not None:
                low, high = sorted((want[i], want[j]))
                want = {k: low if g == high else g for k, g in want.items()}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert groups(docs) == want
    assert bool(called) != cells


@pytest.mark.parametrize("similarity", [0.8, 0.75, 0.6])
def test_least_shared_runs_hold_for_any_edits(similarity):
    run = near_dedup.RUN if similarity >= near_dedup.RUN_SIMILARITY else 1
    rng = random.Random(5)
    for _ in range(2000):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        if not b or edit_distance(a, b) > int((1 - similarity) * max(len(a), len(b)) + 1e-9):
            continue
        one, other = (set(near_dedup._labelled(np.array(x, np.uint64), run)[1].tolist()) for x in (a, b))
        for x in (a, b):
            assert 1 <= near_dedup.least_shared(len(x), run, similarity) <= len(one & other)


def test_unlike_long_texts_are_ruled_out_by_their_counts(spark, monkeypatch):
    """Copies of 800 words just beyond the similarity, whose counts in few bins look alike."""
    write, pairs, cells = near_dedup.StepTables.write, [], []
    all_pairs = near_dedup._all_pairs

    def counted(self, name, df):
        out = write(self, name, df)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dedup.StepTables, "write", counted)
    monkeypatch.setattr(near_dedup, "_all_pairs", lambda *a: cells.append(all_pairs(*a)) or cells[-1])
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(800)], []
    for c in range(40):
        texts.append(list(base))
        for at in rng.sample(range(0, 800, 25), 5):
            texts[-1][at : at + 25] = [f"n{c}x{at}x{k}" for k in range(25)]
    texts += [[*texts[39][:60], *texts[39][100:]], ["the"] * 400 + base[:100], ["the"] * 405 + base[:100]]
    want = list(range(43))
    for i, a in enumerate(texts):
        for j in range(i):
            limit = int(0.2 * max(len(a), len(texts[j])) + 1e-9)
            if want[i] != want[j] and edit_distance_at_most(a, texts[j], limit):
                low, high = sorted((want[i], want[j]))
                want = [low if g == high else g for g in want]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert groups(docs) == dict(enumerate(want)) and len(set(want)) > 10
    assert pairs[1] < 60
    assert cells[0].count() == cells[0].distinct().count()


def edit_distance_at_most(a, b, limit):
    numbers = {w: i for i, w in enumerate({*a, *b})}
    one, other = (np.array([numbers[w] for w in x], np.uint64) for x in (a, b))
    return near_dedup.banded_distance(one, other, limit) is not None
