import random
from collections import deque

import pytest

from rosterlake.operators import closure_updates, traversal

LINKS = "src string, dst string, kind string, pos long"


def reached(roots, links):
    after = {}
    for src, dst, _, _ in links:
        after.setdefault(src, set()).add(dst)
    out = {}
    for root in roots:
        queue, depth = deque([root]), {root: 0}
        while queue:
            page = queue.popleft()
            for dst in after.get(page, ()):
                if dst not in depth:
                    depth[dst] = depth[page] + 1
                    queue.append(dst)
        out |= {(root, url): d for url, d in depth.items()}
    return out


def graphs(rng, n):
    """Many small graphs, each apart by its names: roots, links, added and removed ones."""
    roots, links, added, removed = [], [], [], []
    for g in range(n):
        size = rng.choice([2, 5, 9, 20])
        names = [f"http://g{g}/{i}" for i in range(size)]
        own = [(rng.choice(names), rng.choice(names), rng.choice(["next", "child"]), rng.randrange(3)) for _ in range(rng.randrange(3 * size))]
        own += [(a, b, "next", 0) for a, b in zip(names, names[1:], strict=False) if rng.random() < 0.6]
        own = sorted(set(own))
        roots += names[:2]
        links += own
        removed += rng.sample(own, rng.randrange(min(len(own), 6) + 1))
        more = names + [f"http://g{g}/new"]
        added += [(rng.choice(more), rng.choice(more), "child", 7) for _ in range(rng.randrange(4))]
    removed.append(("http://none", "http://none/2", "next", 0))
    return roots, links, sorted(set(added)), removed


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_a_new_closure(spark, seed):
    roots, links, added, removed = graphs(random.Random(seed), 120)
    frames = [spark.createDataFrame(rows, LINKS) for rows in (links, added, removed)]
    before, after = reached(roots, links), reached(roots, [e for e in links if e not in set(removed)] + added)
    closure = spark.createDataFrame([(*k, d) for k, d in before.items()], "root string, url string, depth long")
    changes = closure_updates.closure_changes(closure, *frames)
    want = {(*k, before.get(k), after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    got = changes.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    assert {(r[0], r[1]): r[2] for r in closure_updates.updated_closure(closure, changes).collect()} == after


def test_a_chain_that_breaks_and_a_cycle_that_holds_itself(spark):
    u = "http://{}".format
    chain = [(u(i), u(i + 1), "next", 0) for i in range(12)]
    cycle = [(u("r"), u("a"), "child", 0), (u("a"), u("b"), "next", 0), (u("b"), u("a"), "child", 0)]
    links = spark.createDataFrame(chain + cycle, LINKS)
    starts = spark.createDataFrame([(u(0),), (u("r"),)], "root string")
    closure = traversal.crawl_closure(starts, links).select("root", "url", "depth")
    added = spark.createDataFrame([(u(2), u(6), "child", 0)], LINKS)
    removed = spark.createDataFrame([chain[3], cycle[0]], LINKS)
    got = {tuple(r) for r in closure_updates.closure_changes(closure, links, added, removed).collect()}
    want = {(u(0), u(4), 4, None), (u(0), u(5), 5, None), (u("r"), u("a"), 1, None), (u("r"), u("b"), 2, None)}
    want |= {(u(0), u(i), i, i - 3) for i in range(6, 13)}
    assert got == want


def test_nothing_changes(spark):
    links = spark.createDataFrame([("http://a", "http://b", "next", 0), ("http://a", "http://b", "child", 2)], LINKS)
    closure = spark.createDataFrame([("http://a", "http://a", 0), ("http://a", "http://b", 1)], "root string, url string, depth long")
    none = links.where("false")
    assert closure_updates.closure_changes(closure, links, none, none).count() == 0
    # one of two rows of a link goes: the link stays
    assert closure_updates.closure_changes(closure, links, none, links.where("kind = 'child'")).count() == 0
    assert closure_updates.updated_closure(closure, closure_updates.closure_changes(closure, links, none, links)).count() == 1
