import random
from collections import deque

import pytest

from rosterlake.operators import subtree

CHANGES, LINKS = "url string, status string", "src string, dst string"


def fewest_links(changes, links):
    """To a changed page, by a search from every page."""
    status = dict(changes)
    after = {}
    for src, dst in links:
        after.setdefault(src, set()).add(dst)
    out = {}
    for page in status:
        queue, seen = deque([(page, 0)]), {page}
        out[page] = None
        while queue:
            at, n = queue.popleft()
            if status.get(at) != "unchanged":
                out[page] = n
                break
            for dst in after.get(at, ()):
                if dst is not None and dst not in seen:
                    seen.add(dst)
                    queue.append((dst, n + 1))
    return out


def found(spark, changes, links):
    rows = subtree.changed_below(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(links, LINKS)).collect()
    assert len(rows) == len(changes) and all(r["can_skip"] == (r["links_to_change"] is None) for r in rows)
    assert {r["url"]: r["status"] for r in rows} == dict(changes)
    return {r["url"]: r["links_to_change"] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search_from_every_page(spark, seed):
    rng = random.Random(seed)
    changes, links = [], []
    for g in range(80):
        names = [f"http://g{g}/{i}" for i in range(rng.choice([1, 4, 9, 20]))]
        changes += [(u, rng.choices(["unchanged", "changed", "new", "gone", None], [30, 1, 1, 1, 1])[0]) for u in names]
        links += [(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(2 * len(names)))]
        links += [(rng.choice(names), f"http://g{g}/missing")] * (rng.random() < 0.1)
    links += [(None, changes[0][0]), (changes[0][0], None)]
    got = found(spark, changes, links)
    assert got == fewest_links(changes, links)
    assert len({d for d in got.values()}) > 4


def test_cycles_and_depth(spark):
    same = [(u, "unchanged") for u in "abcdefg"]
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "g")]
    assert set(found(spark, same + [("d", "unchanged")], links).values()) <= {None}
    got = found(spark, [r for r in same if r[0] != "d"] + [("d", "changed")], links)
    assert got == {"a": 3, "b": 2, "c": 1, "d": 0, "e": None, "f": None, "g": None}


def test_nothing_to_look_at(spark):
    assert found(spark, [("a", "unchanged")], []) == {"a": None}
    none = spark.createDataFrame([], CHANGES)
    assert subtree.changed_below(none, spark.createDataFrame([("a", "b")], LINKS)).count() == 0
