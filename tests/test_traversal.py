import random
from collections import deque

import pytest

from rosterlake.operators import traversal as G

LINKS = "src string, dst string, kind string, pos long"


def visit(root, links, limit, fetched=None):
    """The order by hand: a queue per root, one page at a time."""
    nxt, kids = {}, {}
    for src, dst, kind, pos in sorted(links, key=lambda e: (e[3], e[1])):
        if not dst.startswith("http") or (fetched is not None and dst not in fetched):
            continue
        if kind == "next":
            nxt.setdefault(src, dst)
        else:
            kids.setdefault(src, []).append(dst)
    queue, known, out = deque([(root, ())]), {root}, []
    while queue and len(out) < limit:
        page, chain = queue.popleft()
        out.append((root, len(out) + 1, page, len(chain), chain))
        chain = (*chain, page)
        if page in nxt and nxt[page] not in known:
            known.add(nxt[page])
            queue.appendleft((nxt[page], chain))
        for child in kids.get(page, []):
            if child not in known:
                known.add(child)
                queue.append((child, chain))
    return out


def collected(df):
    return sorted(
        (r["root"], r["visit_no"], r["url"], r["depth"], tuple(r["ancestors"])) for r in df.collect()
    )


def frames(spark, roots, links):
    return (
        spark.createDataFrame([(r,) for r in roots], "root string"),
        spark.createDataFrame(links, LINKS),
    )


def u(name):
    return f"http://d/{name}"


def test_next_before_siblings_children_after(spark):
    links = [
        (u("root"), u("A"), "child", 0), (u("root"), u("B"), "child", 1), (u("root"), u("next"), "next", 0),
        (u("A"), u("A2"), "next", 0), (u("A"), u("Aa"), "child", 0), (u("A"), u("Ab"), "child", 1),
    ]
    got = collected(G.crawl_order(*frames(spark, [u("root")], links)))
    assert [r[2][len("http://d/"):] for r in got] == ["root", "next", "A", "A2", "B", "Aa", "Ab"]
    assert got == sorted(visit(u("root"), links, 30))


def test_queued_child_holds_back_a_next_link(spark):
    """B is queued as a child of root, so A's next link to it does not jump ahead."""
    links = [(u("r"), u(c), "child", i) for i, c in enumerate("AXYB")] + [(u("A"), u("B"), "next", 0)]
    got = collected(G.crawl_order(*frames(spark, [u("r")], links), max_pages=3))
    assert [r[2] for r in got] == [u("r"), u("A"), u("X")]


def random_graph(rng, prefix):
    names = [u(f"{prefix}/{i}") for i in range(rng.choice([4, 9, 14, 25]))]
    links = []
    for src in names:
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            links.append((src, rng.choice(names), "next", rng.randint(0, 3)))
        for pos, dst in enumerate(rng.sample(names, rng.randint(0, min(6, len(names))))):
            links.append((src, dst, "child", pos))
            if rng.random() < 0.1:
                links.append((src, dst, "child", pos + 3))
    links.append((names[0], "/relative", "child", 9))
    return names[:3], links


@pytest.mark.parametrize("limit", [2, 5, 12, 30])
def test_random_graphs(spark, limit):
    """Eighty graphs at a time, each apart from the others by its URLs."""
    rng = random.Random(limit)
    graphs = [random_graph(rng, f"g{i}") for i in range(80)]
    roots = [r for names, _ in graphs for r in names]
    r, e = frames(spark, roots, [link for _, links in graphs for link in links])
    want = sorted(
        row for names, links in graphs for root in names for row in visit(root, links, limit)
    )
    assert collected(G.crawl_order(r, G.usable_links(e), max_pages=limit)) == want


def test_pages_that_were_not_fetched_are_left_out(spark):
    links = [(u("r"), u("A"), "child", 0), (u("r"), u("B"), "child", 1), (u("A"), u("C"), "child", 0)]
    pages = spark.createDataFrame([(u("B"),), (u("r"),)], "url string")
    r, e = frames(spark, [u("r")], links)
    got = collected(G.crawl_order(r, G.usable_links(e, pages)))
    assert [row[2] for row in got] == [u("r"), u("B")]


def test_closure_depth_and_ancestors(spark):
    links = [
        (u("r"), u("A"), "child", 1), (u("r"), u("B"), "next", 0), (u("A"), u("C"), "child", 0),
        (u("B"), u("C"), "child", 5), (u("C"), u("r"), "child", 0), (u("C"), u("D"), "child", 0),
    ]
    got = {
        row["url"]: (row["depth"], row["ancestors"])
        for row in G.crawl_closure(*frames(spark, [u("r")], links), max_depth=2).collect()
    }
    assert got == {
        u("r"): (0, []), u("A"): (1, [u("r")]), u("B"): (1, [u("r")]), u("C"): (2, [u("r"), u("B")]),
    }


@pytest.mark.parametrize("limit", [1, 2, 5, 30])
def test_pagination_walk(spark, limit):
    chain = [(u(i), u(i + 1), "next", 0) for i in range(40)]
    loop = [(u("x"), u("y"), "next", 0), (u("y"), u("z"), "next", 0), (u("z"), u("y"), "next", 0)]
    starts = [u(0), u(38), u("x"), u("alone")]
    r, e = frames(spark, starts, chain + loop)
    got = sorted((w["root"], w["page_no"], w["url"]) for w in G.pagination_walk(r, e, limit).collect())
    want = []
    for s, pages in (
        (u(0), [u(i) for i in range(41)]), (u(38), [u(38), u(39), u(40)]),
        (u("x"), [u("x"), u("y"), u("z")]), (u("alone"), [u("alone")]),
    ):
        want += [(s, i + 1, p) for i, p in enumerate(pages[:limit])]
    assert got == sorted(want)


def test_children_of_full_roots_are_skipped(spark):
    links = [(u("r"), u("A"), "child", 0), (u("s"), u("B"), "child", 0), (u("A"), u("C"), "child", 0)]
    r, e = frames(spark, [u("r"), u("s")], links)
    found = spark.createDataFrame([(u("r"),)] * 3 + [(u("s"),)] * 2 + [(u("A"),)] * 9, "url string")
    left = G.frontier_pruned(e, found, r, threshold=3)
    assert sorted(x["src"] for x in left.collect()) == [u("A"), u("s")]
    assert G.frontier_pruned(e, found, r, threshold=0).count() == 3
