import random

from rosterlake.operators import visit_order as V
from rosterlake.operators.traversal import usable_links

from .test_traversal import LINKS, frames, random_graph, u, visit


def collected(df):
    return sorted(tuple(r) for r in df.select("root", "visit_no", "url", "depth", "parent").collect())


def by_hand(root, links):
    return [(r, no, page, depth, chain[-1] if chain else None) for r, no, page, depth, chain in visit(root, links, 10**9)]


def test_random_graphs(spark):
    """Eighty graphs at once, each apart from the others by its URLs."""
    rng = random.Random(4)
    graphs = [random_graph(rng, f"g{i}") for i in range(80)]
    roots, edges = frames(spark, [r for names, _ in graphs for r in names], [e for _, links in graphs for e in links])
    want = sorted(row for names, links in graphs for root in names for row in by_hand(root, links))
    assert collected(V.visit_order(roots, usable_links(edges))) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """2,000 pages, each with a child, and a later child that joins the chain half way."""
    links = [(u(i), u(i + 1), "next", 0) for i in range(1999)] + [(u(i), u(f"p{i}"), "child", 0) for i in range(2000)]
    links += [(u("p7"), u(1200), "next", 0), (u("p9"), u("q"), "next", 0), (u("q"), u("p3"), "child", 0)]
    rounds = []
    follow = V._runs
    monkeypatch.setattr(V, "_runs", lambda *given: rounds.append(1) or follow(*given))
    roots, edges = frames(spark, [u(0)], links)
    assert collected(V.visit_order(roots, edges)) == sorted(by_hand(u(0), links))
    assert len(rounds) == 2


def test_many_runs_that_meet(spark):
    """Children that join one chain at every place, early ones behind late ones, and a cycle."""
    chain = [(u(f"c{i}"), u(f"c{i + 1}"), "next", 0) for i in range(60)] + [(u("c60"), u("c20"), "next", 0)]
    order = random.Random(1).sample(range(60), 60)
    links = chain + [(u("r"), u(f"s{i}"), "child", no) for no, i in enumerate(order)]
    links += [(u(f"s{i}"), u(f"c{i}"), "next", 0) for i in range(60)]
    roots, edges = frames(spark, [u("r"), u("s5"), u("c59")], links)
    want = sorted(row for root in (u("r"), u("s5"), u("c59")) for row in by_hand(root, links))
    assert collected(V.visit_order(roots, edges)) == want


def test_a_child_queued_meanwhile_holds_back_a_next_link(spark):
    links = [(u("r"), u("a"), "child", 0), (u("r"), u("b"), "child", 1), (u("a"), u("x"), "child", 0)]
    links += [(u("b"), u("b2"), "next", 0), (u("b2"), u("x"), "next", 0), (u("x"), u("y"), "next", 0), (u("b2"), u("z"), "child", 0)]
    roots, edges = frames(spark, [u("r")], links)
    got = collected(V.visit_order(roots, edges))
    assert [row[2] for row in got] == [u(n) for n in ("r", "a", "b", "b2", "x", "y", "z")]
    assert got == by_hand(u("r"), links)


def test_nulls_repeats_and_empty_tables(spark):
    links = [(u("r"), u("a"), "next", 0), (u("r"), u("a"), "next", 0), (None, u("b"), "next", 0), (u("a"), None, "child", 1)]
    roots, edges = frames(spark, [u("r"), u("r"), None], links)
    assert collected(V.visit_order(roots, edges)) == [(u("r"), 1, u("r"), 0, None), (u("r"), 2, u("a"), 1, u("r"))]
    assert collected(V.visit_order(roots, edges.limit(0))) == [(u("r"), 1, u("r"), 0, None)]
    assert collected(V.visit_order(roots.limit(0), spark.createDataFrame([], LINKS))) == []
