"""Steps of links are joined by their counted rows, not by the size of their files."""

from rosterlake.operators import closure_updates, traversal
from rosterlake.session import LinkSteps


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_steps_are_not_sent_to_all(spark):
    steps = LinkSteps(spark)
    rows = LinkSteps.SMALL_ROWS + 1
    large = steps.write("large", spark.range(rows).selectExpr("id % 7 as url"))
    twice = steps.write("large", spark.range(5).selectExpr("id as url"))
    small = steps.write("small", spark.range(5).selectExpr("id as src"))
    one = large.selectExpr("url as src").distinct()
    assert "Broadcast" not in _plan(large.join(one, large["url"] == one["src"]))
    assert "Broadcast" not in _plan(steps.union("large").join(spark.range(9).selectExpr("id as url"), "url", "left_semi"))
    assert "BroadcastHashJoin" in _plan(large.join(small, large["url"] == small["src"]))
    assert steps.rows == {"large": rows + 5, "small": 5} and twice.count() == 5


def test_walks_and_closures_are_the_same_by_sorted_joins(spark, monkeypatch):
    chain = [(f"p{i}", f"p{i + 1}", "next", 0) for i in range(20)] + [(f"p{i}", "p0", "child", 1) for i in range(20)]
    links = spark.createDataFrame(chain, "src string, dst string, kind string, pos long")
    roots = spark.createDataFrame([("p0",), ("p7",)], "root string")
    none = links.where("false")
    gone = links.where("src = 'p12' and kind = 'next'")

    def found():
        closure = traversal.crawl_closure(roots, links)
        changes = closure_updates.closure_changes(closure.select("root", "url", "depth"), links, none, gone)
        walks = traversal.pagination_walk(roots, links)
        return [sorted(map(str, df.collect())) for df in (closure, changes, walks)]

    sent = found()
    assert [len(rows) for rows in sent] == [42, 16, 35]
    monkeypatch.setattr(LinkSteps, "SMALL_ROWS", 0)
    assert found() == sent


def test_no_step_of_a_changed_closure_is_sent_beyond_the_limit(spark, monkeypatch):
    """Steps and the result: with a limit of no row at all, none goes through the driver."""
    monkeypatch.setattr(LinkSteps, "SMALL_ROWS", -1)
    chain = [(f"p{i}", f"p{i + 1}", "next", 0) for i in range(9)] + [("p0", f"p{i}", "child", i) for i in (3, 5)]
    links = spark.createDataFrame(chain, "src string, dst string, kind string, pos long")
    closure = traversal.crawl_closure(spark.createDataFrame([("p0",), ("p2",)], "root string"), links)
    plans = []
    write = LinkSteps.write
    monkeypatch.setattr(LinkSteps, "write", lambda self, name, df: plans.append(_plan(df)) or write(self, name, df))
    gone = links.where("src = 'p4' or dst = 'p3'")
    changes = closure_updates.closure_changes(closure.select("root", "url", "depth"), links, links.limit(0), gone)
    plans.append(_plan(closure_updates.updated_closure(closure, changes)))
    assert len(plans) > 10 and not [plan for plan in plans if "Broadcast" in plan]
    got = {(r["root"], r["url"]): (r["depth_before"], r["depth"]) for r in changes.collect()}
    assert got == {("p0", "p3"): (1, None), ("p0", "p4"): (2, None), **{("p2", f"p{i}"): (i - 2, None) for i in range(3, 10)}}
