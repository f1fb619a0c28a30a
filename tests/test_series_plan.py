"""Page series: URLs are matched and shuffled once, and short series give no heads."""

from rosterlake.operators import links


def test_urls_are_shuffled_once(spark):
    urls = spark.range(400).selectExpr("concat('https://a/', id div 4, '?page=', id % 4 * 3000) as url")
    found = links.pagination_series(urls.union(urls))
    rows = {r["url"]: r["next_url"] for r in found.collect()}
    assert found.count() == len(rows) == 400
    assert rows["https://a/7?page=3000"] == "https://a/7?page=6000" and rows["https://a/7?page=9000"] is None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:  # without adaptive execution the plan shows what is used again before it runs
        plan = links.pagination_series(urls.union(urls))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert ["ReusedExchange" in line for line in shuffles].count(False) == 1 < len(shuffles)
