"""Properties of physical plans that matter on large tables."""

import os

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from rosterlake.operators import dedup, hits, links, pages
from rosterlake.sources.snapshots import latest_pages
from rosterlake.spec import RecordSpec

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

# these run jobs of their own while the plan is built
ITERATIVE = {
    "crawl_closure", "crawl_ancestors", "crawl_order", "pagination_walk", "full_run",
    "generation_table", "stream_page_changes", "stream_dedup", "stream_listing_rows",
    "subtree_changes",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text


@pytest.fixture
def page_table(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_page_work_needs_no_shuffle(page_table):
    for df in (
        pages.fingerprint_snapshots(page_table, keep=("url",)),
        pages.page_flags(page_table),
        pages.clean_pages(page_table).select("url", "html"),
        links.page_links(page_table),
    ):
        text = plan(df)
        assert "Exchange" not in text
        assert "page_id" not in text.split("ReadSchema")[-1]


def test_changes_shuffle_fingerprints_not_html(page_table):
    two = page_table.withColumn("run_no", F.lit(1).cast("bigint"))
    text = plan(pages.changes_between(two, 2))
    exchange = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchange) == 1 and "url" in exchange[0]
    below = text[: text.index("Exchange")]
    assert "html" not in below


def test_first_and_last_combine_before_the_shuffle(spark, page_table):
    spec = RecordSpec.from_dict({"columns": [{"name": "html", "type": "extracted"}], "dedup_keys": ["html"]})
    df = page_table.withColumnRenamed("page_id", "ord")
    merged = plan(dedup.merge_duplicates(df, spec, scope=()))
    assert "partial_min_by" in merged and "Window" not in merged
    newest = plan(latest_pages(page_table.withColumn("run_no", F.lit(1))))
    assert "partial_max" in newest and "Window" not in newest


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 AS query_id", "id AS rank", "concat('u', id) AS url")
    text = plan(hits.top_hits(df, 3))
    assert text.count("WindowGroupLimit") == 2
