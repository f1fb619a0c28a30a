"""URLs that have several pages in one run."""

import duckdb
import pytest

from checks.compare import differences
from checks.fixtures import TABLES
from rosterlake.operators import pages
from rosterlake.sinks.tables import GenerationTable
from rosterlake.streaming.snapshots import ChangeTracker, page_row_publisher

SF = "/root/testdata/sf0.001"
SNAPSHOT = "url string, run_no long, html string"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The small tables, with the last ten pages under URLs of earlier ones, some with their html."""
    out = tmp_path_factory.mktemp("repeated")
    for t in TABLES:
        rows = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "pages":
            html = "CASE WHEN p.page_id % 3 = 0 THEN coalesce(q.html, p.html) ELSE p.html END AS html"
            rows = f"""SELECT p.page_id, coalesce(q.url, p.url) AS url, {html}
                FROM ({rows}) p LEFT JOIN ({rows}) q ON p.page_id >= 40 AND q.page_id = p.page_id - 30"""
        duckdb.sql(f"COPY ({rows}) TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["page_changes", "subtree_changes", "subtree_changes_deep"])
def test_changes_as_in_sql(spark, repeated, name):
    assert differences(spark, repeated, name) is None


def test_only_the_newest_earlier_pages_count(spark):
    snaps = [("a", 0, "old"), ("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 1, "x"), ("c", 2, None)]
    changes = pages.changes_between(spark.createDataFrame(snaps, SNAPSHOT), 2)
    found = sorted((r["url"], r["status"]) for r in changes.collect())
    assert found == [("a", "changed")] * 2 + [("a", "unchanged")] * 2 + [("b", "gone")] * 2 + [("c", "new")]


def test_streamed_changes_as_in_sql(spark, repeated):
    assert differences(spark, repeated, "stream_page_changes") is None


def test_one_page_of_a_url_gives_its_rows(spark, tmp_path):
    schema = "_source_key string, html string"
    table = GenerationTable(spark, str(tmp_path / "rows"), spark.createDataFrame([], schema).schema)
    tracker = ChangeTracker(spark, str(tmp_path / "state"), page_row_publisher(table, lambda p: p.select("url", "html")))
    first = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 1, "x")]
    tracker.process(spark.createDataFrame(first, SNAPSHOT), 0)
    assert sorted(map(tuple, table.current().drop("run_no").collect())) == [("a", "y"), ("b", "x")]
    tracker.process(spark.createDataFrame([("a", 2, "y"), ("a", 2, "z"), ("b", 2, "x")], SNAPSHOT), 1)
    assert sorted(map(tuple, table.current().drop("run_no").collect())) == [("a", "z"), ("b", "x")]


def test_whole_run_as_in_sql(spark, repeated):
    assert differences(spark, repeated, "full_run") is None
