import os
from collections import Counter

import duckdb
import pytest

from rosterlake.llm.queries import ORACLES, QUERIES

#: They return rows for queries, not for each input; SQL stands beside both.
SEARCHES = {"op11_norm_buckets", "op12_ranked_search"}
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = Counter(cur.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SEARCHES))
def test_query_returns_a_row_for_each_input(spark, name):
    rows = QUERIES[name](spark, SF)
    n = rows.count()
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    given = spark.read.parquet(f"{SF}/{table}.parquet")
    if name == "pipeline":
        assert 0 < n and rows.join(given, "doc_id", "left_anti").count() == 0
    else:
        assert n == given.count() and rows.select(key).distinct().count() == n
