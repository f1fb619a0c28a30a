import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import vector_search

SCHEMA = "vec_id long, embedding array<double>"


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def brute_force(rows, asks, k=5, scale=256):
    vectors = [(at, i, whole(v, scale)) for at, (i, v) in enumerate(rows)]
    vectors = [v for v in vectors if v[2] is not None]
    out = []
    for at, i, q in vectors:
        if i is not None and asks(i):
            others = [(j, sum(map(lambda x, y: x * y, q, v))) for a, j, v in vectors if a != at and len(v) == len(q)]
            scored = sorted((-max(min(s, 2**63 - 1), -(2**63)), j is None, j or 0, j) for j, s in others)
            out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(scored[:k], 1)]
    return Counter(out)


def random_rows(rng, n, size, spread):
    lengths = np.exp(rng.normal(0, spread, n))
    vectors = rng.normal(0, 1, (n, size)) * lengths[:, None] / np.sqrt(size)
    for i in range(0, n, 7):  # near copies and exact ones
        vectors[i] = vectors[rng.integers(n)] * (1 + (i % 2) * 0.01)
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("size, spread, ranges, bucket", [(16, 0, 64, 16384), (8, 1.0, 32, 16384), (32, 0.3, 16384, 50), (2, 0.5, 100, 7)])
def test_best_equal_brute_force(spark, monkeypatch, size, spread, ranges, bucket):
    monkeypatch.setattr(vector_search, "RANGE_ROWS", ranges)
    rng = np.random.default_rng(size)
    rows = random_rows(rng, 600, size, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_search.top_k(df, F.col("vec_id") % 9 == 0, slice_bytes=30 * (8 * size + 256), bucket_rows=bucket)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_force(rows, lambda i: i % 9 == 0)


@pytest.mark.parametrize("seed", range(12))
def test_pruning_by_either_way_loses_nothing(seed, monkeypatch):
    """Buckets searched in this process, with either way forced and with both."""
    rng = np.random.default_rng(seed)
    size, n, k = int(rng.integers(1, 12)), 400, 4
    vectors = np.floor(rng.normal(0, 60, (n, size)) * np.exp(rng.normal(0, 0.5, n))[:, None])
    vectors[::5] = vectors[rng.integers(0, n, n // 5)]
    lengths = np.array([math.hypot(*v) for v in vectors])
    monkeypatch.setattr(vector_search, "COORDINATES_FROM", [0.0, 0.5, 2.0][seed % 3])
    none = np.zeros(n, bool)
    asked = np.arange(0, n, 11)
    queries = vector_search.Queries(asked, asked, none[asked], lengths[asked], vectors[asked])
    best = vector_search.Best(queries, k)
    order = np.argsort(-lengths)
    for low in range(0, n, 60):
        some = order[low : low + 60]
        best.search(vector_search.Bucket(some, some, none[some], lengths[some], vectors[some], k))
    query, row, _, _, score = best.kept
    for i, q in enumerate(asked):
        products = vectors @ vectors[q]
        want = sorted((-products[j], j) for j in range(n) if j != q)[:k]
        got = sorted(zip((-score[query == i]).tolist(), row[query == i].tolist(), strict=True))
        assert got == want


def test_awkward_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, []), (101, []), (150, [1.0]), (200, None), (201, [None, 1.0]),
        (250, [nan, 1.0]), (251, [1.0, inf]), (None, [3.0, 1.0]), (None, [3.0, 1.0]), (300, [1.0, 2.0, 3.0]), (302, [0.5, 0.25, 0.0]),
        (350, [1e9, 1e9]), (351, [-1e12, 1e12]), (352, [1e16, -3e15]), (400, [-0.0, -1e-9]), (7, [1.0, 2.0]), (450, [1e200, 1e200]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("id", F.lit(1)).withColumn("asks", F.lit("x"))
    got = Counter(map(tuple, vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_force(rows, lambda i: i % 50 == 0)


def test_hot_vector_and_ties(spark):
    rows = [(i, [0.5, 0.5, -0.5]) for i in range(3000)] + [(5000 + i, [0.1 * (i % 3), 0.2, 0.3]) for i in range(300)]
    got = Counter(map(tuple, vector_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_force(rows, lambda i: i % 100 == 0)


def test_nothing_to_search(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], SCHEMA)
    for rows in (df, df.where("false"), df.where("vec_id = 2")):
        got = vector_search.top_k(rows, F.col("vec_id") % 50 == 0)
        assert got.count() == 0 and dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
