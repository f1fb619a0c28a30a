from pyspark.sql import functions as F

from rosterlake.llm import sharding

from .rows import awkward, clashing, empty


def test_new_shard_takes_rows_only_to_itself(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    df = sharding.add_shard(sharding.add_shard(df, "k", [1.0] * 24, "a"), "k", [1.0] * 25, "b")
    assert df.where("a <> b and b <> 24").count() == 0
    moved = df.where("b = 24").count()
    assert 600 < moved < 1000
    sizes = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(sizes) == 24 and min(sizes) > 680 and max(sizes) < 990


def test_weights(spark):
    df = sharding.add_shard(spark.range(20000), "id", [1.0, 0.0, 3.0], "s")
    sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(sizes) == {0, 2} and 0.7 < sizes[2] / 20000 < 0.8


def test_slots_have_no_gaps(spark):
    docs = clashing(awkward(spark))
    out = sharding.add_slot(sharding.add_shard(docs, "doc_id", [1.0] * 3), "shard", ["doc_id", "text"], 100_000)
    assert set(docs.columns) < set(out.columns) and out.count() == docs.count()
    for r in out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r["s"] == list(range(len(r["s"])))
    ids = {r["doc_id"]: r["shard"] for r in out.collect()}
    assert None in ids and len({r["shard"] for r in out.collect() if r["doc_id"] == 8}) == 1
    none = sharding.add_slot(sharding.add_shard(empty(spark), "doc_id", [1.0]), "shard", ["doc_id"], 0)
    assert none.count() == 0


def test_plan_is_native(spark):
    out = sharding.add_slot(sharding.add_shard(awkward(spark), "doc_id", [1.0] * 24), "shard", ["doc_id"], 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
