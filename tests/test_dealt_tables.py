"""Large tables are dealt to more tasks than cores, so that a task's rows don't grow with them."""

from checks import fixtures


def test_partitions_grow_with_the_file(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).selectExpr("id div 4 as l_orderkey", "id as l_partkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert fixtures.table(spark, str(tmp_path), "lineitem").rdd.getNumPartitions() == cores
    monkeypatch.setattr(fixtures, "DEALT_BYTES", 1000)
    dealt = fixtures.table(spark, str(tmp_path), "lineitem")
    assert dealt.rdd.getNumPartitions() > 4 * cores
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    # rows of an order stay together
    apart = dealt.selectExpr("l_orderkey", "spark_partition_id() as p").distinct()
    assert apart.count() == 1250


def test_a_table_without_files(spark, tmp_path):
    spark.range(0).selectExpr("id as page_id").write.parquet(str(tmp_path / "pages.parquet"))
    assert fixtures.table(spark, str(tmp_path), "pages").count() == 0
