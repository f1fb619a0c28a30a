"""Session settings and the shared scratch area for iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages are wide rows: a batch handed to Python stays in the tens of megabytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rosterlake")
    local = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in {**SETTINGS, **local, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return named


class StepTables:
    """Written tables that cut the lineage of an iterative job.

    Every step is written once and read back, so the plan stays flat and a lost
    executor only costs a re-read. ``union`` reads all steps of a name together.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = f"{scratch_root(spark)}/rosterlake/{uuid.uuid4().hex}"
        self._paths: dict[str, list[str]] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        paths = self._paths.setdefault(name, [])
        path = f"{self._root}/{name}/{len(paths)}"
        df.write.mode("overwrite").parquet(path)
        paths.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def union(self, name: str) -> DataFrame:
        paths = self._paths[name]
        schema = self._spark.read.parquet(paths[0]).schema
        return self._spark.read.schema(schema).parquet(*paths)

    def close(self) -> None:
        """Delete the steps, once nothing that reads them is needed any more."""
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._root)
        path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class LinkSteps(StepTables):
    """Steps of narrow rows, joined by their counted rows instead of the size of their files.

    Files of links are so much smaller than their rows that Spark would send millions of
    rows through the driver to all executors. Here a table of up to ``SMALL_ROWS`` is
    sent, and a larger one is joined by sorting.
    """

    SMALL_ROWS = 20_000

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark)
        self.rows: dict[str, int] = {}

    def _joined_by_size(self, df: DataFrame, rows: int) -> DataFrame:
        return df.hint("broadcast" if rows <= self.SMALL_ROWS else "merge")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        out = super().write(name, df.observe(seen, F.count(F.lit(1)).alias("rows")))
        rows = seen.get["rows"]
        self.rows[name] = self.rows.get(name, 0) + rows
        return self._joined_by_size(out, rows)

    def union(self, name: str) -> DataFrame:
        return self._joined_by_size(super().union(name), self.rows[name])
