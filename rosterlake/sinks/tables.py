"""Writing results: replace by source key, generations, partitioned tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import SOURCE_KEY
from ..functions.text import or_empty, strip
from ..spec import col


def merge_by_source_key(old: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of other keys plus the new rows.

    ``keys`` lists the source keys of the batch; a key without new rows still
    loses its old ones. Old rows without any value are dropped.
    """
    has_value = reduce(
        lambda a, b: a | b, (or_empty(col(c).cast("string")) != "" for c in old.columns)
    )
    batch = keys.select(strip(SOURCE_KEY).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    kept = (
        old.where(has_value)
        .withColumn("_k", strip(SOURCE_KEY))
        .join(batch, "_k", "left_anti")
        .drop("_k")
    )
    return kept.unionByName(new, allowMissingColumns=True)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions in ``df``.

    The rebalance hint lets adaptive execution merge small partition values
    into one file and split a value that holds a large share of the rows.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines without the NULL fields of a row."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to an append-only log (runs, schema versions, job events)."""
    df.write.mode("append").parquet(path)


class GenerationTable:
    """Replace-by-source-key on plain files, without rewriting other keys.

    Every run appends its rows under ``rows/run_no=N`` and then the list of keys
    it replaces under ``keys/run_no=N``. A row is current when its run is the
    last one that lists its key, so a key without new rows disappears. Writing a
    run again overwrites just that run: a retry changes nothing. A run counts
    once its keys are written. ``schema`` names the row columns, so that reading
    need not look into all files; columns a run lacks read as NULL.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self._spark, self._schema = spark, schema
        self._rows, self._keys = f"{path}/rows", f"{path}/keys"

    def commit(self, run_no: int, keys: DataFrame, rows: DataFrame) -> None:
        # the hint evens out file sizes, whatever share of the rows a key holds
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{self._rows}/run_no={run_no}")
        keys.select(SOURCE_KEY).distinct().write.mode("overwrite").parquet(
            f"{self._keys}/run_no={run_no}"
        )

    def current(self, before: int | None = None) -> DataFrame:
        """Current rows, or those that were current before a run.

        A run that may be retried reads the latter, so that its own first
        attempt does not change what it does.
        """
        key = T.StructType([T.StructField(SOURCE_KEY, T.StringType())])
        rows, keys = self._read(self._rows, self._schema), self._read(self._keys, key)
        if before is not None:
            rows, keys = rows.where(F.col("run_no") < before), keys.where(F.col("run_no") < before)
        last = (
            keys.groupBy(SOURCE_KEY)
            .agg(F.max("run_no").alias("run_no"))
        )
        return rows.join(last, [SOURCE_KEY, "run_no"], "left_semi")

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        with_run = T.StructType([*schema.fields, T.StructField("run_no", T.LongType())])
        return self._spark.read.schema(with_run).parquet(path)

    def compact(self, path: str) -> GenerationTable:
        """Write the current rows as the first run of a table at another path."""
        current = self.current()
        out = GenerationTable(self._spark, path, self._schema)
        out.commit(0, current, current.drop("run_no"))
        return out
