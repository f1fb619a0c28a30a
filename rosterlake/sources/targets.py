"""Reading target tables (organisation, department, link, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, null_if_token, strip
from ..functions.urls import is_http

NAME_COLUMNS = {
    "university_name": "university",
    "department_name": "department",
    "link": "link",
    "status": "status",
}


def snake_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def title_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace("_", " ").title() for c in df.columns))


def normalize_targets(raw: DataFrame) -> DataFrame:
    """university, department, link, status (and further columns) from raw rows.

    Rows without a university are dropped, spelled-out nulls become NULL and a
    link is kept only when it is an http one.
    """
    df = snake_headers(raw)
    if "university_name" not in df.columns:
        raise ValueError("missing required column: university_name")
    for source in NAME_COLUMNS:
        if source not in df.columns:
            df = df.withColumn(source, F.lit(None).cast("string"))
    link = null_if_token("link")
    rest = [F.col(c) for c in df.columns if c not in NAME_COLUMNS]
    return df.where(~is_blank("university_name")).select(
        strip("university_name").alias("university"),
        null_if_token("department_name").alias("department"),
        F.when(is_http(link), link).alias("link"),
        null_if_token("status").alias("status"),
        *rest,
    )


def read_targets(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", **options}
    return normalize_targets(spark.read.format(fmt).options(**options).load(path))
