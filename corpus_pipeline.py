"""From raw documents to a mixed, sharded training corpus in five stages.

Each stage takes what the one before it kept, as a table written in between, and
returns the rows it keeps with the columns of documents; the last adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import decontaminate, language, mixing, near_dedup, sharding
from rosterlake.llm.columns import table, unused, whole_text
from rosterlake.llm.models import language_model
from rosterlake.session import StepTables

SHARDS = 24
#: No SQL can express training, edit distances or hashing as the stages do;
#: tests compare them with brute-force versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts without letters go."""
    name = unused(docs, "_language")
    found = language.predict(docs, language_model(docs), name=name)
    return found.where(language.confident(name)).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard, and slot in it."""
    shard, slot, crc = (unused(docs, c) for c in ("shard", "slot", "_crc"))
    rows = sharding.add_shard(docs, "doc_id", [1.0] * SHARDS, shard)
    rows = rows.withColumn(crc, F.crc32(whole_text().cast("binary")))
    return sharding.add_slot(rows, shard, ["doc_id", crc], docs.count(), slot).drop(crc)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = StepTables(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = steps.write(name.replace(" ", "_"), stage(spark, docs, sf_dir))
    return docs
