"""The queries opN_<name> over the given tables, and SQL beside them.

Each query applies an operator of this package to whole tables and derives the
columns asked for from the operator's result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import (
    decontaminate,
    fill_middle,
    fingerprints,
    language,
    main_text,
    mixing,
    near_dedup,
    ranked_search,
    repeats,
    sharding,
    surrogates,
    token_frames,
    vector_search,
)
from rosterlake.llm.columns import table, whole_text
from rosterlake.llm.models import held_out, language_model, public_file
from rosterlake.llm.oracles import ORACLES
from rosterlake.llm.successors import with_next
from rosterlake.session import scratch_root

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 24
#: Keys surrogates. A deployment passes its own secret to the operator.
SURROGATE_KEY = b"registered query"


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True))
    return found.select("doc_id", "class_id", "group_id", kept.alias("kept"))


def op2_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("t"))
    docs = with_next(fingerprints.add_fingerprint(docs, "t", "fp"), "doc_id", ["t", "fp"])
    n = F.length("t").cast("long")
    tail = F.floor(n / 4).cast("int")
    start = F.lit(1)
    edited = F.concat(F.substring("t", start, n.cast("int") - tail), F.substring("next_t", start, tail))
    docs = fingerprints.add_fingerprint(docs.withColumn("edited", edited), "edited", "edited_fp")
    return docs.select(
        "doc_id",
        n.alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/rosterlake/{uuid.uuid4().hex}/tokens"
    docs = table(spark, sf_dir, "documents")
    token_frames.write_tokens(docs, folder, public_file("byte_bpe_50k.json"))
    return token_frames.read_digests(spark, folder)


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")))
    words = F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x)
    return mixed.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = main_text.extract(pages, main_text.train(main_text.sample(pages)))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = repeats.remove_repeats(docs, with_text=False)
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"))
    return keyed.join(digests, "text_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("language")["lang"].alias("lang_pred"),
        F.col("language")["score"].alias("score"),
    )


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = whole_text()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = sharding.add_shard(rows, "doc_id", [1.0] * SHARDS)
    rows = sharding.add_shard(rows, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.add_slot(rows, "shard", ["doc_id", "text_crc32"], docs.count())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col("contamination")
    return marked.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.col("fim")
    return docs.select(
        "doc_id",
        *[cut[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(cut["output"], 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(cut["output"], cut["form"]), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_one_permutation_fingerprints": op2_one_permutation_fingerprints,
    "op3_token_frames": op3_token_frames,
    "op5_surrogates": op5_surrogates,
    "op6_main_text": op6_main_text,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_unigram_language": op8_unigram_language,
    "op4_fair_mix": op4_fair_mix,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_norm_buckets": op11_norm_buckets,
    "op12_ranked_search": op12_ranked_search,
    "op13_fill_middle": op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}
