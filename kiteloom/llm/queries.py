"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.llm import bpe, chat, manifest, media, near_dedup, packing, prefix_trie, quality_rules, sharding, substring_dedup, toxicity, url_filters, vector_search
from kiteloom.llm.common import stage, table
from kiteloom.llm.oracles import ORACLE_SQL  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A conversation of control strings, which the formatting must keep apart from its own.
PROBE = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ids=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(stage(chat.format_events(chat.events_of(rows.unionByName(probe))), "chat"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    judged = url_filters.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("post_mean", 6).alias("post_mean"), F.round("lower_bound", 6).alias("lower_bound"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_byte_bpe, op4_substring_dedup, op5_chat_formatting,
        op6_minhash_near_dedup, op7_histogram_sharding, op8_url_filters, op9_media_chunks, op10_best_fit_packing,
        op11_adaptive_dimension_scan, op12_merkle_manifest, op13_prefix_trie,
    )
}
