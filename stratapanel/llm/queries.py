"""The operators' queries over the given tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import (
    attribution, balltree, bpe, chat, classifier, fingerprints, materialise, mixing, neardup, packing, resampling,
    rules, sharding, twins,
)
from stratapanel.llm.common import table
from stratapanel.sources.scratch import cut_lineage

MAX_REPEAT = 2.0
SHARDS = 40
ORDER_KEY = 20_240


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_comparison(table(spark, sf_dir, "documents"))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.text_tokens(F.col("text")), max_repeat=MAX_REPEAT)


def op3_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    records, _ = materialise.write_in_order(docs, public_tokenizers.path("word_bpe_49k.json"), ORDER_KEY)
    return records


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.train(docs, labels)
    scored = classifier.with_score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= classifier.KEEP_FROM).cast("int").alias("predicted"),
    )


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = cut_lineage(rules.with_measures(docs, keep=["doc_id", "source"]), "measured")
    return rules.judge(measured).select("doc_id", *rules.MEASURES, "base_failed", "host_distrusted", "kept")


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.count_by_part(docs, path, public_tokenizers.PATTERN)


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints, op2_temperature_mix, op3_splitter_shards, op4_training_order,
        op5_compression_classifier, op6_snapshot_collapse, op7_host_rules, op8_token_attribution,
        op9_curve_packing, op10_simhash_groups, op11_ball_tree_search, op12_target_resampling, op13_prefix_bpe,
    )
}
ORACLES: dict[str, str] = twins.ORACLES
