"""The operators' registered queries: thin views of their results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.llm import (
    contamination,
    extraction,
    negatives,
    pieces,
    pii,
    preference,
    quality,
    repair,
    sharding,
    simhash,
    urls,
    whitening,
    wordpiece,
)
from aislemetrics.llm.common import table
from aislemetrics.session import shared_path

# Shards that documents are placed on; the lookup table has over a hundred slots for each.
SHARDS = 32
# What is known of hosts and paths beforehand: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.with_length(extraction.extract(table(spark, folder, "pages"), extraction.train()))


def op2_grammar_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "id-shards")
    repair.write_shards(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"))
    return repair.digests(spark, path)


def op3_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.digests(pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model")))


def op4_shard_placement(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.placed(table(spark, folder, "documents"), SHARDS)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    talks = preference.conversations(table(spark, folder, "conversations"))
    return preference.digests(preference.preference_rows(preference.with_swapped_replies(talks)))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.digests(pii.personal_data(docs, pii.fit(docs)))


def op9_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return contamination.digests(found)


def op10_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_rows(rows.select("vec_id", shifted.alias("label"), "embedding"))
    return negatives.hard_negatives(rows, lambda frame: frame.where("vec_id % 100 = 0"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whitened_components(table(spark, folder, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_page_text": op1_page_text,
    "op2_grammar_shards": op2_grammar_shards,
    "op3_piece_round_trip": op3_piece_round_trip,
    "op4_shard_placement": op4_shard_placement,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_personal_data": op8_personal_data,
    "op9_benchmark_hits": op9_benchmark_hits,
    "op10_piece_counts": op10_piece_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
}
