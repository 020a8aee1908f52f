"""One query per operator, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    alignment, bpe, decontaminate, jaccard, langid, linededup, quality, resampling, sharding, suffixes, tokenfile, toxicity,
    urlfilter,
)
from linkloom.llm.shipping import ship
from linkloom.operators.staging import staging_dir

SHARDS = 40
URL_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]
UNWANTED_HOSTS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(quality.statistics(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = urlfilter.urls_of_hosts(pages, UNWANTED_HOSTS)
    return urlfilter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "is_listed", "verdict")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that has a passage of 50 words or more which the table holds elsewhere."""
    words = lambda ranges: F.aggregate(ranges, F.lit(0).cast("bigint"), lambda sum, x: sum + x["end"] - x["start"])
    found = suffixes.passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", words("passages").alias("n_repeated"), words("copies").alias("n_copied"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(spark, folder)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """A model that learns from no held-out document."""
    return toxicity.fit(docs, labels.where(~toxicity.held_out()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align(read(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_url_filters, op4_suffix_array_dedup, op5_language_id,
                                     op6_ngram_jaccard_join, op7_decontamination, op8_token_files,
                                     op9_bpe, op10_toxicity, op11_line_dedup, op12_importance_resampling,
                                     op13_tokenizer_alignment)}
