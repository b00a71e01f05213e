"""The registered queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe, jaccardtree, mixing, neardup, outliers, periods, rules, sharding, substring, suffixes,
    tokenfile, turntrie, vafile,
)
from shelfmark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE[plan.__name__] = sql
        return plan
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids and decoded text of every document as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return ids.select(
        "doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@register()
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


@register()
def op2_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@register()
def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.classify(documents(spark, sf_dir), labels).select(
        "doc_id", "held_out", "score", "predicted")


@register()
def op4_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


@register()
def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register("""
    WITH good AS (
        SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x:
            CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
            x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
    scored AS (
        SELECT q.place AS query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
            list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM good q JOIN good c ON c.place <> q.place WHERE q.vec_id % 50 = 0),
    ranked AS (
        SELECT query_id, vec_id, score, CAST(row_number() OVER (
            PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op6_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return vafile.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@register()
def op7_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "d2")


@register()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@register()
def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register()
def op10_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


@register()
def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return turntrie.prefix_trie(turntrie.rebuilt(turns))


@register()
def op12_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardtree.jaccard_groups(documents(spark, sf_dir))


@register()
def op13_lcp_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find_runs(documents(spark, sf_dir), periodic=True)
