"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents. A runner writes each result and reads it again.

Nulls may be in any column, texts may be empty or very long, rows may be repeated and tables empty;
further columns, whatever their names, are carried to the last stage but one. What that means for a
stage stands with it. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import mixing, neardup, queries, rules, suffixes
from shelfmark.llm.common import materialise
from shelfmark.session import prepare


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like any other,
    equal texts alike; null ids are no labelled documents."""
    return rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: the smallest id, nulls last. Of repeated rows
    one stays; rows without words (null, empty) all stay."""
    return neardup.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur elsewhere; n_chars follows the text. Null texts
    stay null; a repeated row is a further place of its strings."""
    kept = suffixes.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, repeated rows one by one. A null source
    is a source; null and empty texts hold no words and come as often as their place allows."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text as digests, one row per row of the mix; a null text is encoded as empty."""
    return queries.bpe_digests(docs)


STAGES = [("quality_classifier", classify), ("near_dedup", near_dedup),
          ("suffix_array_dedup", suffix_dedup), ("source_mix", mix), ("bpe_encode", encode)]

#: The sketches, the mix and the encoding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
