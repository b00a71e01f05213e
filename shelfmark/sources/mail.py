"""Landed responses of a message provider: id pages, message metadata and raw content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import functions as fn
from shelfmark.schemas import FACTS

_ID = T.StructType([T.StructField("id", T.StringType())])
_HEADER = T.StructType([T.StructField("name", T.StringType()),
                        T.StructField("value", T.StringType())])
# `token` is the page token the page was asked with; the first page has none.
LIST_PAGE = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("messages", T.ArrayType(_ID)),
    T.StructField("nextPageToken", T.StringType())])
METADATA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("internalDate", T.StringType()),
    T.StructField("payload", T.StructType([T.StructField("headers", T.ArrayType(_HEADER))]))])
RAW = T.StructType([T.StructField("id", T.StringType()), T.StructField("raw", T.StringType())])


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def subjects(headers: Column) -> Column:
    found = F.filter(headers, lambda h: F.lower(h["name"]) == "subject")
    found = F.transform(found, lambda h: fn.strip(F.coalesce(h["value"], F.lit(""))))
    return F.filter(found, lambda v: v != "")


def message_facts(pages: DataFrame, metadata: DataFrame, provider: str = "gmail") -> DataFrame:
    """FACTS of an inventory whose ids are joined to their metadata.

    A listed message without metadata, or without a numeric date, or with several subjects is an
    error of the provider's answer and stops the query.
    """
    ids = pages.select(F.explode("messages").alias("m")).select(F.col("m.id").alias("id"))
    rows = ids.join(metadata, "id", "left").withColumn("subject", subjects(
        F.coalesce("payload.headers", F.array().cast(T.ArrayType(_HEADER)))))
    date = F.col("internalDate")
    problem = (
        F.when(~F.coalesce(date.rlike(r"\A[0-9]+\z"), F.lit(False)), "internalDate is invalid")
        .when(F.size("subject") > 1, "Subject header is ambiguous")
    )
    none = F.lit(None).cast("string")
    return rows.select(
        F.pmod(F.xxhash64("id"), F.lit(1 << 62)).alias("ordinal"),
        F.lit(provider).alias("provider"), F.lit("message").alias("kind"),
        F.col("id").alias("external_id"),
        F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.get("subject", F.lit(0)))
        .alias("name"), none.alias("path"),
        F.lit(None).cast("bigint").alias("size"), F.lit("message/rfc822").alias("mime_type"),
        none.alias("modified_at"), none.alias("version_tag"), none.alias("content_hash"),
        F.to_json(F.struct("internalDate")).alias("raw"),
        F.lit(None).cast("timestamp").alias("observed_at")).select(*FACTS.fieldNames())


def message_content(raw: DataFrame, provider: str = "gmail") -> DataFrame:
    """(provider, external_id, content) from URL-safe base64 bodies; bad ones give null."""
    return raw.select(F.lit(provider).alias("provider"), F.col("id").alias("external_id"),
                      fn.base64url("raw").alias("content"))


def page_chain(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.lit("").alias("listing"), F.coalesce("token", F.lit("1")).alias("page"),
        F.col("nextPageToken").alias("next"), F.lit(None).cast("bigint").alias("total"))
