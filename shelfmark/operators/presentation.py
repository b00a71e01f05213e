"""Consumer-facing projections of resources, and nested JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import functions as fn
from shelfmark.operators import query as q
from shelfmark.operators.ordered import number_sorted
from shelfmark.operators.payloads import one_part
from shelfmark.schemas import Catalog

# Labels by MIME type.
DOCUMENT_TOKENS = ("document", "wordprocessing", "opendocument")
# Sources of one payload part; a resource with more gets several parts.
SOURCES_PER_PART = 1_000


def document_label(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "PDF").when(mime.contains("wordprocessing"), "DOCX")
        .when(mime.contains("opendocument"), "ODT").when(mime == "text/markdown", "Markdown")
        .otherwise("Document")
    )


def present(catalog: Catalog, heads: DataFrame, providers: DataFrame,
            preview_provider: str = "immich") -> DataFrame:
    """Detail card of resource rows `heads` (id, resource_type, title, created_at).

    `providers` has (provider, display_name). Format and size come from the first active source,
    in source order, that has one, else from the first content variant. Resources without a
    known active provider have no card.
    """
    rows = q.source_rows(catalog, heads.select("id"))
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(q.source_order())])
    known = providers.select(F.col("provider").alias("p_ref"), "display_name")
    firsts = rows.groupBy("id").agg(
        F.min_by("mime_type", F.when(F.col("mime_type").isNotNull(), place)).alias("mime"),
        F.min_by("size", F.when(F.col("size").isNotNull(), place)).alias("bytes"))
    # First by provider, then by dimension: a resource collects at most the known providers.
    named = (
        rows.groupBy("id", F.lower("provider").alias("p_ref")).agg(F.min("provider").alias("at"))
        .join(known, "p_ref").groupBy("id").agg(
            F.array_sort(F.collect_list(F.struct("at", "p_ref", "display_name"))).alias("ps"))
    )
    variant = F.struct("hash", F.coalesce("mime_type", F.lit("")), F.coalesce("size", F.lit(-1)))
    variants = (
        catalog.blobs.join(heads.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
        .groupBy(F.col("asset_id").alias("id")).agg(
            F.min_by("mime_type", F.when(F.col("mime_type").isNotNull(), variant)).alias("v_mime"),
            F.min_by("size", F.when(F.col("size").isNotNull(), variant)).alias("v_bytes"))
    )
    card = (
        heads.select("id", "resource_type", "title", "created_at")
        .join(named, "id").join(firsts, "id").join(variants, "id", "left")
        .withColumn("mime_type", F.coalesce("mime", "v_mime"))
        .withColumn("size_bytes", F.coalesce("bytes", "v_bytes"))
    )
    mime, message = F.col("mime_type"), F.col("resource_type") == "message"
    image = F.coalesce(mime.startswith("image/"), F.lit(False))
    document = F.coalesce(
        mime.startswith("text/") | (mime == "application/pdf")
        | mime.contains(DOCUMENT_TOKENS[0]) | mime.contains(DOCUMENT_TOKENS[1])
        | mime.contains(DOCUMENT_TOKENS[2]), F.lit(False))
    kind = (F.when(message, "message").when(image, "image").when(document, "document")
            .otherwise("generic"))
    label = (F.when(message, "Message")
             .when(image, F.upper(F.regexp_replace(mime, r"\Aimage/", "")))
             .when(document, document_label(mime)).otherwise("File"))
    preview = (F.col("kind") == "image") & F.exists("ps", lambda p: p["p_ref"] == preview_provider)
    return (
        card.withColumn("kind", kind).withColumn("label", label).withColumn("preview", preview)
        .select(
            fn.resource_ref("id").alias("resource_ref"), "kind", "label",
            F.coalesce(F.nullif("title", F.lit("")), F.when(message, "Untitled message")
                       .otherwise("Untitled resource")).alias("title"),
            F.coalesce(F.nullif(mime, F.lit("")), F.when(message, "Metadata only"))
            .alias("subtitle"),
            F.array_join(F.transform("ps", lambda p: p["display_name"]), ", ").alias("providers"),
            "preview", "mime_type", "size_bytes",
            F.when(F.col("size_bytes") >= 0, fn.size_label("size_bytes")).alias("size_label"),
            F.col("created_at").alias("first_observed_at"),
            F.when(message, "Message content is unavailable. Metadata only.")
            .when(~F.col("preview"), "A browser preview is not available for this resource.")
            .alias("notice"))
    )


def payloads(catalog: Catalog, heads: DataFrame, active_only: bool = True, whole: bool = False
             ) -> DataFrame:
    """One JSON object per resource and part: (resource_ref, part, parts, payload).

    The ordered source list of a resource is cut every `SOURCES_PER_PART` positions, so its
    parts, one after the other, are the whole list in order. With `whole` they are put together
    in one object per resource.
    """
    rows = q.source_rows(catalog, heads.select("id"), active_only)
    numbered = number_sorted(rows, ["id"], [*q.source_order(), F.col("source_id")], "place")
    sizes = numbered.groupBy("id").agg(
        F.ceil(F.max("place") / F.lit(SOURCES_PER_PART)).cast("int").alias("parts"))
    split = numbered.join(sizes, "id").withColumn(
        "part", F.floor((F.col("place") - 1) / F.lit(SOURCES_PER_PART)).cast("int"))
    entry = F.struct(
        F.struct(*[c.alias(f"k{i}") for i, c in enumerate(q.source_order())]).alias("key"),
        F.struct("provider", F.col("path").alias("location"), "name", "mime_type",
                 F.col("size").alias("size_bytes"), "is_active").alias("source"))
    lists = split.groupBy("id", "part", "parts").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"))
    if whole:
        lists = one_part(lists, ["id"], "entries").withColumn("parts", F.lit(1))
    full = heads.select("id", "resource_type", "title", "created_at").join(lists, "id", "left")
    body = F.struct(
        fn.resource_ref("id").alias("resource_ref"), "resource_type",
        F.col("title").alias("display_name"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("first_observed_at"),
        F.coalesce(F.transform("entries", lambda e: e["source"]), F.array()).alias("sources"))
    return full.select(
        fn.resource_ref("id").alias("resource_ref"), F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def rows_as_json(df: DataFrame) -> DataFrame:
    """Any flat result as one stable JSON object per row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))
